"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled good) and unlabelled web text train a
logistic model that minimises the non-negative unbiased risk: the risk on the
positives weighted by the class prior, plus the part of the unlabelled risk
that the positives do not explain, held at zero or above. The prior is
estimated from the scores of a first model that only tells positives from
unlabelled text. Labels of bad documents are never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm.common import bounded_batches, bytes_of, stored, table, text_of

# Training rows of each kind, at most: a sample by hash of doc_id and text.
MAX_TRAINING_ROWS = 6000
THRESHOLD = 0.7
STEPS = 600
RATE = 0.05
DECAY = 1e-3

# Symbols whose density marks junk.
SYMBOLS = b"#*$%&|<>!~^=_@{}[]\\/+"
N_SHAPES = 18
# Byte pairs are folded into so many counts.
N_PAIRS = 64
# ASCII marks that are neither letters nor digits, each with a count of its own.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
WIDTH = N_SHAPES + len(MARKS) + N_PAIRS


# --- features -------------------------------------------------------------
def features(raw: bytes) -> np.ndarray:
    """Densities of a whole text, all between 0 and about 1, whatever its length."""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    data = np.frombuffer(raw, dtype=np.uint8)
    histogram = np.bincount(data, minlength=256) / size
    lines = raw.split(b"\n")
    unique = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    triples = len(set(zip(words, words[1:], words[2:])))
    upper = sum(map(bytes.isupper, words))
    letters = histogram[65:91].sum() + histogram[97:123].sum() + histogram[128:].sum()
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    shapes = [
        unique / n, again / n, pairs / n, triples / n, upper / n,
        sum(map(bytes.isalpha, words)) / n,
        histogram[65:91].sum(), histogram[48:58].sum(), letters, histogram[list(SYMBOLS)].sum(),
        histogram[[46, 44, 59, 58]].sum() * 5, histogram[10] * 20, histogram[32],
        min(lengths.mean() / 20, 2.0), min(lengths.std() / 20, 2.0), min(lengths.max() / 100, 2.0),
        len(set(lines)) / len(lines), min(np.log1p(len(words)) / 10, 2.0),
    ]
    folded = np.zeros(N_PAIRS)
    if len(data) > 1:
        classes = _CLASSES[data]
        folded = np.bincount(classes[:-1] * 8 + classes[1:], minlength=N_PAIRS) / (len(data) - 1)
    return np.concatenate((shapes, histogram[MARKS] * 5, folded)).astype(np.float32)


def _byte_classes() -> np.ndarray:
    """Lower, upper, digit, blank, newline, beyond ASCII, sentence marks, other symbols."""
    classes = np.full(256, 7, dtype=np.int64)
    classes[97:123], classes[65:91], classes[48:58] = 0, 1, 2
    classes[[32, 9, 11, 12, 13]], classes[10], classes[128:] = 3, 4, 5
    classes[[46, 44, 59, 58, 39, 45]] = 6
    return classes


_CLASSES = _byte_classes()


def feature_matrix(texts) -> np.ndarray:
    return np.stack([features(raw) for raw in texts]) if len(texts) else np.zeros((0, WIDTH))


# --- training -------------------------------------------------------------
@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def minimise_pu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk with the logistic loss.

    Risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]).
    While the second term is negative, its gradient is followed upwards.
    """
    w = np.zeros(positive.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.hstack((x, np.ones((len(x), 1)))) for x in (positive, unlabelled))
    for step in range(1, STEPS + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up = p.T @ sp / len(p) * prior                   # gradient of prior * E_p[loss(-)]
        rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        negative = u.T @ su / len(u) - up
        gradient = negative - (p.T @ (1 - sp) / len(p)) * prior if rest >= 0 else -negative
        gradient = gradient + DECAY * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows: the smallest ratio of upper tails of the scores.

    Every tail of the unlabelled scores holds at least the prior's share of
    the positives' tail, so the ratio is bounded below by the prior and meets
    it where no negative scores as high. A margin keeps thin tails out.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    tails_p = np.array([(positive >= c).mean() for c in cuts])
    tails_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((tails_u + margin) / tails_p)
    return float(np.clip(tails_u[best] / tails_p[best], 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Fit on feature rows. Without positives every text scores the prior of 0.5."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    half = np.arange(len(p)) % 2 == 0
    other = np.arange(len(u)) % 2 == 0
    if half.all() or other.all():
        prior = 0.5
    else:
        # Prior 1 leaves the plain contrast of positives and unlabelled rows.
        w, b = _contrast(p[half], u[other])
        prior = estimate_prior(p[~half] @ w + b, u[~other] @ w + b)
    w, b = minimise_pu_risk(p, u, prior)
    return Model(mean, scale, w, b, prior)


def _contrast(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of positives against unlabelled rows, for the prior."""
    x = np.vstack((positive, unlabelled))
    x = np.hstack((x, np.ones((len(x), 1))))
    y = np.concatenate((np.ones(len(positive)), np.zeros(len(unlabelled))))
    weight = np.where(y == 1, 0.5 / len(positive), 0.5 / len(unlabelled))
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        g = x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-3 * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g ** 2
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


# --- Spark ----------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the doc_id's text leaves 2 by 4 (null: empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sampled(rows: int, most: int, *columns: str) -> Column:
    """About ``most`` of ``rows`` rows, by a hash of the columns at its full 64 bits."""
    if rows <= most:
        return F.lit(True)
    return F.xxhash64(F.lit(11), *columns) < F.lit((most << 64) // rows - (1 << 63))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """Train on at most about ``most`` positives and ``most`` unlabelled documents.

    Positives are documents labelled quality 1, unlabelled ones any documents,
    both outside the held-out rows. Rows of equal doc_id and text are one
    document, rows of one doc_id (or none) with other texts are several. Only
    feature vectors reach the driver: 2 x ``most`` rows of fixed width.
    """
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_label_id")).distinct()
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), bytes_of().alias("raw")).where(
        ~held_out(F.col("doc_id")))
    keys = stored(texts.select("doc_id", "text_key").distinct(), "training-keys")
    positive = keys.join(good, F.col("doc_id") == F.col("_label_id")).select(
        "_label_id", F.col("text_key").alias("_label_text"))
    # The sample has about ``most`` keys, so it may be broadcast.
    trusted = F.broadcast(positive.where(_sampled(positive.count(), most, "_label_id", "_label_text")))
    marked = (texts.join(trusted, (F.col("doc_id") == F.col("_label_id")) & (F.col("text_key") == F.col("_label_text")),
                         "left")
              .select("doc_id", "text_key", "raw", F.col("_label_id").isNotNull().alias("positive"),
                      _sampled(keys.count(), most, "doc_id", "text_key").alias("unlabelled"))
              .where("positive OR unlabelled").dropDuplicates(["doc_id", "text_key"])
              .select("raw", "positive", "unlabelled"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"positive": b["positive"], "unlabelled": b["unlabelled"],
                                    "x": [features(raw).tobytes() for raw in b["raw"]]})

    rows = bounded_batches(marked).mapInPandas(run, "positive boolean, unlabelled boolean, x binary").toPandas()
    rows = rows.sort_values("x")  # the same order whatever the partitioning
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in rows["x"]]) if len(rows) else np.zeros((0, 1))
    return train(x[rows["positive"].to_numpy(bool)].astype(float), x[rows["unlabelled"].to_numpy(bool)].astype(float))


def score(model: Model, column: str = "text") -> Column:
    """Probability of good quality of a whole text (null and empty: that of the empty text)."""
    @F.pandas_udf("double")
    def run(raws: pd.Series) -> pd.Series:
        out = np.zeros(len(raws))
        for i in range(0, len(raws), 512):
            out[i:i + 512] = model.score(feature_matrix(raws.iloc[i:i + 512].tolist()))
        return pd.Series(out)

    return run(bytes_of(column))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored below ``threshold``; all columns as they are.

    Null and empty texts get the score of the empty text; equal texts get
    equal scores; without positive labels every score is 0.5 and none stays.
    """
    return docs.where(score(fit(docs, labels)) >= threshold)


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, its score and the prediction."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
