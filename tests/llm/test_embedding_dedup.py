import duckdb
import numpy as np
import pytest

from locusforge.llm import embedding_dedup as E

DDL = "vec_id long, embedding array<float>, label int, h1 string, node int, links string, n string"


def rows_of(vectors):
    """Rows of (vec_id, vector or None, label), with columns that clash with inner names."""
    return [(i, None if v is None else [None if x is None else float(x) for x in v], label, "h", 1, "l", "n")
            for i, v, label in vectors]


def brute(vectors, cosine=E.COSINE):
    """Per row (vec_id, n_links, component_id, kept), all pairs compared."""
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(vectors)
    near = np.zeros((n, n), dtype=bool)
    for i, (_, v, label) in enumerate(vectors):
        for j, (_, w, other) in enumerate(vectors[:i]):
            if label == other and good(v, label) and good(w, other) and len(v) == len(w):
                a, b = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    label = np.arange(n)
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    least = {}
    for (i, _, _), c in zip(vectors, label):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(i, least[c])
    return sorted(((i, int(near[k].sum()), least[label[k]], i == least[label[k]])
                   for k, (i, _, _) in enumerate(vectors)), key=str)


def found(spark, vectors, **how):
    out = E.near_duplicates(spark.createDataFrame(rows_of(vectors), DDL).repartition(3), **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    """Random vectors, a dense group of which all labels hold some, copies, and rows that link with nothing."""
    rng = np.random.RandomState(3)
    out = [v for v in rng.normal(size=(60, 16))]
    centre = rng.normal(size=16)
    out += [centre + rng.normal(size=16) * 0.1 for _ in range(90)]
    out += [v + rng.normal(size=16) * 0.05 for v in out[:10]] + [out[5]] * 4 + [out[5] * 3] + [centre] * 30
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(out)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [nan], [1.0] * 15 + [inf], [1.0] * 15 + [None], [1e-40] * 16,
           [1e38] * 16, [1.0] * 8, [1.0] * 8]
    rows += [(500 + i, v, 1) for i, v in enumerate(odd)] + [(600, rows[0][1], None), (None, rows[0][1], 1),
                                                            (7, rows[7][1], 0), (None, [5.0, 4.0], 0)]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_against_all_pairs(spark, vectors, block):
    # More tables than by default: no pair at the limit itself may be missed here.
    assert found(spark, vectors, tables=64, block=block) == brute(vectors)


def test_recall_of_the_production_tables(spark):
    rng = np.random.RandomState(8)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(axis=1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack((base, 0.9801 * base + 0.1985 * turn)))]
    links = sum(r[1] for r in found(spark, vectors)) / 2
    assert 0.95 * 400 <= links <= 400


def test_empty_table_and_integer_components(spark):
    assert found(spark, []) == []
    whole = spark.createDataFrame([(1, [1, 2, 3], "a"), (2, [2, 4, 6], "a"), (3, [1, 2, 3], "b")],
                                  "vec_id long, embedding array<int>, label string")
    assert sorted(tuple(r) for r in E.near_duplicates(whole).collect()) == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    out = sorted(tuple(r) for r in E.op11_embedding_near_dedup(spark, folder).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert out == sorted(db.execute(E.OP11_SQL).fetchall())
