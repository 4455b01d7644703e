"""Conversation repair by grammar-compressed dynamic programming.

A repaired conversation has the roles ``(s?(ua)+)?`` by their initials. Which
edits reach that at the least cost depends on the rows' roles and faults alone,
so every row becomes one of nine symbols. Four states tell what may follow
(nothing yet, after s, after u, after a), and a symbol is a 4 x 4 matrix: the
cheapest edits from state to state and their letters, the audit. Matrices are
multiplied in the min-plus semiring; audits are ropes that share their parts.

Re-Pair finds the pairs of symbols that sequences of many conversations share.
One matrix per rule, made from those of its two parts, serves all of them, and
a conversation is the product of the few symbols that are left of it.

Rows are range-partitioned by conversation and turn, so a conversation of any
length is cut over tasks; the products of its parts meet afterwards. Ties go to
the ASCII-least audit. Equal-cost audits of the same rows are never prefixes of
each other (that would take an insertion for free), so the least of two stays
the least whatever is put behind both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm import repair
from locusforge.llm.common import bounded_batches, slices, stored, table

# The costs of the edits and the roles that are put in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"

# Symbols of a sequence after which it is cut, and of the sequences of one grammar.
CHUNK = 1 << 16
GRAMMAR = 1 << 20
# Rows of one text in a conversation meet its first turn in so many parts.
PARTS = 16

# Symbols: the role's initial (s, u, a, other), 4 more where truncated; DROP has to go.
OTHER, DROP = 3, 8
NONE, BLANK, DUPLICATE, CUT = range(4)  # a row's first fault
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = [{START: AFTER_S}, {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, {AFTER_U: AFTER_A}]


# --- ropes ----------------------------------------------------------------
# A modulus for which powers of 256 do not come round soon.
_MODULUS = (1 << 61) - 31


class Rope:
    """A string made of shared parts, with a hash to tell equal parts."""
    __slots__ = ("left", "right", "text", "size", "hash", "power")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            raw = text.encode()
            self.size, self.hash = len(raw), int.from_bytes(raw) % _MODULUS
            self.power = pow(256, len(raw), _MODULUS)
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * right.power + right.hash) % _MODULUS
            self.power = left.power * right.power % _MODULUS

    def __add__(self, other: Rope) -> Rope:
        return self if not other.size else other if not self.size else Rope(None, self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.text is None:
                todo += (rope.right, rope.left)
            else:
                out.append(rope.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """ASCII order; equal parts are passed over by their hash."""
        left, right = [self], [other]
        while left and right:
            a, b = left.pop(), right.pop()
            if a is b or (a.size == b.size and a.hash == b.hash):
                continue
            if a.text is not None and b.text is not None:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                for todo, rope in ((left, a), (right, b)):
                    if rope.size > n:
                        todo.append(Rope(rope.text[n:]))
            elif b.text is not None or (a.text is None and a.size >= b.size):
                left += (a.right, a.left)
                right.append(b)
            else:
                right += (b.right, b.left)
                left.append(a)
        return bool(right)


# --- matrices -------------------------------------------------------------
# matrix[i] maps a state j to (cost, audit) of the cheapest edits from i to j.
Matrix = list[dict[int, tuple[int, Rope]]]


def _cheaper(row: dict, j: int, cost: int, audit: Rope) -> None:
    if j not in row or (cost, audit) < row[j]:
        row[j] = (cost, audit)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [{} for _ in a]
    for row, made in zip(a, out):
        for k, (cost, audit) in row.items():
            for j, (more, tail) in b[k].items():
                total = cost + more
                if j not in made or total <= made[j][0]:
                    _cheaper(made, j, total, audit + tail)
    return out


def _insertions() -> Matrix:
    """No, one or two insertions: more never pay, as roles come round after two."""
    one: Matrix = [{i: (0, Rope(""))} for i in range(4)]
    for step in NEXT[1:]:
        for i, j in step.items():
            one[i][j] = (INSERT, Rope("I"))
    return product(one, one)


def _edit(symbol: int) -> Matrix:
    """Keep, rerole or delete one row."""
    out: Matrix = [{i: (DELETE, Rope("D"))} for i in range(4)]
    if symbol != DROP:
        extra = TRUNCATED * (symbol // 4)
        for step in NEXT[1:]:
            for i, j in step.items():
                _cheaper(out[i], j, REROLE + extra, Rope("R"))
        for i, j in (NEXT[symbol % 4] if symbol % 4 < OTHER else {}).items():
            _cheaper(out[i], j, extra, Rope("K"))
    return out


ENDING = _insertions()
SYMBOLS = [product(ENDING, _edit(symbol)) for symbol in range(DROP + 1)]
UNIT: Matrix = [{i: (0, Rope(""))} for i in range(4)]


def best(row: dict[int, tuple[int, Rope]]) -> tuple[int, Rope]:
    """The cheapest way from the start, whose costs by state are ``row``, to a whole conversation."""
    ended = product([row], ENDING)[0]
    return min(ended[j] for j in (START, AFTER_A) if j in ended)


def solve(sequences: list[np.ndarray], whole: list[bool], min_count: int = repair.MIN_COUNT) -> list[Matrix]:
    """The matrix of every sequence of symbols; of whole conversations its first row alone.

    One grammar covers all sequences, with a number of its own after each, so
    no rule reaches across. Rules are evaluated once, in the order in which
    they were made.
    """
    if not sequences:
        return []
    ends = np.cumsum([len(s) for s in sequences])
    marks = DROP + 1 + np.arange(len(sequences))
    grammar = repair.compress(np.insert(np.concatenate(sequences).astype(np.int64), ends, marks), min_count)
    matrices = dict(enumerate(SYMBOLS))
    for i, (a, b) in enumerate(grammar.rules.tolist()):
        matrices[grammar.base + i] = product(matrices[a], matrices[b])
    out, begin = [], 0
    symbols = grammar.symbols
    for end, alone in zip(np.flatnonzero((symbols > DROP) & (symbols < grammar.base)).tolist(), whole):
        made = UNIT[:1] if alone else UNIT
        for symbol in symbols[begin:end].tolist():
            made = product(made, matrices[symbol])
        out.append(made)
        begin = end + 1
    return out


# --- sequences ------------------------------------------------------------
COUNTS = ["blank", "duplicate", "truncated", "illegal"]
EDGES = ["first", "last", "least", "most", "turns"]  # initials, turns and number of turns of a part
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


class Part:
    """Rows of one conversation that follow each other: counts, edges and symbols."""

    def __init__(self, conv, number: int, open_: bool):
        self.conv, self.number, self.open = conv, number, open_
        self.symbols: list[np.ndarray] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, initial, fault, n, turn, known) -> None:
        """Rows in order; ``n`` copies of each, of which all but the first are duplicates, ``known`` turns."""
        self.blank += int(n[fault == BLANK].sum())
        self.duplicate += int(n[fault == DUPLICATE].sum() + (n - 1)[(fault == NONE) | (fault == CUT)].sum())
        self.truncated += int((fault == CUT).sum())
        self.illegal += int((n - 1).sum() + (~_LEGAL[initial[:-1], initial[1:]]).sum())
        if self.last is not None:
            self.illegal += not _LEGAL[self.last, initial[0]]
        self.first, self.last = (int(initial[0]) if self.first is None else self.first), int(initial[-1])
        turn = turn[known]
        if len(turn):
            self.turns += 1 + int((turn[1:] != turn[:-1]).sum()) - (self.most == turn[0])
            self.least, self.most = (int(turn[0]) if self.least is None else self.least), int(turn[-1])
        own = np.where((fault == BLANK) | (fault == DUPLICATE), DROP, initial + 4 * (fault == CUT)).astype(np.uint8)
        symbols = np.full(int(n.sum()), DROP, dtype=np.uint8)
        symbols[np.cumsum(n) - n] = own
        self.symbols.append(symbols)
        self.size += len(symbols)


PART_DDL = (", ".join(f"{c} long" for c in ["task", "number", *COUNTS, *EDGES])
            + ", open boolean, ways array<struct<i:int,j:int,cost:bigint,audit:string>>")
_WAYS = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _solved(parts: list[Part], task: int, conv_type: pa.DataType) -> pa.RecordBatch:
    """One row a part. Equal sequences are solved once."""
    keys = [(np.concatenate(p.symbols).tobytes(), not p.open) for p in parts]
    distinct = list(dict.fromkeys(keys))
    solved = solve([np.frombuffer(raw, np.uint8) for raw, _ in distinct], [whole for _, whole in distinct])
    ways = {}
    for key, matrix in zip(distinct, solved):
        if key[1]:
            cost, audit = best(matrix[0])
            ways[key] = [{"i": START, "j": START, "cost": cost, "audit": str(audit)}]
        else:
            ways[key] = [{"i": i, "j": j, "cost": cost, "audit": str(audit)}
                         for i, row in enumerate(matrix) for j, (cost, audit) in row.items()]
    columns = {"conv_id": pa.array([p.conv for p in parts], conv_type),
               "task": pa.array([task] * len(parts), pa.int64())}
    for name in ["number", *COUNTS, *EDGES]:
        columns[name] = pa.array([getattr(p, name) for p in parts], pa.int64())
    columns["open"] = pa.array([p.open for p in parts])
    columns["ways"] = pa.array([ways[k] for k in keys], _WAYS)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, cut into parts. Those at a task's edges may go on in the next: open."""
    from pyspark import TaskContext
    task, conv_type = TaskContext.get().partitionId(), None
    now: Part | None = None
    done: list[Part] = []
    size = 0
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        convs = batch.column("conv_id").to_pylist()
        initial, fault, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("initial", "fault", "n"))
        known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        turn = batch.column("turn").fill_null(0).to_numpy()
        cuts = [0, *[i for i in range(1, len(convs)) if convs[i] != convs[i - 1]], len(convs)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if now is None:
                now = Part(convs[a], 0, True)
            elif now.conv != convs[a]:
                done.append(now)
                size += now.size
                now = Part(convs[a], 0, False)
            elif now.size >= CHUNK:
                now.open = True
                done.append(now)
                size += now.size
                now = Part(convs[a], now.number + 1, True)
            now.add(initial[a:b], fault[a:b], n[a:b], turn[a:b], known[a:b])
        if size >= GRAMMAR:
            yield _solved(done, task, conv_type)
            done, size = [], 0
    if now is not None:
        now.open = True
        yield _solved([*done, now], task, conv_type)


SUMMARY_DDL = ", ".join(f"{c} long" for c in ["gaps", *COUNTS, "cost"]) + ", audit string"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation and place, multiplied from the first to the last."""
    conv, row, total = None, None, None

    def close(conv_type) -> pa.RecordBatch:
        cost, audit = best(row)
        gaps = total["most"] - total["least"] + 1 - total["turns"] if total["turns"] else 0
        values = [[conv], [gaps], *[[total[c]] for c in COUNTS], [cost], [str(audit)]]
        kinds = [conv_type, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                          ["conv_id", "gaps", *COUNTS, "cost", "audit"])

    conv_type = None
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for part in batch.to_pylist():
            if total is not None and part["conv_id"] == conv:
                total["illegal"] += not _LEGAL[total["last"], part["first"]]
                total["turns"] -= part["turns"] > 0 and total["most"] == part["least"]
                for name in [*COUNTS, "turns"]:
                    total[name] += part[name]
                total["last"] = part["last"]
                if part["turns"]:
                    total["least"] = part["least"] if total["least"] is None else total["least"]
                    total["most"] = part["most"]
            else:
                if total is not None:
                    yield close(conv_type)
                conv, total, row = part["conv_id"], part, UNIT[0]
            matrix: Matrix = [{} for _ in range(4)]
            for way in part["ways"]:
                matrix[way["i"]][way["j"]] = (way["cost"], Rope(way["audit"]))
            row = product([row], matrix)[0]
    if total is not None:
        yield close(conv_type)


# --- rows -----------------------------------------------------------------
ORDER = ["conv_id", "turn", "role", "h1", "h2"]


def _rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, text): null roles and texts are one space; the hashes stand for the text."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("h1"),
                       F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Join on columns of one name, null being equal to null; the right side's columns of the key go."""
    right = right.withColumnsRenamed({c: f"{c}_right" for c in columns})
    on = [left[c].eqNullSafe(right[f"{c}_right"]) for c in columns]
    return left.join(right, on, "left").drop(*[f"{c}_right" for c in columns])


def first_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, n, initial, fault): distinct rows and their numbers, without texts.

    A row is a duplicate where its role and text stand in an earlier turn; of
    ``n`` equal rows of one turn the first is not.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select(*ORDER, (F.length(F.btrim("text", F.lit(BLANKS))) == 0).alias("blank"),
                       (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("cut"))
    distinct = rows.groupBy(*ORDER, "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    said = ["conv_id", "role", "h1", "h2"]
    # A null turn comes before any other.
    firsts = rows.groupBy(*said).agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"))
    part = F.pmod(F.xxhash64("turn"), F.lit(PARTS))
    distinct = distinct.withColumn("part", part)
    firsts = _same(rows.select(*said, part.alias("part")).distinct(), firsts, said)
    found = _same(distinct, firsts, [*said, "part"])
    first = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(OTHER))
    fault = (F.when(F.col("blank"), BLANK).when(~first, DUPLICATE).when(F.col("cut"), CUT).otherwise(NONE))
    return found.select(*ORDER, "n", initial.alias("initial"), fault.alias("fault"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``_rows``."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    ordered = bounded_batches(first_faults(rows)).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    parts = stored(ordered.mapInArrow(_parts, f"conv_id {conv_type}, {PART_DDL}"), "conversation-parts")
    whole = parts.where(~F.col("open"))
    way = F.element_at("ways", 1)
    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(0).cast("long")
    whole = whole.select("conv_id", gaps.alias("gaps"), *COUNTS, way["cost"].alias("cost"), way["audit"].alias("audit"))
    place = ["conv_id", "task", "number"]
    cut = (bounded_batches(parts.where("open")).repartition("conv_id").sortWithinPartitions(*place)
           .mapInArrow(_summary, f"conv_id {conv_type}, {SUMMARY_DDL}"))
    return whole.unionByName(cut)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit rows, each followed by the rows of its conversation in order: the rows that stay or are put in."""
    conv, audit, at, state, position, started = None, "", 0, START, 0, False
    out: list[tuple] = []

    def put_in() -> None:
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            state = AFTER_A if state == AFTER_U else AFTER_U
            out.append((conv, position, "I", None, ASSISTANT if state == AFTER_A else USER, ""))
            at, position = at + 1, position + 1

    def made(conv_type) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*out) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["conv_id", "position", "edit", "turn", "role", "text"])

    conv_type = None
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for piece in slices(batch, "text", 1 << 20):
            columns = (piece.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text"))
            for name, given, turn, role, text in zip(*columns):
                if given is not None:
                    if started:
                        put_in()
                    conv, audit, at, state, position, started = name, given, 0, START, 0, True
                    continue
                put_in()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = ASSISTANT if state == AFTER_U else USER
                state = NEXT[INITIALS.index(role[0])][state]
                out.append((conv, position, edit, turn, role, text))
                position += 1
            yield made(conv_type)
            out = []
    if started:
        put_in()
        yield made(conv_type)


def _repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` after the edits of ``found``: every conversation follows its audit, in order, in one partition."""
    none = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c != "conv_id"}
    heads = found.select("conv_id", F.col("audit"), *[v.alias(c) for c, v in none.items()], F.lit(0).alias("kind"))
    both = heads.unionByName(rows.select("*", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind")))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return (bounded_batches(both).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
            .select("conv_id", "audit", "turn", "role", "text")
            .mapInArrow(_edited, f"conv_id {conv_type}, position long, edit string, turn long, role string, text string"))


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired) of rows (conv_id, turn, role, text).

    Summary: (conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit), a row per conversation. Repaired: (conv_id, position, edit, turn,
    role, text), the rows that stay (K), those with another role (R) and those
    put in (I), which have no turn; rows of a conversation stand in order in
    one partition.

    Rows go by turn, a null turn first; rows of one turn by role, then by a
    hash of their text, equal rows side by side. A null role or text is one
    space; such a role, like any that does not begin with s, u or a, cannot be
    kept. Rows without conv_id are one conversation. Further columns are not
    looked at; empty tables give empty results.
    """
    rows = _rows(conversations)
    summary = stored(audits(rows), "conversation-audits")
    return summary, _repaired(rows, summary)


# --- query ----------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the planted damage: one in twenty each dropped, emptied, cut, repeated, or of another role."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    hit = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.when(hit == 4, USER).otherwise(role).alias("role"),
                                F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
                                .alias("text"),
                                F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
                                (hit == 0).alias("lost"))
    return rows.where(~F.col("lost")).select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of role:text lines, row by row; rows of a conversation stand together."""
    conv, sha, begun = None, None, False

    def made(names, values, conv_type) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, conv_type), pa.array(values, pa.string())],
                                          ["conv_id", "repaired_sha256"])

    conv_type = None
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        names, values = [], []
        for name, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
            if position == 0:
                if begun:
                    names.append(conv)
                    values.append(sha.hexdigest())
                conv, sha, begun = name, hashlib.sha256(), True
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield made(names, values, conv_type)
    if begun:
        yield made([conv], [sha.hexdigest()], conv_type)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its faults, the cost and letters of its repair and the digest of what comes out."""
    source = table(spark, sf_dir, "conversations")
    summary, repaired = repair_conversations(damaged(source))
    conv_type = source.schema["conv_id"].dataType.simpleString()
    digests = repaired.mapInArrow(_digests, f"conv_id {conv_type}, repaired_sha256 string")
    out = _same(_same(source.select("conv_id").distinct(), summary, ["conv_id"]), digests, ["conv_id"])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *COUNTS, "cost"]]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
