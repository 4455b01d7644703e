"""Sums of windows in their home cells, without a pair of window and place.

Each window of a cell and each of its places is one row; the rows of a cell
follow each other, windows first. A worker takes places a slice at a time and
looks all windows of the cell up in it: what starts before a window is counted
in a wavelet matrix (O(log windows) a place and window), the least p-value in a
table of powers of two. Only the windows of the cell at hand and one slice are
held, so time grows with places and windows, and memory with neither's product.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import schemas as S

# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a slice.
SLICE = 400_000
# A cell's number in the sort key; cells are at least 10,000 long, so no number has more bits.
CELL_BITS, WIDTH_BITS = 51, 5
# Stands for a p-value that is not there, above all that are.
NO_VALUE = np.iinfo(np.int64).max


def sort_key(chrom: Column, width: Column, cell: Column, widths: Sequence[int], place: bool) -> Column:
    """One long for chromosome table, cell width and cell, and in its lowest bit whether it is a place."""
    table = F.array_position(F.lit(S.BUILD_CHROMOSOMES), chrom)
    level = F.array_position(F.array(*[F.lit(w).cast("long") for w in widths]), width)
    number = cell.bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    cells = F.shiftleft(F.shiftleft(table, WIDTH_BITS).bitwiseOR(level), CELL_BITS).bitwiseOR(number)
    return F.shiftleft(cells, 1).bitwiseOR(F.lit(int(place)).cast("long"))


def sums_in_cells(places: DataFrame, windows: DataFrame, widths: Sequence[int], kinds: Sequence[str], parts: int) -> DataFrame:
    """(locus_id, kinds, _least): for every window the rows of each kind whose place is its first inside; the least p-value.

    ``places`` (chrom, _uwidth, _cell, _kind, _place, _before, _rows, gwas_pvalue) are copied to the cells of
    ``windows`` (``home_cells``); ``widths`` are the cell widths that windows may have. The first kind is that of
    rows: windows without any are left out, and p-values are those of its places.
    """
    id_type = windows.schema["locus_id"].dataType
    kind = F.array_position(F.lit(list(kinds)), F.col("_kind")).cast("int") - 1
    rows = places.select(
        sort_key(F.col("chrom"), F.col("_uwidth"), F.col("_cell"), widths, True).alias("key"),
        F.lit(None).cast(id_type).alias("locus_id"), F.col("_place").alias("first"), F.col("_before").alias("second"),
        kind.alias("kind"), F.col("_rows").alias("rows"), F.col("gwas_pvalue").cast("double").alias("pvalue"))
    own = windows.select(
        sort_key(F.col("_lchrom"), F.col("_lwidth"), F.col("_lcell"), widths, False).alias("key"), "locus_id",
        F.col("_ls").alias("first"), F.col("_le").alias("second"), F.lit(None).cast("int").alias("kind"),
        F.lit(None).cast("long").alias("rows"), F.lit(None).cast("double").alias("pvalue"))
    mixed = rows.unionByName(own).repartition(parts, F.shiftright("key", 1)).sortWithinPartitions("key")
    sums = ", ".join(f"{k} long" for k in kinds)
    return mixed.mapInArrow(_summed(list(kinds)), f"locus_id {id_type.simpleString()}, {sums}, _least double")


def count_to(values: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, bits: int) -> np.ndarray:
    """For each query the weights of ``values[left:right]`` that are at most ``most`` (a wavelet matrix, level by level)."""
    total = np.zeros(len(left), np.int64)
    for bit in reversed(range(bits)):
        ones = (values >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        sums = np.concatenate([[0], np.cumsum(np.where(ones, 0, weights))])
        over = (most >> bit) & 1 == 1
        total += np.where(over, sums[right] - sums[left], 0)
        left, right = (np.where(over, zeros[-1] + at - zeros[at], zeros[at]) for at in (left, right))
        values, weights = (np.concatenate([x[~ones], x[ones]]) for x in (values, weights))
    sums = np.concatenate([[0], np.cumsum(weights)])
    return total + sums[right] - sums[left]


def least_of(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each query the least of ``values[left:right]``, NO_VALUE where there is none."""
    found, size = np.full(len(left), NO_VALUE, np.int64), right - left
    step = 1
    while len(values) and step <= size.max(initial=0):
        own = np.flatnonzero((size >= step) & (size < 2 * step))
        found[own] = np.minimum(values[left[own]], values[right[own] - step])
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return found


def ordered(doubles: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Longs in the order of doubles, NaN above all numbers and NO_VALUE above it."""
    bits = np.where(np.isnan(doubles), np.nan, doubles).view(np.int64)
    return np.where(missing, NO_VALUE, bits ^ ((bits >> 63) & NO_VALUE))


def doubles_of(longs: np.ndarray) -> np.ndarray:
    return (longs ^ ((longs >> 63) & NO_VALUE)).view(np.float64)


def slice_sums(group: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, place: np.ndarray, before: np.ndarray,
               none_before: np.ndarray, kind: np.ndarray, rows: np.ndarray, pvalue: np.ndarray,
               n_kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums by window and kind, least p-value by window) of a slice of places.

    Windows are (group, start, end), places (at, place, before, ..): the group of each, ascending for windows.
    A place counts in a window of its group that it lies in and that starts after the place before it.
    """
    groups, own = np.unique(group, return_inverse=True)
    inside = np.searchsorted(groups, at)
    known = groups[np.minimum(inside, len(groups) - 1)] == at
    inside, place, before, none_before, kind, rows, pvalue = (
        x[known] for x in (inside, place, before, none_before, kind, rows, pvalue))
    # Positions by rank, so that group, kind and position make one long.
    ranks = np.unique(np.concatenate([place, before, start, end]))
    n = len(ranks)
    place, before, start, end = (np.searchsorted(ranks, x) for x in (place, before, start, end))
    key = (inside * n_kinds + kind) * n + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    # Of the windows of a group, sorted by start: how many start at or before the place before.
    starts = np.unique(own * n + start)
    first_start = np.searchsorted(starts, np.arange(len(groups)) * n)
    passed = np.where(none_before, 0, np.searchsorted(starts, inside * n + before, side="right") - first_start[inside])[order]
    number = np.searchsorted(starts, own * n + start) - first_start[own]
    bits = int(max(np.diff(np.append(first_start, len(starts))), default=0)).bit_length()
    base = ((own * n_kinds)[:, None] + np.arange(n_kinds)) * n
    left = np.searchsorted(key, (base + start[:, None]).ravel())
    right = np.searchsorted(key, (base + end[:, None]).ravel(), side="right")
    sums = count_to(passed, rows[order], left, right, np.repeat(number, n_kinds), bits).reshape(-1, n_kinds)
    return sums, least_of(pvalue[order], left[::n_kinds], right[::n_kinds])


def _summed(kinds: list[str], most: int = SLICE):
    """Rows in order of ``key`` -> the sums of each window, when its cell is through."""
    n_kinds = len(kinds)

    def numbers(table: pa.Table, name: str, fill) -> tuple[np.ndarray, np.ndarray]:
        column = table.column(name).combine_chunks()
        missing = column.is_null().to_numpy(zero_copy_only=False)
        return column.fill_null(fill).to_numpy(zero_copy_only=False), missing

    def out(ids, sums, least):
        found = sums[:, 0] > 0
        columns = [ids.filter(pa.array(found)), *(pa.array(sums[found, k]) for k in range(n_kinds)),
                   pa.array(doubles_of(least[found]), mask=least[found] == NO_VALUE)]
        return pa.RecordBatch.from_arrays(columns, names=["locus_id", *kinds, "_least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Windows of the cell at hand: cell, start, end, sums, least; and their ids.
        empty = np.zeros(0, np.int64)
        held, ids = (empty, empty, empty, np.zeros((0, n_kinds), np.int64), empty), None

        def taken(gathered):
            nonlocal held, ids
            table = pa.Table.from_batches(gathered)
            key = table.column("key").to_numpy()
            is_place = key & 1 == 1
            first, second = numbers(table, "first", 0)[0], numbers(table, "second", 0)
            own, cell = ~is_place, key >> 1
            n = int(own.sum())
            new = (cell[own], first[own], second[0][own], np.zeros((n, n_kinds), np.int64), np.full(n, NO_VALUE, np.int64))
            held = tuple(np.concatenate(x) for x in zip(held, new))
            more = table.column("locus_id").combine_chunks().filter(pa.array(own))
            ids = more if ids is None else pa.concat_arrays([ids, more])
            kind, rows, (pvalue, missing) = numbers(table, "kind", 0)[0], numbers(table, "rows", 0)[0], numbers(table, "pvalue", 0.0)
            if len(ids) and is_place.any():
                sums, least = slice_sums(*held[:3], cell[is_place], first[is_place], second[0][is_place], second[1][is_place],
                                         kind[is_place], rows[is_place], ordered(pvalue, missing)[is_place], n_kinds)
                held = (*held[:3], held[3] + sums, np.minimum(held[4], least))
            over = held[0] != cell[-1]
            if over.any():
                done = out(ids.filter(pa.array(over)), held[3][over], held[4][over])
                held, ids = tuple(x[~over] for x in held), ids.filter(pa.array(~over))
                return done
            return None

        gathered, n = [], 0
        for batch in batches:
            gathered.append(batch)
            n += batch.num_rows
            if n >= most:
                done, gathered, n = taken(gathered), [], 0
                if done is not None:
                    yield done
        if n:
            done = taken(gathered)
            if done is not None:
                yield done
        if ids is not None and len(ids):
            yield out(ids, *held[3:])
    return run
