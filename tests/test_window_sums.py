"""Sums of windows are looked up in their cells: no window is joined with its places."""

import numpy as np
import pytest

from locusforge.operators import batch_locus as B
from locusforge.operators import window_sums as W

LOCI = "locus_id string, chrom string, start bigint, end bigint"
LONG = np.iinfo(np.int64)


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def _counted(windows, places, n_kinds):
    """Every window against every place."""
    sums, least = np.zeros((len(windows), n_kinds), np.int64), np.full(len(windows), W.NO_VALUE)
    for i, (group, start, end) in enumerate(windows):
        for own, place, before, kind, rows, pvalue in places:
            if own == group and start <= place <= end:
                if before is None or before < start:
                    sums[i, kind] += rows
                if kind == 0:
                    least[i] = min(least[i], pvalue)
    return sums, least


@pytest.mark.parametrize("far", [0, 2 ** 62])
def test_a_slice_against_every_pair(far):
    rng = np.random.default_rng(5)
    windows = sorted((int(g), int(s), int(s + n)) for g, s, n in zip(
        rng.integers(0, 4, 70) * 3, rng.integers(-50, 50, 70), rng.integers(0, 40, 70)))
    windows += [(20, LONG.min, LONG.max), (20, far, far)]
    places = [(int(g), int(p), None if d > 60 else int(p - d), int(k), int(n), int(v)) for g, p, d, k, n, v in zip(
        rng.choice([0, 3, 5, 6, 9, 20], 400), rng.integers(-60, 80, 400), rng.integers(1, 90, 400), rng.integers(0, 3, 400),
        rng.integers(1, 9, 400), rng.integers(-5, 5, 400))]
    places += [(20, far, LONG.min, 0, 1, 3), (20, LONG.min, None, 0, 1, 4), (20, far, None, 1, 2, 0)]
    group, start, end = (np.array(x, np.int64) for x in zip(*windows))
    at, place, before, kind, rows, pvalue = zip(*places)
    arrays = [np.array(x, np.int64) for x in (at, place, [b or 0 for b in before])]
    got = W.slice_sums(group, start, end, *arrays, np.array([b is None for b in before]),
                       *[np.array(x, np.int64) for x in (kind, rows, pvalue)], 3)
    want = _counted(windows, places, 3)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_numbers_keep_their_order_as_longs():
    numbers = np.array([-np.inf, -3.5, -0.0, 0.0, 5e-324, 1e-9, 1.0, np.inf, np.nan])
    longs = W.ordered(numbers, np.zeros(len(numbers), bool))
    assert (np.diff(longs) > 0).all() and longs.max() < W.NO_VALUE
    np.testing.assert_array_equal(W.doubles_of(longs), numbers)
    assert W.ordered(np.array([1.0, -np.nan]), np.array([True, False])).tolist() == [W.NO_VALUE, longs[-1]]


@pytest.mark.parametrize("most", [1, 7, W.SLICE])
def test_slices_of_any_size_give_the_sums_of_the_pairs(spark, processed_rows, monkeypatch, most):
    """Windows and places of one cell over many slices, cells without windows or places, rows without a p-value."""
    monkeypatch.setattr(W, "_summed", lambda kinds, made=W._summed: made(kinds, most))
    rows = processed_rows(*[dict(
        idx=i, gene_id=f"G{i % 5}", ld_snp_rsID=None if i % 9 == 0 else f"rs{i % 11}", gwas_snp=f"rs{i % 3}", GRCh38_pos=700 * i,
        GRCh38_gene_start=3_000 * (i % 5) - 9_000, GRCh38_gene_end=3_000 * (i % 5), GRCh38_gwas_snp_pos=10 ** 6 * (i % 3),
        GRCh38_chrom="X" if i % 4 == 0 else "7", gwas_pvalue=[None, float("nan"), 0.0, i * 1e-9][i % 4]) for i in range(60)])
    loci = spark.createDataFrame([(f"{c}{s}+{n}", c, s, s + n) for c in ("7", "X", "9") for s in (-9_000, -1, 0, 6_300, 40_000, 10 ** 6)
                                  for n in (0, 2_000, 9_999, 90_000, 3_000_000)] + [(None, "7", 0, 700)], LOCI)
    want = B.locus_summary(B.batch_locus_rows(rows, loci))
    assert _rows(B.summarise(rows, loci)) == _rows(want) != []


def test_no_window_is_joined_with_its_places(ds):
    loci = B.loci_around_genes(ds.gene_dim, 100_000)
    plan = B.summarise(ds.membership, loci)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_lcell#" not in plan.split("MapInArrow")[0]
    assert not any("_lcell" in line for line in plan.splitlines() if "Join" in line)
