"""The whole bootstrap: 10,000 resamples of twelve systems with intervals, against brute force."""

import hashlib

import numpy as np
import pytest

import __spark_entry__
from treemill.operators import stats
from treemill.plans import stats_queries as sq

ALL = ["tokens", *sq.COLUMNS[0], *sq.COLUMNS[1]]


def brute(values, resamples, seed=sq.SEED):
    n = len(values)
    at = lambda b, i: int(hashlib.md5(f"{seed}-{b}-{i}".encode()).hexdigest()[:8], 16) % n
    return np.array([values[[at(b, i) for i in range(n)]].sum(axis=0) for b in range(resamples)])


def fixture(spark, n=12):
    rng = np.random.default_rng(5)
    tokens = rng.integers(3, 20, n)
    right = np.array([[rng.integers(0, t + 1) if c % 6 else t for c in range(12)] for t in tokens])
    values = np.column_stack([tokens, right])
    rows = [(f"s{k:02d}", *map(int, row)) for k, row in enumerate(values)]
    return values, sq.number(spark.createDataFrame(rows, "sent_id string, " + ", ".join(f"{c} long" for c in ALL)), "sent_id")


@pytest.mark.parametrize("seed, resample, n", [(42, 0, 1), (42, 9_999, 11), (42, 123, 1_205), (7, 1_000, 20_001)])
def test_draws_are_the_hashed_ones(seed, resample, n):
    want = [int(hashlib.md5(f"{seed}-{resample}-{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
    assert stats.draws(seed, resample, n, {}).tolist() == want


def test_whole_pairs_equal_brute_force(spark):
    values, numbered = fixture(spark)
    sums = brute(values, sq.WHOLE_RESAMPLES)
    got = sq.whole_pairs(numbered).collect()
    assert len(got) == 30 and {r.resamples for r in got} == {10_000} and sum(r.primary for r in got) == 4
    scores = sums[:, 1:] / sums[:, :1]
    for r in got:
        a, b = (6 * r.model_ord + int(s[1:]) for s in (r.first, r.second))
        delta = scores[:, a] - scores[:, b]
        low, high = (delta <= 0).sum(), (delta >= 0).sum()
        assert (r.at_or_below, r.at_or_above) == (low, high) and r.p == pytest.approx(min(1.0, 2 * (min(low, high) + 1) / 10_001))
        assert [r.ci_low, r.ci_high] == pytest.approx(np.percentile(delta, [2.5, 97.5]).tolist(), abs=1e-12)
        assert r.difference == pytest.approx((values[:, 1 + a].sum() - values[:, 1 + b].sum()) / values[:, 0].sum())
    assert min(r.p for r in got) * 15 < 0.05  # a pair can be significant after Holm's correction


def test_matrix_and_join_agree(spark, monkeypatch):
    values, numbered = fixture(spark)
    rows = lambda: sorted(map(tuple, stats.resample_matrix(numbered, ALL, 40, 42).collect()))
    matrix = rows()
    monkeypatch.setattr(stats, "MATRIX_ROWS", 0)
    assert matrix == rows() and [list(r[1:]) for r in matrix] == brute(values, 40).tolist()


def test_registered_without_sql():
    names = {f"{n}_whole" for n in ("bootstrap_scores", "bootstrap_pairs", "bootstrap_unsmoothed", "holm_within", "holm_primary")}
    assert names <= set(__spark_entry__.queries()) and not names & set(__spark_entry__.oracle_sql()) and sq.WHOLE_RESAMPLES == 10_000
