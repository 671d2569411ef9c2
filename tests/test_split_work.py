"""Work that is split over tasks and must give what one loop gives: the seeded bootstrap, and dense search by blocks in one scan."""

import numpy as np
import pytest

from corvane.operators import dense, statistics


@pytest.mark.parametrize(("n", "resamples"), [(1, 40), (2, 40), (7, 300), (64, 100), (1000, 150)])
def test_bootstrap_equals_one_loop(spark, n, resamples, monkeypatch):
    """Bit for bit, for several groups, sizes that are and aren't powers of two, and stretches that hold few draws."""
    monkeypatch.setattr(statistics, "OUTPUTS", 97)
    rng = np.random.default_rng(n)
    groups = {"a": rng.normal(size=n), "b": rng.normal(size=max(1, n // 2))}
    rows = [(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)]
    table = spark.createDataFrame(rows[::-1], "system string, qid int, x double")
    got = {r.system: (r["mean"], r.lo, r.hi) for r in statistics.bootstrap_ci_numpy(table, "x", "system", resamples, tasks=7).collect()}
    for g, v in groups.items():
        loop = np.random.default_rng(42)
        means = np.array([loop.choice(v, size=len(v), replace=True).mean() for _ in range(resamples)])
        assert got[g] == (v.mean(), *np.percentile(means, [(1 - 0.95) / 2 * 100, (1 + 0.95) / 2 * 100]))


@pytest.mark.parametrize("n", [3, 1000, 3 * 10**9, 2**31 + 1])
def test_turned_down_words(n):
    """Near 2**32 a third of the words is turned down and drawn again; the words that remain are numpy's draws."""
    want = np.random.Generator(np.random.PCG64(5)).integers(0, n, 4000)
    words = statistics._words(5, 0, 6000)
    taken = statistics._accepted(5, n, 0, 6000)
    assert ((words[taken] * np.uint64(n)) >> np.uint64(32))[:4000].tolist() == want.tolist()
    for word in (0, 1, 2, 777):
        assert statistics.generator_at(5, word).integers(0, 2**32, 3, np.uint32).tolist() == words[word : word + 3].tolist()


def test_bootstrap_without_values(spark):
    assert statistics.bootstrap_ci_numpy(spark.createDataFrame([], "s string, qid int, x double"), "x", "s", 10).count() == 0


def test_bootstrap_uses_several_tasks(spark):
    """The resamples of one group begin at several places."""
    starts = statistics._first_words(spark, [50], 1000, 42, 8)[50]
    assert len(starts) == 8 and starts[0] == (0, 125, 0) and starts[-1][1] == 1000 and all(w == a * 50 for a, _, w in starts)


def test_one_scan_equals_blocks(spark, monkeypatch):
    """Vectors of two lengths, nulls, ties, repeated rows; what a task holds at once doesn't matter; without Arrow's file systems the driver's way is taken."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 4 if i % 5 else 3).astype(float).tolist()) for i in range(120)] + [(7, [1.0] * 4), (7, [1.0] * 4), (None, [1.0] * 4), (200, None), (201, [])]
    table = spark.createDataFrame(rows, "did long, v array<float>").repartition(3)
    asked = table.filter("did % 2 = 0").selectExpr("did AS qid", "v AS w")

    def found(block):
        got = dense.search(table, "did", "v", asked.filter("size(w) = 4"), "qid", "w", 3, True, block)
        return sorted((r.qid, r.did, r.score, r["rank"]) for r in got.collect())

    want = found(1000)
    assert len(want) == 3 * 48
    assert found(5) == want
    monkeypatch.setattr(dense, "HELD", 1)
    monkeypatch.setattr(dense, "SCORES", 8)
    assert found(5) == want
    scans = dense.search(table, "did", "v", asked, "qid", "w", 3, True, 5)
    assert len(scans.inputFiles()) == 0 and {r.qid for r in scans.collect()} == {i for i in range(0, 120, 2)}  # no table of a block's results
    monkeypatch.setattr(dense, "reachable", lambda path: False)
    assert found(5) == want
