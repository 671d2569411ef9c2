"""Whitening and centroid clustering against plain numpy, and their odd cases."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import catalogue, centroids, whitening
from corvane.llm.centroids import Centroids

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, `_x` string, `_v` int, cluster string, n int, d string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", 1, "b", 2, "c") for i, v in rows], SCHEMA)


def plain_whitening(rows):
    """(ids, deviation, whitened up to sign, explained) of kept rows."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept])
    n, total = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x]
    centred = (n * x - total) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return [i for i, _ in kept], deviation, centred @ u / np.sqrt(e), e / (np.var(x, axis=0).sum())


def check_whitening(rows, got, components):
    ids, deviation, z, explained = plain_whitening(rows)
    found = defaultdict(list)
    for r in got:
        assert r.n == len(ids) and r.identity_error <= 1e-4
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9
        found[r.component].append((-1 if r.vec_id is None else r.vec_id, int(r.deviation), r.whitened))
    assert sorted(found) == list(range(1, components + 1))
    for c, values in found.items():
        want = [(-1 if i is None else i, d, w) for i, d, w in zip(ids, deviation, z[:, c - 1])]
        same = lambda sign: np.abs(np.array(sorted(values), float) - np.array(sorted((i, d, sign * w) for i, d, w in want), float))[:, 2].max()  # noqa: E731, B023
        assert sorted(v[:2] for v in values) == sorted(w[:2] for w in want)
        assert min(same(1), same(-1)) < 1e-7


def test_whitening_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check_whitening(rows, catalogue.op11_whitening(spark, FOLDER).collect(), 8)


def test_whitening_odd(spark):
    """Nulls, non-finite entries, repeated rows, a null id, a constant dimension, offsets far above the spread, fewer dimensions than components."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(900 + a), 0.5, float(a / 64), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    rows += [(None, [900.0, 0.5, 0.25, 0.0]), (7, [901.0, 0.5, 0.0, 1.0]), (7, [901.0, 0.5, 0.0, 1.0]), (70, None), (71, [])]
    rows += [(72, [1.0, None, 0.0, 0.0]), (73, [float("nan"), 0.0, 0.0, 0.0]), (74, [0.0, float("-inf"), 0.0, 0.0])]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.vec_id for r in found} == {None, *range(60)}
    check_whitening(rows, found, 3)
    assert sum(r.vec_id == 7 and r.component == 1 for r in found) == 3


def test_whitening_nothing(spark):
    """Empty tables, tables without a usable vector and equal vectors have no components; widths that differ are refused."""
    for rows in ([], [(1, None), (2, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        found = whitening.whiten(vectors(spark, rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0
    with pytest.raises(ValueError, match="several widths"):
        whitening.whiten(vectors(spark, [(1, [0.5]), (2, [0.5, 0.5])]))


def test_deviation_is_exact_at_any_size():
    """The three ways of adding squares, up to sums that no long holds."""
    rng = np.random.default_rng(1)
    for size in (10, 10**5, 10**8, 10**11):
        x = rng.integers(-size, size, (20, 6))
        for n in (20, 3 * 10**6):
            sums = [int(v) * n // 20 for v in x.sum(0)]
            w = whitening.Whitening(n, sums, np.zeros((0, 6)), np.zeros(0))
            assert w.exact_deviation(x) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]


def plain_clusters(x, first, rounds):
    """Final assignment and centroids, by every distance."""
    centres = x[first].copy()
    for turn in range(rounds + 1):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if turn < rounds:
            for c in range(len(centres)):
                if (own == c).any():
                    centres[c] = x[own == c].sum(0) // (own == c).sum()
    return own, centres


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 3), st.integers(1, 3), st.integers(0, 2**32 - 1))
def test_exponion_equals_all_distances(k, width, spread, seed):
    """Small grids are full of ties, coinciding centroids and vectors on the ball's rim."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (40, width))
    centres = x[rng.choice(40, k, replace=False)]
    found = Centroids(centres)
    own, upper, lower = found.full(x)
    for _ in range(5):
        square = ((x[:, None] - found.at[None]) ** 2).sum(2)
        assert (own == square.argmin(1)).all()
        assert (upper >= np.sqrt(square[np.arange(40), own])).all()
        others = np.where(np.arange(k) == own[:, None], np.inf, square)
        assert (lower <= np.sqrt(others.min(1))).all()
        after = found.at + rng.integers(-1, 2, found.at.shape)
        found = Centroids(after, found.at)
        own, upper, lower, _ = found.search(x, own, upper, lower)


def test_exponion_looks_at_fewer():
    """Far clusters: after the first round, nearly no distance beyond the own centroid's is computed."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-5000, 5000, (16, 8))
    x = np.concatenate([m + rng.integers(-20, 21, (200, 8)) for m in middle])
    found = Centroids(middle)
    state = found.full(x)
    found = Centroids(middle + 3, middle)
    *state, looked = found.search(x, *state)
    assert looked <= len(x) < 16 * len(x) and (state[0] == np.repeat(np.arange(16), 200)).all()


def test_clusters_odd(spark):
    """Only whole vectors of the width count; repeated rows and ids, a null id, fewer vectors than centroids, clashing names."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.normal(size=4)]) for i in range(50)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (60, None), (61, []), (62, [1.0] * 3), (63, [1.0, None, 1.0, 1.0]), (64, [1.0, 1.0, 1.0, float("inf")])]
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 4 and i not in (63, 64)]
    x = np.array([[math.floor(64 * float(np.float32(c))) for c in v] for _, v in kept])
    key = lambda j: (kept[j][0] is None, hashlib.sha256(f"1:{kept[j][0]}".encode()).hexdigest(), x[j].tolist())
    for k in (5, 100):
        own, centres = plain_clusters(x, sorted(range(len(kept)), key=key)[:k], 3)
        d = ((x - centres[own]) ** 2).sum(1)
        digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
        want = [(i or -1, c, e, d[own == c].sum(), d.sum(), digest[c]) for (i, _), c, e in zip(kept, own, d)]
        got = centroids.cluster(vectors(spark, rows), k=k, width=4).collect()
        assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)
    assert centroids.cluster(vectors(spark, []), width=4).count() == 0
    assert centroids.cluster(vectors(spark, rows), width=7).collect() == []


def test_clusters_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{FOLDER}/embeddings.parquet')")
    want = con.execute(catalogue.ORACLE_SQL["op13_centroids"]).fetchall()
    assert sorted(map(tuple, catalogue.op13_centroids(spark, FOLDER).collect())) == sorted(want) and len(want) == 500
