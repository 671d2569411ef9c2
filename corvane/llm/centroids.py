"""Centroid clustering with the exponion search: Lloyd rounds whose vectors look only inside a ball around their centroid.

A vector carries its centroid, an upper bound on the distance to it and a lower bound on the distance to any other. When the bounds
don't settle that its centroid is strictly the nearest, the upper bound is made exact, and if that doesn't settle it either, the
centroids within 2 * upper + gap of its own are looked at, where gap is the distance to the own centroid's nearest neighbour: that ball,
rim included, holds the nearest and the second nearest centroid. Each centroid's list of the others, sorted by distance, gives the ball
as a prefix. Distances are squared integers, so ties are exact and go to the smaller number; bounds are rounded outwards.

The vectors with their bounds are a table in the shared folder, written anew in each round, so a lost executor costs one
round's tasks. What travels is the centroids and, back, their sums: ``k`` rows, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, extend

#: Roots and sums of doubles are wrong by less than these shares.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def squared(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = rows - centre
    return (d * d).sum(1)


class Centroids:
    """Integer centroids, their sorted lists of distances, and how far they moved from those before."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        square = np.stack([squared(at, c) for c in at])
        self.order = np.argsort(square, axis=1, kind="stable")
        # the own centroid first, even where another lies on it
        self.order = np.array([[i, *[j for j in row if j != i]] for i, row in enumerate(self.order.tolist())]).reshape(k, k)[:, 1:]
        self.apart = np.sqrt(np.take_along_axis(square, self.order, 1)) if k > 1 else np.full((k, 1), np.inf)
        self.gap = self.apart[:, 0]
        moved = np.zeros(k) if before is None else np.sqrt(((at - before) ** 2).sum(1)) * UP
        self.moved, self.most_moved = moved, moved.max(initial=0.0)

    def full(self, x: np.ndarray):
        """(centroid, upper, lower) by looking at all centroids, as the first round must."""
        square = np.stack([squared(x, c) for c in self.at], 1)
        own = square.argmin(1)
        upper = np.sqrt(square[np.arange(len(x)), own])
        square[np.arange(len(x)), own] = np.iinfo(np.int64).max
        lower = np.sqrt(square.min(1)) if len(self.at) > 1 else np.full(len(x), np.inf)
        return own.astype(np.int32), upper * UP, lower * DOWN

    def search(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(centroid, upper, lower, looked) after the centroids have moved; ``looked`` counts distances that were computed."""
        own, upper = own.copy(), (upper + self.moved[own]) * UP
        lower = (lower - self.most_moved) * np.where(lower > self.most_moved, DOWN, UP)
        looked = 0
        open_ = np.nonzero(upper >= np.maximum(lower, self.gap[own] * (DOWN / 2)))[0]
        if len(open_):
            exact = ((x[open_] - self.at[own[open_]]) ** 2).sum(1)
            looked += len(open_)
            upper[open_] = np.sqrt(exact) * UP
            still = upper[open_] >= np.maximum(lower[open_], self.gap[own[open_]] * (DOWN / 2))
            open_, exact = open_[still], exact[still]
        had = own[open_]
        for c in np.unique(had) if len(self.at) > 1 else ():
            here = np.nonzero(had == c)[0]
            rows = open_[here]
            radius = (2 * upper[rows] + self.gap[c] * UP) * UP
            inside = np.searchsorted(self.apart[c], radius, side="right")  # on the rim counts
            best, at, second = exact[here].copy(), np.full(len(rows), c, np.int64), np.full(len(rows), np.iinfo(np.int64).max)
            for place in range(int(inside.max())):
                j = self.order[c, place]
                near = np.nonzero(inside > place)[0]
                d = squared(x[rows[near]], self.at[j])
                looked += len(near)
                won = (d < best[near]) | ((d == best[near]) & (j < at[near]))
                second[near] = np.where(won, best[near], np.minimum(second[near], d))
                best[near], at[near] = np.where(won, d, best[near]), np.where(won, j, at[near])
            own[rows], upper[rows] = at, np.sqrt(best) * UP
            lower[rows] = np.sqrt(second) * DOWN
        return own, upper, lower, looked


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has exactly ``width`` entries and all of them are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & ~F.coalesce(bad, F.lit(False))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; rows of one id order by their vector. Null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    few = rows.select(key.alias("h"), "_x").orderBy(F.col("h").asc_nulls_last(), "_x").limit(k)
    return np.array([r._x for r in few.collect()], np.int64)


def moved(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean, by exact integer sums; empty ones stay."""
    out = centres.copy()
    for r in state.groupBy("_c").agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(centres.shape[1])]).collect():
        out[r._c] = [r[f"s{i}"] // r.n for i in range(centres.shape[1])]
    return out


def _matrix(batch) -> np.ndarray:
    column = batch.column("_x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row for each kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``width`` entries, none null or non-finite; others, null and empty vectors among them, have no row.
    An entry counts as floor(scale * entry); squared distances must stay below 2**63. With fewer than ``k`` kept vectors there are as
    many centroids as vectors; without any the result is empty. Repeated rows count and are returned as often as they occur; centroids
    may coincide, and then the smaller number takes the vectors. Rows with a null id are clustered like others but become first
    centroids last. Columns other than the two named are not read, so they may have any name.
    """
    scratch = Scratch(rows.sparkSession, "centroids")
    kept = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(usable(F.col("_v"), width))
    kept = kept.select("_id", F.transform("_v", lambda c: F.floor(c.cast("double") * scale)).alias("_x"))
    centres = first_centroids(kept, k, seed)
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(centres):
        return kept.limit(0).select("_id", F.lit(0), *[F.lit(0).cast("long")] * 3, F.lit("")).toDF(*names)
    before, state = None, kept
    for turn in range(rounds + 1):
        found = Centroids(centres, before)

        def start(found=found, first=turn == 0, last=turn == rounds):
            def make(batch):
                x = _matrix(batch)
                if first:
                    c, upper, lower = found.full(x)
                else:
                    c, upper, lower, _ = found.search(x, *[batch.column(n).to_numpy() for n in ("_a", "_u", "_l")])
                return [c, ((x - found.at[c]) ** 2).sum(1)] if last else [c, upper, lower]

            return make

        done = turn == rounds
        new = "_c int, _d long" if done else "_c int, _u double, _l double"
        state = scratch.table(f"round-{turn}", extend(state, new, start, drop=("_a", "_u", "_l") + ("_x",) * done))
        if turn:
            scratch.drop(f"round-{turn - 1}")
        if not done:
            before, centres = centres, moved(state, centres)
            state = state.withColumnRenamed("_c", "_a")
    sums = {r._c: r.s for r in state.groupBy("_c").agg(F.sum("_d").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = F.array(*[F.struct(F.lit(sums.get(i, 0)).cast("long").alias("s"), F.lit(h).alias("h")) for i, h in enumerate(digests)])[F.col("_c")]
    return state.select("_id", "_c", "_d", of.s, F.lit(sum(sums.values())).cast("long"), of.h).toDF(*names)


def oracle_sql(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same rounds for DuckDB: every vector against every centroid."""
    near = (
        "SELECT v.row, v.vec_id, v.x, min_by(c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 1000 + c.c) AS c, "
        "min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM kept v, {c} c GROUP BY ALL"
    )
    steps = [
        f"kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {scale}) AS BIGINT)) AS x FROM embeddings "
        f"WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS ({near.format(c=f'c{i}')})")
        steps.append(f"s{i} AS (SELECT c, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM a{i}, range(1, {width + 1}) r(i) GROUP BY c, i)")
        steps.append(f"m{i} AS (SELECT c, list(v ORDER BY i) AS x FROM s{i} GROUP BY c)")
        steps.append(f"c{i + 1} AS (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c))")
    steps.append(f"last AS ({near.format(c=f'c{rounds}')})")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM last l JOIN c{rounds} c ON l.c = c.c"
    )
