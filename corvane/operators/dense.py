"""Exact inner-product search: blocks of queries against all vectors, as matrix products over Arrow batches.

Up to ``block`` queries (a few megabytes) go to the tasks with the function. More of them are written to the shared folder in blocks: each task
holds its vectors and reads block after block there, so the corpus is scanned once however many queries there are, and no query
comes to the driver. Each task keeps its best ``k`` for a query before the shuffle, so what is shuffled is tasks * queries * k rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let
from corvane.scratch import Scratch

#: Scores that a task holds at once: 16 MB.
SCORES = 1 << 21


def normalize(vector: Column) -> Column:
    """With a Euclidean length of 1; a zero vector stays."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = lambda v: let(length(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return let(vector, scaled)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, normalised; the weight is at least 1e-9."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    size = F.size(vectors[0])
    zero = F.transform(F.sequence(F.lit(1), size), lambda _: F.lit(0.0))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return normalize(F.transform(total, lambda x: x / weight))


def search(corpus: DataFrame, did: str, vector: str, queries: DataFrame, qid: str, query_vector: str, k: int = 10, skip_self: bool = False, block: int = 4096) -> DataFrame:
    """(qid, did, score, rank): the best ``k`` rows for every query by inner product, then id.

    Vectors of another length than the query's and null ones are left out. With ``skip_self``, a row
    isn't its own neighbour. Scores are rounded to six places before they are ranked.
    """
    asked = queries.select(F.col(qid).cast("long").alias("qid"), F.col(query_vector).alias("v")).filter("qid IS NOT NULL AND v IS NOT NULL")
    total = asked.count()
    parts = total // block + 1
    scratch = Scratch(corpus.sparkSession, "dense")
    rows = corpus.select(F.col(did).cast("long").alias("did"), F.col(vector).alias("v")).filter("did IS NOT NULL AND v IS NOT NULL")
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("did", T.LongType()), T.StructField("score", T.DoubleType())])
    found = None
    if parts > 1 and reachable(scratch.path):
        found = rows.mapInArrow(_against_files(_query_files(asked, scratch, parts), k, skip_self, block), schema)
    for part in range(parts if found is None else 0):
        held = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).collect()
        if not held:
            continue
        width = len(held[0].v)
        held = [r for r in held if len(r.v) == width]
        ids, matrix = np.array([r.qid for r in held]), np.array([r.v for r in held], np.float64)

        def best(batches, ids=ids, matrix=matrix, width=width):
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held_rows = 0
            for batch in batches:
                vectors = batch.column("v")
                fits = np.diff(vectors.offsets.to_numpy()) == width
                every = batch.column("did").to_numpy()[fits]
                values = pa.ListArray.from_arrays(vectors.offsets, vectors.values).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
                values = values.astype(np.float64).reshape(-1, width)
                step = max(k + 1, SCORES // len(ids))  # rows whose scores are held at once
                for at in range(0, len(every), step):
                    own = every[at : at + step]
                    score = np.round(values[at : at + step] @ matrix.T, 6)
                    if skip_self:
                        score[own[:, None] == ids] = -np.inf
                    if len(own) > k:  # all that reach the k-th best score, ties too
                        good = score >= np.partition(score, len(own) - k, axis=0)[len(own) - k]
                    else:
                        good = np.ones(score.shape, bool)
                    row, q = np.nonzero(good & np.isfinite(score))
                    kept.append((ids[q], own[row], score[row, q]))
                    held_rows += len(row)
                    if held_rows > 4 * k * len(ids):
                        kept, held_rows = [_trim(kept, k)], 0
            if kept:
                q, d, s = _trim(kept, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["qid", "did", "score"])

        here = rows.mapInArrow(best, schema)
        if parts > 1:
            here = scratch.table(f"block-{part}", here)
        found = here if found is None else found.union(here)
    if found is None:
        found = rows.limit(0).selectExpr("did AS qid", "did", "CAST(0 AS double) AS score")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "did")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Bytes of vectors that a task holds while it reads all queries.
HELD = 64 << 20


def reachable(path: str) -> bool:
    """Whether Arrow's file systems know the shared folder's kind. Where they don't, queries go through the driver, a block and a scan at a time."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _query_files(asked: DataFrame, scratch: Scratch, parts: int) -> list[str]:
    """The queries in shared files, about one block each."""
    return sorted(scratch.table("queries", asked.repartition(parts, "qid")).inputFiles())


def _by_width(ids: np.ndarray, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = {}
    for width in np.unique(lengths).tolist():
        fits = pa.array(lengths == width)
        values = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False)
        out[width] = ids[lengths == width], values.astype(np.float64).reshape(int((lengths == width).sum()), width)
    return out


def _against_files(files: list[str], k: int, skip_self: bool, block: int):
    """The function of a task: its vectors, at most ``HELD`` bytes at once, against the blocks in the files one after another."""

    def blocks():
        for path in files:
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as file:
                for batch in pq.ParquetFile(file).iter_batches(block):
                    yield batch.column("qid").to_numpy(), batch.column("v")

    def best_of(held: list):
        every = np.concatenate([b.column("did").to_numpy() for b in held])
        corpus = _by_width(every, pa.concat_arrays([b.column("v") for b in held]))
        for qids, vectors in blocks():
            for width, (ids, matrix) in _by_width(qids, vectors).items():
                if width not in corpus:
                    continue
                kept, (own, values) = [], corpus[width]
                step = max(k + 1, SCORES // len(ids))
                for at in range(0, len(own), step):
                    score = np.round(values[at : at + step] @ matrix.T, 6)
                    if skip_self:
                        score[own[at : at + step, None] == ids] = -np.inf
                    good = np.isfinite(score)
                    if len(score) > k:  # all that reach the k-th best score, ties too
                        good &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k]
                    row, q = np.nonzero(good)
                    kept.append((ids[q], own[at : at + step][row], score[row, q]))
                    if len(kept) > 8:
                        kept = [_trim(kept, k)]
                if kept:
                    q, d, s = _trim(kept, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["qid", "did", "score"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD:
                yield from best_of(held)
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield from best_of(held)

    return run


def _trim(kept, k: int):
    """The best ``k`` of each query among the kept ones."""
    q, d, s = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    first = np.searchsorted(q, q, "left")
    good = np.arange(len(q)) - first < k
    return q[good], d[good], s[good]
