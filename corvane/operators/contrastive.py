"""Training an encoder's projection on pairs with in-batch negatives: batches, the loss with its gradient, and the loop.

A text's features are hashed token counts (``plans.index.hashed_encoder``), and the encoder is a matrix over them. Each row of a batch takes the
other rows' positives as negatives, so no batch may hold two rows of one positive. Batches are rows of the shared folder; a step reads
them all, tasks add up the gradients of theirs, and the driver, which holds the matrix and nothing of the data, takes an Adam step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import Scratch


def _number(column: Column) -> Column:
    """The first 28 bits of a md5 digest, which any engine repeats."""
    return F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("long")


def in_batches(pairs: DataFrame, anchor: str, positive: str, size: int = 32, seed: int = 42) -> DataFrame:
    """The rows of ``pairs`` with ``batch``: about ``size`` rows each, and no positive twice in one.

    The j-th row of a positive goes to batch h + j modulo the number of batches, h being the positive's hash. There are n / size batches, or as
    many as the most frequent positive has rows, so batches may be smaller where one positive dominates. Rows are numbered within a positive by
    the md5 of their anchor in sixteen parts, so a frequent positive is not one task's work. A null positive is one like others; repeated rows count.
    """
    key = F.coalesce(F.col(positive).cast("string"), F.lit(""))
    rows = pairs.withColumns({"_p": key, "_h": F.md5(F.concat_ws("|", F.coalesce(F.col(anchor).cast("string"), F.lit("")), F.lit(seed)))}).withColumn("_s", F.substring("_h", 1, 1))
    parts = Scratch(pairs.sparkSession, "batches").table("parts", rows.groupBy("_p", "_s").agg(F.count("*").alias("_n")))
    total, most = parts.groupBy("_p").agg(F.sum("_n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    count = max(-(-total // size), most, 1)
    # at most sixteen rows for each positive
    before = parts.withColumn("_b", F.sum("_n").over(Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("_p", "_s").orderBy("_h")) - 1
    placed = rows.withColumn("_i", place).join(before.select("_p", "_s", F.coalesce("_b", F.lit(0)).alias("_b")), ["_p", "_s"])
    batch = (_number(F.concat_ws("|", "_p", F.lit(seed))) + F.col("_b") + F.col("_i")) % count
    return placed.select(*pairs.columns, batch.alias("batch"))


def loss_and_gradient(a: np.ndarray, p: np.ndarray, w: np.ndarray, scale: float = 20.0) -> tuple[float, np.ndarray]:
    """The mean cross-entropy of picking each anchor's positive among the batch's by scaled cosine, and its gradient by the matrix.

    ``a`` and ``p`` are features of anchors and positives, a row each. Rows whose projection is zero have no direction and no gradient.
    """
    raw = a @ w, p @ w
    length = [np.linalg.norm(r, axis=1, keepdims=True) for r in raw]
    unit = [np.divide(r, n, out=np.zeros_like(r), where=n > 0) for r, n in zip(raw, length)]
    score = scale * unit[0] @ unit[1].T
    score -= score.max(1, keepdims=True)
    soft = np.exp(score)
    soft /= soft.sum(1, keepdims=True)
    m = len(a)
    loss = -float(np.log(np.maximum(soft[np.arange(m), np.arange(m)], 1e-300)).mean())
    by_score = scale * (soft - np.eye(m)) / m
    by_unit = by_score @ unit[1], by_score.T @ unit[0]
    by_raw = [np.divide(g - u * (g * u).sum(1, keepdims=True), n, out=np.zeros_like(g), where=n > 0) for g, u, n in zip(by_unit, unit, length)]
    return loss, a.T @ by_raw[0] + p.T @ by_raw[1]


def _step(batches: DataFrame, w: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """The mean loss and gradient over all batches; tasks send one sum each to the places of the matrix."""

    def run(parts):
        loss, gradient, n = 0.0, np.zeros_like(w), 0
        for part in parts:
            for a, p in zip(part.column("a").to_pylist(), part.column("p").to_pylist(), strict=True):
                one, g = loss_and_gradient(np.array(a, float), np.array(p, float), w, scale)
                loss, gradient, n = loss + one, gradient + g, n + 1
        yield pa.RecordBatch.from_arrays([pa.array([[loss, float(n), *gradient.ravel().tolist()]], pa.list_(pa.float64()))], names=["s"])

    sums = batches.select("a", "p").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.array([r.x for r in sorted(sums.collect())])  # as many as the matrix has places
    return flat[0] / max(flat[1], 1), flat[2:].reshape(w.shape) / max(flat[1], 1)


def train(batched: DataFrame, anchor: str, positive: str, steps: int = 30, rate: float = 0.02, scale: float = 20.0) -> tuple[np.ndarray, list[float]]:
    """(matrix, losses) from rows with feature arrays ``anchor`` and ``positive`` of one length and ``batch``. The matrix begins as the identity.

    The loss before each step is returned. Without rows the matrix stays the identity of size 0.
    """
    scratch = Scratch(batched.sparkSession, "contrastive")
    pair = F.collect_list(F.struct(F.col(anchor).alias("a"), F.col(positive).alias("p")))  # a batch is small by its making
    rows = scratch.table("rows", batched.groupBy("batch").agg(pair.alias("r")).select(F.col("r.a").alias("a"), F.col("r.p").alias("p")))
    first = rows.select(F.size(F.col("a")[0]).alias("n")).first()
    w = np.eye(first.n if first else 0)
    mean, square, losses = np.zeros_like(w), np.zeros_like(w), []
    for t in range(1, steps + 1 if first else 1):
        loss, gradient = _step(rows, w, scale)
        losses.append(loss)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        w = w - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    scratch.drop()
    return w, losses


def projected(features: Column, w: np.ndarray) -> Column:
    """The encoder's vectors of feature arrays, normalised by ``dense.normalize`` where they are searched."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.stack(batch.to_numpy()).astype(float) @ w) if len(batch) else [], dtype=object)

    return project(features)
