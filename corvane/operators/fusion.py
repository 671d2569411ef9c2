"""Reciprocal rank fusion of ranked lists, and what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """(qid, did, score, dense_score, dense_rank, bm25_rank, pos): the union of two runs, ranks from 0, pos from 1.

    score is the sum of 1 / (k + rank + 1) over both lists. Equal scores keep the dense list's order, then the
    sparse list's. dense_score is 0 for what only the sparse list has. Ranks decide, scores are rounded to twelve
    places first, so that sums in another order rank alike.
    """
    a = dense.select("qid", "did", F.col("score").alias("dense_score"), (F.col("rank") - 1).alias("dense_rank"))
    b = sparse.select("qid", "did", (F.col("rank") - 1).alias("bm25_rank"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r) + 1), F.lit(0.0))
    both = a.join(b, ["qid", "did"], "full").withColumn("score", F.round(part("dense_rank") + part("bm25_rank"), 12))
    turn = F.coalesce(F.col("dense_rank"), F.lit(1 << 30) + F.col("bm25_rank"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), turn)
    return both.withColumn("dense_score", F.coalesce("dense_score", F.lit(0.0))).withColumn("pos", F.row_number().over(order))


def best_per_group(ranked: DataFrame, group: Column | str, pos: str = "pos") -> DataFrame:
    """The first row of each group of a query, renumbered; rows without a group form one."""
    group = F.col(group) if isinstance(group, str) else group
    first = F.row_number().over(Window.partitionBy("qid", group).orderBy(pos))
    kept = ranked.withColumn("_first", first).filter("_first = 1").drop("_first")
    return kept.withColumn(pos, F.row_number().over(Window.partitionBy("qid").orderBy(pos)))


def hybrid(dense: DataFrame, sparse: DataFrame, top_k: int = 10, k: int = 60, groups: DataFrame | None = None) -> DataFrame:
    """The best ``top_k`` of the fused run; with ``groups`` (did, group), only the best of each group."""
    fused = reciprocal_rank_fusion(dense, sparse, k)
    if groups is not None:
        fused = best_per_group(fused.join(groups, "did", "left"), "group")
    return fused.filter(F.col("pos") <= top_k)


def first_of_signature(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with one signature in a query, the first; positions are not renumbered."""
    first = F.row_number().over(Window.partitionBy("qid", key).orderBy(order))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")
