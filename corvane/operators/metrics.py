"""Ranking metrics. A run is (qid, did, rank) with ranks from 1; judgments are (qid, did, rel).

Three families are kept apart: against judgments (ideal ranking from all judged documents of the query), by
keywords, and graded (both with the ideal ranking from what was retrieved).
recall@k is a hit rate: whether any relevant document is among the first k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def _round(x: Column) -> Column:
    return F.round(x, 6)


def judged(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, ks=(1, 5, 10, 100)) -> DataFrame:
    """A row of metrics for each judged query, zeros where the run has nothing; ``queries`` (qid) restricts them.

    hit_<k> is recall@k, mrr_10 the reciprocal rank of the first hit within 10, ndcg_10, and map over the whole run.
    """
    ideal = qrels.withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), "did")))
    base = ideal.groupBy("qid").agg(
        F.sum(F.when(F.col("_i") <= 10, _gain(F.col("rel"), F.col("_i")))).alias("_ideal"), F.sum((F.col("rel") > 0).cast("int")).alias("_relevant")
    )
    if queries is not None:
        base = base.join(queries.select("qid").distinct(), "qid", "left_semi")
    hits = run.join(qrels, ["qid", "did"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("_hit", (F.col("rel") > 0).cast("int"))
    hits = hits.withColumn("_so_far", F.sum("_hit").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when((F.col("rel") > 0) & (F.col("rank") <= 10), F.col("rank")))
    per = hits.groupBy("qid").agg(
        *[F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in ks],
        (1.0 / first).alias("_rr"),
        F.sum(F.when(F.col("rank") <= 10, _gain(F.col("rel"), F.col("rank")))).alias("_dcg"),
        F.sum(F.when(F.col("_hit") == 1, F.col("_so_far") / F.col("rank"))).alias("_ap"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return base.join(per, "qid", "left").select(
        "qid",
        *[F.coalesce(F.col(f"hit_{k}"), F.lit(0)).alias(f"hit_{k}") for k in ks],
        _round(zero(F.col("_rr"))).alias("mrr_10"),
        _round(zero(F.col("_dcg")) / F.when(F.col("_ideal") > 0, F.col("_ideal")).otherwise(1.0)).alias("ndcg_10"),
        _round(F.when(F.col("_relevant") > 0, zero(F.col("_ap")) / F.col("_relevant")).otherwise(0.0)).alias("map"),
    )


def self_ideal(run: DataFrame, rel: str = "rel", ks=(1, 3, 5, 10)) -> DataFrame:
    """Metrics of a run with its own relevance column; each ndcg_<k> is against the retrieved first k in the best order."""
    out = run
    for k in ks:
        inside = F.when(F.col("rank") <= k, F.col(rel))
        out = out.withColumn(f"_i{k}", F.row_number().over(Window.partitionBy("qid").orderBy(inside.desc_nulls_last(), "rank")))
    dcg = lambda k, at: F.sum(F.when(F.col("rank") <= k, _gain(F.col(rel), F.col(at))))
    first = F.min(F.when(F.col(rel) > 0, F.col("rank")))
    per = out.groupBy("qid").agg(
        *[F.max(F.when((F.col(rel) > 0) & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in ks],
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        *[dcg(k, "rank").alias(f"_d{k}") for k in ks],
        *[dcg(k, f"_i{k}").alias(f"_b{k}") for k in ks],
    )
    ndcg = lambda k: F.col(f"_d{k}") / F.when(F.col(f"_b{k}") > 0, F.col(f"_b{k}")).otherwise(1.0)
    return per.select("qid", *[f"hit_{k}" for k in ks], _round(F.col("mrr")).alias("mrr"), *[_round(ndcg(k)).alias(f"ndcg_{k}") for k in ks])


def means(per_query: DataFrame, *by: str) -> DataFrame:
    """Mean of each metric; a null counts as 0. Rounded to six places from sums of millionths."""
    names = [c for c in per_query.columns if c not in ("qid", *by)]
    micro = lambda c: F.sum(F.round(F.coalesce(F.col(c), F.lit(0)) * 1_000_000).cast("long"))
    return per_query.groupBy(*by).agg(F.count("*").alias("n"), *[(micro(c) / (F.count("*") * 1_000_000)).alias(c) for c in names])


def winners(a: DataFrame, b: DataFrame, k: int, names: tuple[str, str]) -> DataFrame:
    """(qid, winner) from hit_<k> of two systems: the one with a hit, or tie."""
    joined = a.select("qid", F.col(f"hit_{k}").alias("_a")).join(b.select("qid", F.col(f"hit_{k}").alias("_b")), "qid")
    return joined.select("qid", F.when(F.col("_a") > F.col("_b"), names[0]).when(F.col("_b") > F.col("_a"), names[1]).otherwise("tie").alias("winner"))


def examples(won: DataFrame, winner: str, details: DataFrame, columns: list[str], most: int = 15) -> DataFrame:
    """A report of the first ``most`` queries that a system wins, with columns of ``details`` (qid, …)."""
    return won.filter(F.col("winner") == winner).join(details, "qid").select("qid", *columns).orderBy("qid").limit(most)
