"""Evaluation suites: runs of several systems as one plan, and the gold evaluations."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import metrics, relevance, rerank


def suite(runs: dict[str, DataFrame], qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(system, qid, metrics…) of every run in one plan."""
    tagged = [metrics.judged(run, qrels, queries).withColumn("system", F.lit(name)) for name, run in runs.items()]
    return reduce(DataFrame.unionByName, tagged)


def matrix(runs: dict[str, DataFrame], scorer=rerank.overlap_scorer, fetch_k: int = 15, top_k: int = 10) -> DataFrame:
    """(config, qid, metrics…) of every run, plain and reranked.

    A run is (qid, did, rank, query, text, rel). Reranking takes the first ``fetch_k`` rows of each query; both kinds keep ``top_k``.
    """
    out = []
    for name, run in runs.items():
        again = rerank.rerank(run, scorer, fetch_k, top_k).join(run.select("qid", "did", "rel"), ["qid", "did"])
        for config, rows in ((name, run.filter(F.col("rank") <= top_k)), (f"{name} + rerank", again)):
            out.append(metrics.self_ideal(rows.select("qid", "did", "rank", "rel")).withColumn("config", F.lit(config)))
    return reduce(DataFrame.unionByName, out)


def latency(spark: SparkSession, configs: dict[str, Callable[[], DataFrame]], n_queries: int) -> DataFrame:
    """(config, avg_latency_ms): the wall clock of running each config's plan to its end, a query's share of it."""
    took = []
    for name, plan in configs.items():
        began = time.perf_counter()
        plan().write.format("noop").mode("overwrite").save()
        took.append((name, (time.perf_counter() - began) * 1000 / max(n_queries, 1)))
    return spark.createDataFrame(took, "config string, avg_latency_ms double")


def eyeball(results: DataFrame, top_k: int = 5, size: int = 200) -> DataFrame:
    """(qid, rank, line): the first ``top_k`` results (qid, did, rank, score, kurul, text) as lines with a short snippet."""
    cut = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, size), "\n", " ")
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce("kurul", F.lit("?")), F.lit(" | "), cut, F.lit("..."))
    return results.filter(F.col("rank") <= top_k).select("qid", "did", "rank", F.round("score", 4).alias("score"), line.alias("line"))


def graded_evaluation(results: DataFrame, specs: DataFrame) -> DataFrame:
    """Metrics of results (qid, did, rank, text) judged by graded groups of (qid, rel); a query without results has zeros."""
    rows = results.join(F.broadcast(specs.select("qid", F.col("rel").alias("_g"))), "qid")
    per = metrics.self_ideal(rows.withColumn("rel", relevance.graded_relevance(F.col("_g"), F.col("text"))), "rel", (1, 5, 10))
    return specs.select("qid").join(per, "qid", "left").na.fill(0)


def keyword_evaluation(results: DataFrame, specs: DataFrame) -> DataFrame:
    rows = results.join(F.broadcast(specs.select("qid", "must_any")), "qid")
    return metrics.self_ideal(rows.withColumn("rel", relevance.keyword_relevant(F.col("must_any"), F.col("text")).cast("int")), "rel")
