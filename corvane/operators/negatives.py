"""Hard negatives: ranked documents that aren't the positive, past the first few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def hard_negatives(run: DataFrame, pairs: DataFrame, most: int = 4, top_k: int = 30, skip_top: int = 2, ceiling: float | None = None) -> DataFrame:
    """(qid, positive_id, negative_ids) from a run (qid, did, score, rank) and pairs (qid, pos).

    Ranks up to ``skip_top`` and beyond ``top_k`` are out, and so are the positive itself and scores of at least
    ``ceiling``; the first ``most`` of the rest are the negatives. Pairs without any are left out.
    """
    near = run.filter((F.col("rank") > skip_top) & (F.col("rank") <= top_k))
    if ceiling is not None:
        near = near.filter(F.col("score") < ceiling)
    rest = pairs.select("qid", "pos").join(near, "qid").filter("did <> pos")
    order = Window.partitionBy("qid", "pos").orderBy("rank")
    kept = rest.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_r", "did"))), lambda x: x.did)
    return kept.groupBy("qid", F.col("pos").alias("positive_id")).agg(ids.alias("negative_ids"))


def triplets(mined: DataFrame, queries: DataFrame, corpus: DataFrame, size: int = 1200) -> DataFrame:
    """(anchor, positive, negative) texts with prefixes; (qid, text) queries and (did, text) documents. Empty texts are left out."""
    docs = corpus.filter("text IS NOT NULL AND text <> ''").select("did", F.substring("text", 1, size).alias("body"))
    rows = mined.select("qid", "positive_id", F.explode("negative_ids").alias("negative_id"))
    rows = rows.join(queries.select("qid", F.col("text").alias("_q")), "qid")
    rows = rows.join(docs.select(F.col("did").alias("positive_id"), F.col("body").alias("_p")), "positive_id").join(docs.select(F.col("did").alias("negative_id"), F.col("body").alias("_n")), "negative_id")
    return rows.select(T.prefixed(F.col("_q"), "query").alias("anchor"), T.prefixed(F.col("_p"), "passage").alias("positive"), T.prefixed(F.col("_n"), "passage").alias("negative"))
