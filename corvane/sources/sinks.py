"""Writers: index, benchmark folder, templates, results, tables, cards. Nothing is sent to outside services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Passages with their vectors; with ``buckets``, dealt by document so that later joins on it read few files."""
    (chunks.repartition(buckets, "karar_id") if buckets else chunks).write.mode("overwrite").parquet(path)


def write_bucketed_index(chunks: DataFrame, name: str, path: str, buckets: int = 64, key: str = "karar_id") -> DataFrame:
    """The index as a table of ``buckets`` buckets by document at ``path``, each one file in the order of its passages; returns its rows.

    Grouping by the key, or joining on it, plans without an exchange of the table. Its entry in the session's catalogue is ``name``; another
    session reads the same files with ``decisions.read_bucketed_index``.
    """
    spark = chunks.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = chunks.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key, "chunk_idx").option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def write_beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str) -> DataFrame:
    """corpus.jsonl, queries.jsonl, qrels.tsv and stats.json below ``folder``; returns the stats."""
    meta = F.struct(*[c for c in ("kurul", "esas_no", "karar_no", "tarih") if c in corpus.columns])
    corpus.select(F.col("did").alias("_id"), "title", "text", meta.alias("metadata")).write.mode("overwrite").json(f"{folder}/corpus.jsonl")
    queries.select(F.col("qid").alias("_id"), "text", "type").write.mode("overwrite").json(f"{folder}/queries.jsonl")
    named = qrels.select(F.col("qid").alias("query-id"), F.col("did").alias("corpus-id"), F.col("rel").alias("score"))
    named.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/qrels.tsv")
    kinds = queries.groupBy(F.coalesce("type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"))
    types = kinds.agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("query_types"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stats = count(corpus, "n_corpus").crossJoin(count(queries, "n_queries")).crossJoin(count(qrels, "n_qrels")).crossJoin(types)
    stats.coalesce(1).write.mode("overwrite").json(f"{folder}/stats.json")
    return stats


def write_template(template: DataFrame, path: str) -> None:
    template.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """Rows (config, agg, per_query) of nested values as JSON."""
    results.write.mode("overwrite").json(path)


def comparison_table(means: DataFrame, system: str, metrics: list[str], width: int = 28) -> DataFrame:
    """(line): a system a line in fixed width, the best first metric first; a missing value is 0."""
    full = means.na.fill(0.0, metrics)
    text = F.format_string(f"%-{width}s" + " %8.4f" * len(metrics), system, *[F.col(m).cast("double") for m in metrics])
    return full.orderBy(F.col(metrics[0]).desc(), system).select(text.alias("line"))


def cached(df: DataFrame, path: str) -> DataFrame:
    """What ``path`` holds, after writing ``df`` there if it holds nothing yet."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def model_card(name: str, base: str, metrics: dict[str, float]) -> str:
    rows = "\n".join(f"| {k} | {v:.3f} |" for k, v in metrics.items())
    return f"# {name}\n\nBase model: {base}\n\n| metric | value |\n|---|---|\n{rows}\n"


def dataset_card(name: str, stats: dict[str, object]) -> str:
    return f"# {name}\n\n" + "\n".join(f"- {k}: {v}" for k, v in stats.items()) + "\n"
