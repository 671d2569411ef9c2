"""Readers of decisions, benchmarks, indexes and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import lexicon as lex
from corvane.functions import text as X
from corvane.sources import json_array

_FIELDS = ["KARAR_ID", "ESAS_NO", "KARAR_NO", "KARAR_TARIHI", "KURUL_ADI", "HUKUM"]
#: KARAR may be markup or an object that holds it, so it is read as text.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("karar_html_excerpt", "KARAR", *_FIELDS)]
    + [T.StructField("metadata", T.StructType([T.StructField(n, T.StringType()) for n in ("KARAR", *_FIELDS)]))]
)


def json_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Records of the array KARARLAR, with their place as ord; the first ``limit`` of them. A large file is read by many tasks."""
    return json_array.parsed(json_array.records(spark, path, "KARARLAR", limit), RECORD)


def _markup(column: Column) -> Column:
    inner = F.get_json_object(column, "$.KARAR")
    return F.when(column.startswith("{"), F.coalesce(inner, F.lit(""))).otherwise(column)


def from_json(records: DataFrame, limit: int | None = 3000, least: int = 500) -> DataFrame:
    """Decisions of JSON records (ord and the record's fields): of the first 2 * ``limit`` records, the first ``limit`` with enough text."""
    has = "metadata" in records.columns
    meta = lambda n: F.col(f"metadata.{n}") if has else F.lit(None).cast("string")
    field = lambda n: X.fallback(meta(n), F.col(n))
    html = _markup(X.fallback(F.col("karar_html_excerpt"), F.col("KARAR"), meta("KARAR")))
    rows = (records.filter(F.col("ord") < 2 * limit) if limit else records).withColumn("_html", html).withColumn("text", X.clean_html(F.col("_html"))).filter(F.length("text") >= least)
    body = X.after(F.col("text"), lex.BODY_MARKER)
    made = rows.select(
        "ord",
        field("KARAR_ID").alias("karar_id"),
        field("ESAS_NO").alias("esas_no"),
        field("KARAR_NO").alias("karar_no"),
        field("KARAR_TARIHI").alias("tarih"),
        field("KURUL_ADI").alias("kurul"),
        F.coalesce(field("HUKUM"), F.lit("")).alias("hukum"),
        X.html_title(F.col("_html")).alias("title"),
        X.html_items(F.col("_html")).alias("kanunlar"),
        "text",
        X.from_last(body, lex.CONCLUSION_MARKERS).alias("sonuc"),
    )
    return made.orderBy("ord").limit(limit) if limit else made


def from_hub(rows: DataFrame, n: int | None = 3000, least: int = 500, most: int = 15_000, counts: Observation | None = None) -> DataFrame:
    """Decisions of hub records (id, esasNo, kararNo, kararTarihi, source, text, ord): cleaned, long enough, cut, with metadata.

    ``counts`` observes the scan itself: seen, kept, short (left out) and cut records of what an action has read, once it is done. With ``n``,
    an action may stop before it has read all.
    """
    clean = rows.withColumn("text", X.clean_markdown(F.col("text")))
    if counts is not None:
        size = F.length("text")
        tally = {"seen": F.lit(True), "kept": size >= least, "short": size < least, "cut": size > most}
        clean = clean.observe(counts, *[F.count_if(c).alias(name) for name, c in tally.items()])
    kept = clean.filter(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))
    board = X.chamber(F.col("text"), F.col("source"))
    made = kept.select(
        "ord",
        F.col("id").alias("karar_id"),
        F.col("esasNo").alias("esas_no"),
        F.col("kararNo").alias("karar_no"),
        F.col("kararTarihi").alias("tarih"),
        board.alias("kurul"),
        "source",
        X.source_label(F.col("source")).alias("source_label"),
        X.title(board, F.col("esasNo"), F.col("kararNo")).alias("title"),
        X.statutes(F.col("text")).alias("kanunlar"),
        X.subject(F.col("text")).alias("konu"),
        F.lit("").alias("hukum"),
        "text",
        F.lit("").alias("sonuc"),
    )
    return made.orderBy("ord").limit(n) if n else made


def last_by_id(df: DataFrame, key: str = "_id") -> DataFrame:
    """Of rows with one id, the last in the files' order: by the file's path, the place of its split, and the row within."""
    row = F.struct(*df.columns)
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    numbered = df.select("*", F.struct(*place).alias("_at"))
    return numbered.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, "_at").alias("r")).select("r.*")


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a benchmark folder, with columns did/title/text/metadata, qid/text/type and qid/did/rel."""
    meta = "metadata struct<kurul: string, esas_no: string, karar_no: string, tarih: string>"
    corpus = last_by_id(spark.read.schema(f"_id string, title string, text string, {meta}").json(f"{folder}/corpus.jsonl")).withColumnRenamed("_id", "did")
    queries = last_by_id(spark.read.schema("_id string, text string, type string").json(f"{folder}/queries.jsonl")).withColumnRenamed("_id", "qid")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels.tsv")
    return corpus, queries, qrels.toDF("qid", "did", "rel")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_bucketed_index(spark: SparkSession, name: str, path: str, buckets: int = 64, key: str = "karar_id") -> DataFrame:
    """The table that ``sinks.write_bucketed_index`` wrote, entered in this session's catalogue with the same buckets and key."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}, chunk_idx) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(config, metric, value) of a result file: scores with three places, latencies (names that end in _ms) with none."""
    rows = spark.read.schema("config string, agg map<string, double>").option("multiLine", True).json(path)
    long = rows.select("config", F.explode("agg").alias("metric", "value"))
    return long.withColumn("value", F.when(F.col("metric").endswith("_ms"), F.round("value", 0)).otherwise(F.round("value", 3)))


def literal_queries(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyword, graded and eyeball query tables."""
    keyword = spark.createDataFrame(lex.KEYWORD_QUERIES, "qid string, kategori string, query string, must_any array<array<string>>")
    graded = spark.createDataFrame([(f"g{i + 1:02d}", q, r) for i, (q, r) in enumerate(lex.GRADED_QUERIES)], "qid string, query string, rel array<array<string>>")
    return keyword, graded, spark.createDataFrame(lex.EYEBALL_QUERIES, "query string, kategori string")
