"""Streaming ingestion: new decisions become passages and additive postings. An extension; batch results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import text as T


def passages(stream: DataFrame, text: str = "text") -> DataFrame:
    """Passages of a stream of documents; no state is needed."""
    return chunking.chunk_records(stream, text)


def postings(batch: DataFrame, did: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(tok, df) and (did, dl) of new documents; both only ever grow by sums and rows."""
    docs = batch.select(did, T.tokens(F.col(text)).alias("toks"))
    df = docs.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    return df, docs.select(did, F.size("toks").alias("dl"))


def start(stream: DataFrame, folder: str, did: str, text: str = "text", available_now: bool = True):
    """Write each micro-batch's passages and postings below ``folder``, a folder a batch, so that a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        df, dl = postings(batch, did, text)
        for name, rows in (("passages", passages(batch, text)), ("df", df), ("dl", dl)):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def document_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """(tok, df) over all batches so far."""
    return spark.read.parquet(f"{folder}/df").groupBy("tok").agg(F.sum("df").alias("df"))
