"""The offline index: decisions to passages to vectors, in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import text as T
from corvane.operators import dense


def hashed_encoder(text: Column, size: int = 64) -> Column:
    """A stand-in for a text encoder: counts of hashed tokens, normalised. It stays in the JVM."""
    at = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    slots = F.sequence(F.lit(0), F.lit(size - 1))
    return dense.normalize(T.let(at, lambda found: F.transform(slots, lambda i: F.size(F.filter(found, lambda x: x == i)).cast("double"))))


def build(decisions: DataFrame, encode: Callable[[Column], Column] = hashed_encoder, most: int = 1200, overlap: int = 150) -> DataFrame:
    """Passages of decisions with row_id (a hash of document and place), chunk_idx, n_chunks, text and embedding."""
    made = chunking.chunk_records(decisions, "text", most, overlap)
    key = "karar_id" if "karar_id" in made.columns else made.columns[0]
    return made.withColumn("row_id", F.xxhash64(key, "chunk_idx")).withColumn("embedding", encode(T.prefixed(F.col("text"), "passage")))


def stats(chunks: DataFrame, key: str) -> DataFrame:
    """One row (n_chunks, n_docs, n_chars); a null key counts as a document."""
    docs = F.countDistinct(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return chunks.agg(F.count("*").alias("n_chunks"), docs.alias("n_docs"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n_chars"))
