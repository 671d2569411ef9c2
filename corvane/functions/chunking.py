"""Passages: paragraphs packed greedily, long ones by sentence, with the end of a passage carried over. Folds of native arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sentences, strip


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n+"), strip), lambda p: p != "")


def _texts() -> Column:
    return F.array().cast("array<string>")


def pack_sentences(paragraph: Column, most: int) -> Column:
    """Sentences joined by blanks up to ``most`` characters; a longer sentence stays whole."""
    start = F.struct(_texts().alias("parts"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        fits = a.n + F.length(s) + 1 <= most
        return (
            F.when(a.n == 0, F.struct(a.parts.alias("parts"), s.alias("open"), F.length(s).alias("n")))
            .when(fits, F.struct(a.parts.alias("parts"), F.concat(a.open, F.lit(" "), s).alias("open"), (a.n + F.length(s) + 1).alias("n")))
            .otherwise(F.struct(F.array_append(a.parts, a.open).alias("parts"), s.alias("open"), F.length(s).alias("n")))
        )

    return F.aggregate(sentences(paragraph), start, step, lambda a: F.when(a.n == 0, a.parts).otherwise(F.array_append(a.parts, a.open)))


def chunks(text: Column, most: int = 1200, overlap: int = 150, least: int = 200) -> Column:
    """Passages of a text. One shorter than ``least`` is dropped; ``overlap`` characters of a closed one open the next.

    The folds carry the open passage's length ``n``, as counting characters reads them all.
    """
    text = F.coalesce(text, F.lit(""))
    pieces = F.flatten(F.transform(paragraphs(text), lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(pack_sentences(p, most))))
    start = F.struct(_texts().alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    closed = lambda a: F.when(a.n >= least, F.array_append(a.done, a.open)).otherwise(a.done)

    def step(a: Column, p: Column) -> Column:
        fits = a.n + F.length(p) + 2 <= most
        carry = (a.n > overlap) & F.lit(overlap > 0)
        opened = F.when(carry, strip(F.concat(F.right(a.open, F.lit(overlap)), F.lit("\n\n"), p))).otherwise(p)
        return (
            F.when(a.n == 0, F.struct(a.done.alias("done"), p.alias("open"), F.length(p).alias("n")))
            .when(fits, F.struct(a.done.alias("done"), F.concat(a.open, F.lit("\n\n"), p).alias("open"), (a.n + F.length(p) + 2).alias("n")))
            .otherwise(F.struct(closed(a).alias("done"), opened.alias("open"), F.length(opened).alias("n")))
        )

    return F.aggregate(pieces, start, step, lambda a: F.when(a.n > 0, closed(a)).otherwise(a.done))


def chunk_records(df: DataFrame, text_col: str = "text", most: int = 1200, overlap: int = 150) -> DataFrame:
    """A row for each passage: the other columns, chunk_idx, n_chunks and the passage as text. Texts without passages go."""
    made = df.withColumn("_chunks", chunks(F.col(text_col), most, overlap)).withColumn("n_chunks", F.size("_chunks"))
    rest = [c for c in df.columns if c != text_col]
    # the outer form, as of the plain one Spark infers a filter on the passages, and so cuts every text twice
    return made.select(*rest, "n_chunks", F.posexplode_outer("_chunks").alias("chunk_idx", text_col)).filter("chunk_idx IS NOT NULL")
