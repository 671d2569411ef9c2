"""Exact dedup over an extendible-hash index on shared files, in DataFrame functions only.

1. One scan writes a slot (id, 64-bit hash, SHA-256) for every row: the keys, without the texts.
2. The directory has a page for each value of the hash's first ``PAGE_BITS`` bits and holds the page's depth, how many leading
   bits name its buckets. Pages with few keys share a bucket; a page doubles, as often as it takes, until none of its buckets holds more
   than ``bucket_keys`` distinct hashes. The directory has 2 ** PAGE_BITS rows at most, so it can be broadcast whatever the input's size.
3. Every text goes through the directory to the task that owns its bucket, in the one shuffle of texts. The owner compares bytes: equal
   texts become one entry with their largest id and their number, and different texts with one hash are chained. Hashes of very many
   rows are combined before they travel, so that a group of copies that holds a third of all rows leaves a row for each map task.
4. The index on shared files has an entry for each distinct text: bucket, hash, SHA-256, place in its chain, id and number. Slots look
   their entry up through the directory as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

PAGE_BITS = 14


def _key(text, hash_bits: int):
    """The leading ``hash_bits`` bits of the hash; fewer than 64 make collisions (for tests)."""
    h = F.xxhash64(text)
    return h if hash_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)


def page_of(h: str) -> Column:
    return F.shiftrightunsigned(h, 64 - PAGE_BITS)


def bucket_of(h: str, depth: str) -> Column:
    """A bucket's name: its depth and the hash's leading bits."""
    # a shift by 64 would be one by 0
    return F.concat_ws("/", depth, F.when(F.col(depth) > 0, F.expr(f"shiftrightunsigned({h}, 64 - {depth})")).otherwise(F.lit(0)))


def directory(keys: DataFrame, bucket_keys: int, scratch: Scratch) -> DataFrame:
    """(_page, _depth) after doubling. ``keys`` has one row per distinct ``_h``.

    A prefix splits if it holds more than ``bucket_keys`` keys; as a longer prefix never holds more, the depth of a page
    that isn't overfull itself is one more than that of its deepest overfull prefix. An overfull page begins at the least depth that could do
    and doubles while one of its buckets is overfull; keys are distinct, so that ends.
    """
    pages = scratch.table("pages", keys.groupBy(page_of("_h").alias("_page")).agg(F.count("*").alias("_n")))
    levels = pages.select("_page", "_n", F.explode(F.sequence(F.lit(0), F.lit(PAGE_BITS - 1))).alias("_level"))
    levels = levels.withColumn("_prefix", F.expr(f"shiftright(_page, {PAGE_BITS} - _level)"))
    overfull = levels.groupBy("_level", "_prefix").agg(F.sum("_n").alias("_all")).filter(F.col("_all") > bucket_keys)
    most = F.max(F.when(F.col("_all").isNotNull(), F.col("_level") + 1))
    # fewer than 2 ** PAGE_BITS prefixes
    shallow = levels.join(F.broadcast(overfull), ["_level", "_prefix"], "left").groupBy("_page", "_n").agg(F.coalesce(most, F.lit(0)).alias("_depth"))
    more = F.when(F.col("_n") > bucket_keys, F.ceil(F.log2(F.col("_n") / F.lit(float(bucket_keys))))).otherwise(F.lit(0))
    depths = scratch.table("depths-0", shallow.select("_page", (F.col("_depth") + more).cast("int").alias("_depth")))
    turn = 0
    while True:
        deep = keys.withColumn("_page", page_of("_h")).join(F.broadcast(depths.filter(F.col("_depth") > PAGE_BITS)), "_page")
        full = deep.groupBy("_page", bucket_of("_h", "_depth").alias("_b")).agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_keys)
        turn += 1
        full = scratch.table(f"overfull-{turn}", full.select("_page").distinct())
        if full.isEmpty():
            return depths
        grown = depths.join(F.broadcast(full.withColumn("_full", F.lit(1))), "_page", "left")  # a row for each page at most
        depths = scratch.table(f"depths-{turn}", grown.select("_page", (F.col("_depth") + F.coalesce("_full", F.lit(0))).alias("_depth")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 4096, hash_bits: int = 64, many: int = 64) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the largest id
    stays. Rows that repeat an id and its text all carry the same verdict and each counts in
    group_size; a row with a null id stays only in a group where all ids are null (keep_id is null then).
    An empty table gives an empty result. Other columns of ``docs`` are not read.

    Hashes of more than ``many`` rows and more than a millionth of the rows are combined before they are dealt; these are fewer than a
    million by that, and so are broadcast. A hash of fewer rows is dealt as it is.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", _key(F.col("_text"), hash_bits))
    slots = scratch.table("slots", rows.select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha")))
    sizes = scratch.table("sizes", slots.groupBy("_h").agg(F.count("*").alias("_n")))
    least = max(many, math.ceil(slots.count() / 1_000_000))
    hot = sizes.filter(F.col("_n") > least).select("_h")
    cells = F.broadcast(directory(sizes.select("_h"), bucket_keys, scratch))
    routed = lambda df: df.withColumn("_page", page_of("_h")).join(cells, "_page").withColumn("_bucket", bucket_of("_h", "_depth")).drop("_page", "_depth")
    dealt = rows.join(F.broadcast(hot), "_h", "left_anti").select("_h", "_text", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    if not hot.isEmpty():
        together = rows.join(F.broadcast(hot), "_h", "left_semi").groupBy("_h", "_text").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
        dealt = dealt.unionByName(together)
    owned = routed(dealt).repartition("_bucket")
    entries = owned.groupBy("_bucket", "_h", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    place = F.row_number().over(Window.partitionBy("_bucket", "_h").orderBy("_sha")).alias("_place")
    entries = entries.select("_bucket", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_keep", "_size")
    index = scratch.table("index", entries.select("*", place))
    found = routed(slots).join(index, ["_bucket", "_h", "_sha"])
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
