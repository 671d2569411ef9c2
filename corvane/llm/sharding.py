"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash follows Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014): a
linear congruential generator seeded by the key draws the shard counts at which the key moves; the
last one below the wanted count names the shard. No ring table is needed, and a key that moves when one
shard is appended moves into that shard. The generator works modulo 2**64; to hold in ANSI mode too, its
state is kept as two 32-bit halves and multiplied in parts that stay below 2**63.

Slots are numbered in order of id within a shard without gathering a shard in one task: rows are range
partitioned by (shard, id), written with their place in the partition, and each partition's share of a
shard is moved by the count of the shares before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
LOW16 = 0xFFFF


def _advance(hi: Column, lo: Column) -> Column:
    """Halves of ``state * MULTIPLIER + 1`` modulo 2**64."""
    m1, m0 = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & LOW32)
    cut = lambda x, mask: x.bitwiseAND(F.lit(mask).cast("long"))
    upper = F.shiftright(lo, 16) * m0
    low = cut(lo, LOW16) * m0 + F.shiftleft(cut(upper, LOW16), 16) + 1
    cross = cut(hi, LOW16) * m0 + F.shiftleft(cut(F.shiftright(hi, 16) * m0, LOW16), 16)
    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + lo * m1 + cross
    return F.struct(cut(high, LOW32).alias("hi"), cut(low, LOW32).alias("lo"))


def jump_hash(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of an integer key among ``shards`` and among one more.

    ``b`` is the last draw below ``shards`` and ``j`` the next one. Each draw is above the last, so
    ``shards`` steps suffice; steps after that change nothing. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(long(LOW32)).alias("lo"), long(-1).alias("b"), long(0).alias("j")
    )

    def step(s: Column, _: Column) -> Column:
        draw = lambda n: F.struct(
            n.hi.alias("hi"),
            n.lo.alias("lo"),
            s.j.alias("b"),
            F.floor((s.j + 1) * (F.lit(float(1 << 31)) / (F.shiftright(n.hi, 1) + 1))).cast("long").alias("j"),
        )
        return F.when(s.j >= shards, s).otherwise(F.transform(F.array(_advance(s.hi, s.lo)), draw)[0])

    end = lambda s: F.struct(s.b.cast("int").alias("shard"), F.when(s.j == shards, shards).otherwise(s.b).cast("int").alias("grown"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, end)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    An integer id is the key itself, any other is hashed to one; a null key counts as 0. size is the
    UTF-8 length of the text (null: 0) plus 8, text_crc32 that of an empty text where it is null. Rows that
    repeat an id share a shard and get slots of their own. An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    key = docs[id_col] if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(docs[id_col])
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_hash(key, shards).alias("_to"),
    ).select("_id", "size", "text_crc32", F.col("_to.shard").alias("shard"), F.col("_to.grown").alias("grown_shard"))
    order = ["shard", "_id", "size", "text_crc32"]
    placed = Scratch(docs.sparkSession, "sharding").table(
        "placed",
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()),
    )
    # One share for each part and shard it touches: at most parts + shards, as parts are ranges.
    shares = placed.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    return placed.join(F.broadcast(shares.drop("_first", "_n")), ["shard", "_part"]).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_at") + F.col("_offset")).alias("slot"),
        "grown_shard",
    )


#: CRC-32 comes from DuckDB's list functions, a bit at a time over bytes; the jump hash from a recursive query.
ORACLE_SQL = """
WITH RECURSIVE jump AS (
    SELECT doc_id, coalesce(doc_id, 0)::HUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
    SELECT doc_id, nxt, j, floor((j + 1) * (2147483648e0 / ((nxt >> 33) + 1)::DOUBLE))::BIGINT
    FROM (SELECT doc_id, j, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nxt FROM jump WHERE j < 24)
),
landed AS (SELECT doc_id, b::INTEGER AS shard, (CASE WHEN j = 24 THEN 24 ELSE b END)::INTEGER AS grown_shard FROM jump WHERE j >= 24),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
sums AS (
    SELECT doc_id, n + 8 AS size,
           xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 2 * n + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM hexed, bits
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM landed JOIN sums USING (doc_id)
"""
