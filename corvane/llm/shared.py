"""What the operators of this package share: scratch tables, Arrow passes, and small samples by hash."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.scratch import Scratch, release, released, shared_dir, sweep

__all__ = ["Scratch", "documents", "extend", "passage", "release", "released", "shared_dir", "small_batches", "smallest_hashes", "sweep"]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For a query: Arrow batches of at most 16 MB instead of Spark's 64 MB, unless the session has a limit of its own.

    Executors hold several batches at once beside their heap. Operators leave the session's settings alone; queries that return what
    an Arrow pass makes need this until their result is read, so they set it and it stays.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, "64MB") in ("64MB", "67108864", "67108864b"):
        spark.conf.set(limit, "16777216b")


def _give_back() -> None:
    """Return freed memory to the system at a task's end; Spark keeps Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def extend(df: DataFrame, new: str, start, drop: tuple[str, ...] = ("_text",), slice_bytes: int = 8 << 20) -> DataFrame:
    """The columns of ``df`` without those of ``drop``, and the columns of the DDL text ``new``.

    ``start()`` runs once in each task and returns the function of an Arrow batch that gives the new
    columns' values. It gets slices of about ``slice_bytes``, so that Python's copies of the values stay small. Kept
    columns pass through as Arrow arrays, so ids with nulls stay integers.
    """
    added = T._parse_datatype_string(new)
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + added.fields)
    names, types = [f.name for f in kept], to_arrow_schema(added)

    def run(batches):
        make = start()
        for whole in batches:
            step = max(1, whole.num_rows * slice_bytes // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                values = [pa.array(v, t.type) for v, t in zip(make(batch), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + values, names=[*names, *types.names])
        del make
        _give_back()

    return df.mapInArrow(run, schema)


def smallest_hashes(ids: DataFrame, label: str, size: int) -> DataFrame:
    """Of ``ids`` (_i and ``label``), the distinct ids with the ``size`` smallest hashes of each label, and _r, their rank.

    The labels are few; they are counted first. Hashes are even, so a bound on the hash that lets through about twice ``size``
    ids of a label leaves a set that doesn't grow with the table; only that is shuffled and ranked. Where ids
    repeat so much that fewer are left, the bound is raised until there are enough or all are in. Null ids are left out.
    """
    rows = ids.select("_i", label).filter("_i IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*")).collect()}
    if not counts:
        return rows.limit(0).withColumn("_r", F.lit(0))
    raised = dict.fromkeys(counts, 1.0)
    while True:
        share = {y: min(1.0, raised[y] * (2 * size + 64) / n) for y, n in counts.items()}
        bound = F.create_map(*[F.lit(x) for y, s in share.items() for x in (y, min(2**63 - 1, int(s * 2**64) - 2**63))])
        few = rows.filter(F.xxhash64("_i") <= F.element_at(bound, F.col(label))).distinct()
        got = {r[0]: r[1] for r in few.groupBy(label).agg(F.count("*")).collect()}
        short = [y for y in counts if share[y] < 1 and got.get(y, 0) < size]
        if not short:
            break
        for y in short:
            raised[y] *= 8
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("_i"), "_i"))
    return few.withColumn("_r", rank).filter(F.col("_r") <= size)


def passage(text: str, key: str, most: int):
    """A text of at most ``most`` characters as it is; of a longer one a passage of that size, at a place drawn by the hash of ``key``."""
    spare = F.greatest(F.length(text) - most, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(key, F.lit("place")), spare.cast("long")).cast("int") + 1
    return F.when(F.length(text) > most, F.substring(text, place, F.lit(most))).otherwise(F.col(text))
