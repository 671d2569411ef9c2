"""Scratch tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. A table is written once and read back, which cuts the lineage: when
an executor is lost, later stages read the committed files again. Tables go in one of four ways: their writer drops them
as soon as nothing reads them, ``released`` drops what a block of work left, ``release`` drops all of a session, and what is
left is deleted when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_live: list[Scratch] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a local master, which is one machine, gets a temporary one where none is set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        found = _local[context.applicationId]
    return found.rstrip("/")


class Scratch:
    """Tables of one run of an operator, in a folder of their own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
        self.marked = False
        self.entries: dict[str, str] = {}
        _live.append(self)

    def _file_system(self, path: str):
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(context._jsc.hadoopConfiguration()), place

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written files.

        While it is written, Arrow batches hold at most 16 MB, as executors keep several at once beside their heap; the session's own
        setting is back afterwards.
        """
        path = f"{self.path}/{name}"
        if not self.marked:  # before the write, so that what a failed write leaves goes too; only folders that exist can be marked
            fs, place = self._file_system(self.path)
            fs.mkdirs(place)
            self.marked = fs.deleteOnExit(place)
        conf = self.spark.conf
        before = conf.get(_BATCH, None)
        if before in (None, "64MB", "67108864", "67108864b"):
            conf.set(_BATCH, "16777216b")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Like ``table``, in buckets by ``key`` (as many as shuffles have partitions): grouping by it, also with more columns, needs no shuffle.

        ``df`` comes from ``dealt`` rows, so that each bucket is one task's file. Buckets are known to the session's catalogue only, so the table has an
        entry there until it is dropped.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entry = f"{name}_{self.path[-32:]}"
        self.table(f"{name}-mark", self.spark.range(0))  # the folder goes with the driver
        conf, before = self.spark.conf, self.spark.conf.get(_WRITERS, None)
        conf.set(_WRITERS, "4")  # a task has one bucket's rows; without open writers Spark would sort them by their bucket first
        try:
            df.write.bucketBy(buckets, key).option("path", f"{self.path}/{name}").saveAsTable(entry)
        finally:
            conf.unset(_WRITERS) if before is None else conf.set(_WRITERS, before)
        self.entries[name] = entry
        return self.spark.table(entry)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names, the whole folder."""
        for name in names or ("",):
            fs, place = self._file_system(f"{self.path}/{name}".rstrip("/"))
            fs.delete(place, True)
        for name in [n for n in self.entries if not names or n in names]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.entries.pop(name)}")
        if not names and self in _live:
            _live.remove(self)

    def exists(self) -> bool:
        return self in _live


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` as ``Scratch.bucketed`` has its buckets."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows as they lie if there are as many splits as cores; a small table in few splits is dealt, so that all cores have work."""
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= df.sparkSession.sparkContext.defaultParallelism else dealt(df, key)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now: it does so when the driver's JVM collects what refers to them."""
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this session's application. Call it when the results that read them are written."""
    for scratch in [s for s in _live if s.spark.sparkContext.applicationId == spark.sparkContext.applicationId]:
        scratch.drop()


@contextmanager
def released(keep: Scratch | None = None):
    """Delete at the end the scratch folders that were begun in the block, but ``keep``."""
    before = list(_live)
    try:
        yield
    finally:
        gone = [s for s in _live if s not in before and s is not keep]
        for scratch in gone:
            scratch.drop()
        if gone:
            sweep(gone[0].spark)
