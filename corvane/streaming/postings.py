"""BM25 statistics kept up to date from a stream of documents, replacements and deletions.

Every micro-batch adds rows to two tables below a folder, in a folder of its own number, so a repeated batch replaces its own rows:

    docs   did, n, dl, terms    n is +1 for a document that came and -1 for the version of one that is replaced or deleted; terms holds
                                that version's tokens with their counts. Rows without n hold parts of the batch's frequencies
    df     tok, df              how many documents more or fewer have a token

Sums over all batches are the statistics of the documents that are there now: a version and its withdrawal cancel to nothing. What a
batch withdraws is read from the batches before it only, so running it again gives the same rows. Tokens are counted within a
document's row, over Arrow batches; neither texts nor postings are shuffled to add a batch, but for ids that a batch has twice and those that were there before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical

#: Fewer ids than this are broadcast when their rows are looked up.
FEW = 100_000
#: Up to so many words, other tokens' postings are left out where they are read.
WORDS = 10_000


def _docs(key: str) -> str:
    return f"did {key}, n long, dl long, terms {T.TERMS}"


def _read(spark: SparkSession, folder: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """A table's rows of all batches, or of those before a number; none where nothing has been written yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() < FEW else ids


def _last(events: DataFrame) -> DataFrame:
    """The last event of each id by place. Only the events of ids that come twice are shuffled with their texts."""
    twice = _few(events.groupBy("did").agg(F.count("*").alias("c")).filter("c > 1").select("did"))
    again = events.join(twice, "did", "left_semi").groupBy("did").agg(F.max_by(F.struct("text", "gone"), F.struct("place", "gone", F.coalesce("text", F.lit("")))).alias("e"))
    return events.join(twice, "did", "left_anti").select("did", "text", "gone").unionByName(again.select("did", "e.*"))


def _live(rows: DataFrame) -> DataFrame:
    """(did, dl, terms) of the versions that are there, from rows of some ids over all batches."""
    seen = rows.groupBy("did").agg(F.sum("n").alias("n"), F.max_by(F.struct("dl", "terms"), F.when(F.col("n") > 0, F.col("batch"))).alias("v"))
    return seen.filter("n > 0").select("did", "v.*")


def upsert(events: DataFrame, number: int, folder: str, did: str, text: str = "text", deleted: str | None = None, order: str | None = None, tokenize=T.tokens) -> None:
    """Add batch ``number``: the last event of each id replaces what the batches before hold of it, or deletes it where ``deleted`` is true.

    The last event is the one with the greatest ``order`` and then the greatest text, so repeated rows don't matter. A null text is a document without
    tokens. Events with a null id are left out, as nothing could replace them. Deleting an unknown id changes nothing.
    """
    spark, schema = events.sparkSession, _docs(dict(events.dtypes)[did])
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    place = F.col(order) if order else F.lit(0)
    rows = events.filter(F.col(did).isNotNull()).select(F.col(did).alias("did"), F.col(text).alias("text"), gone.alias("gone"), place.alias("place"))
    old = _read(spark, folder, "docs", schema, number).filter("n IS NOT NULL")
    known = _few(old.select("did").join(rows.select("did"), "did", "left_semi").distinct())
    withdrawn = _live(old.join(known, "did", "left_semi")).select("did", F.lit(-1).cast("long").alias("n"), "dl", "terms")
    new = lexical.to_count(_last(rows).filter(~F.col("gone")).select("did", "text"), tokenize)
    new = lexical.counted(new).withColumn("n", F.when(F.col("dl").isNotNull(), F.lit(1).cast("long"))).withColumn("dl", F.col("dl").cast("long"))
    new.unionByName(withdrawn, allowMissingColumns=True).write.mode("overwrite").parquet(f"{folder}/docs/batch={number}")
    mine = spark.read.schema(f"{schema}, tok string, df long").parquet(f"{folder}/docs/batch={number}")
    gone = mine.filter("n < 0").select(F.explode("terms.tok").alias("tok"), F.lit(-1).cast("long").alias("df"))
    parts = mine.filter("tok IS NOT NULL").select("tok", "df").unionByName(gone)
    parts.groupBy("tok").agg(F.sum("df").alias("df")).filter("df <> 0").write.mode("overwrite").parquet(f"{folder}/df/batch={number}")


def start(stream: DataFrame, folder: str, did: str, text: str = "text", deleted: str | None = None, order: str | None = None, first: int = 0, available_now: bool = True):
    """Keep the tables below ``folder`` up to date with a stream of events. Batches are numbered from ``first``, for a folder that holds some already."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, first + number, folder, did, text, deleted, order)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint-{first}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def index(spark: SparkSession, folder: str, key: str = "long", vocabulary: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> lexical.Bm25:
    """The BM25 statistics of all documents that are there now, for ``lexical.search``.

    N, the mean length and idf are sums. A document that was never withdrawn is taken as it is; versions of the others cancel first. With a
    ``vocabulary`` (tok), other tokens' postings are left out. ``key`` is the type of the ids.
    """
    rows = _read(spark, folder, "docs", _docs(key)).filter("n IS NOT NULL")
    n, total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("dl")), F.lit(0))).first()
    df = _read(spark, folder, "df", "tok string, df long").groupBy("tok").agg(F.sum("df").alias("df")).filter("df > 0")
    touched = _few(rows.filter("n < 0").select("did").distinct())
    live = rows.join(touched, "did", "left_anti").select("did", "dl", "terms").unionByName(_live(rows.join(touched, "did", "left_semi")))
    if vocabulary is not None:
        words = vocabulary.select("tok").distinct()
        few = [r.tok for r in words.limit(WORDS + 1).collect()]
        if len(few) <= WORDS:  # with more, searches pass over the others
            live = live.withColumn("terms", F.filter("terms", lambda t: t.tok.isin(few)))
    return lexical.Bm25(live.select("did"), live, lexical.idf_of(df, n, epsilon), n, total / n if n else 0.0, k1, b)
