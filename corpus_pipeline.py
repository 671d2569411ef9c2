"""The corpus pipeline: documents through five operators, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns it was given; the
last one returns the encoded documents. ``sf_dir`` also holds the benchmark that documents must not contain.

In all stages a null text counts as empty, texts of any length are read whole, columns beside doc_id and text may have any name and
hold nulls, and an empty table stays empty. What each stage does with ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, exact_dedup, language, minhash, pieces
from corvane.llm.shared import Scratch, released, small_batches


def _guarded(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The documents with names that no result column has, and those of all but the id."""
    docs = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})
    return docs, tuple(c for c in docs.columns if c != "in_doc_id")


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[found[f"in_{c}"].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (10): documents without a confident language go.

    A text without words has no language, so empty and null texts go. Repeated rows are judged alike and stay as often as they came; a tie
    of languages leaves no confidence. Without a lang or source column that evidence is neutral.
    """
    rows, rest = _guarded(docs)
    value = lambda c: f"in_{c}" if c in docs.columns else None
    found = language.identify(rows, "in_doc_id", "in_text", declared=value("lang"), host=value("source"), label=value("lang"), keep=rest)
    return _restored(found.filter("kept"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (9): of equal texts the largest doc_id stays, once.

    Of rows that repeat this id and its text, the one whose other columns come first as JSON stays. Rows without an id stay only where
    no equal text has one. All empty and null texts are one group.
    """
    rows, rest = _guarded(docs)
    # an id as text is never "null", so rows without one meet as well, and one deal by (_key, _sha) serves both steps
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("_key")
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(key("doc_id"), F.col("text_sha256").alias("_sha"))
    other = [c for c in rest if c != "in_text"]
    order = F.to_json(F.struct(*other)) if other else F.lit("")
    sha = F.sha2(F.coalesce("in_text", F.lit("")), 256).alias("_sha")
    first = rows.groupBy(key("in_doc_id"), sha).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return _restored(first.join(kept, ["_key", "_sha"], "left_semi").select("_row.*"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (2): of each group of near copies on five words the smallest doc_id stays.

    Texts without words and rows without an id are near copies of nothing and stay. Rows that repeat an id go or stay together.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): benchmark passages are cut out; a document that loses its last word goes.

    A document that had no words stays. n_chars follows the text where it was cut. Repeated rows are treated alike.
    """
    small_batches(spark)
    rows, rest = _guarded(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_benchmark(rows, benchmark, "in_doc_id", "in_text", clean=True, keep=tuple(c for c in rest if c != "in_text"))
    found = found.filter("n_hit = 0 OR n_hit < n_words").withColumn("in_text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        found = found.withColumn("in_n_chars", F.when(F.col("n_hit") > 0, F.length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("in_n_chars")))
    return _restored(found, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (4) of what is left, a row for each row; an empty text has the end id only."""
    import public_tokenizers

    small_batches(spark)
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("decontaminate", decontaminate_benchmark),
    ("encode", encode),
]

#: Language, near copies and piece ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's own tables go when its result is written, and that goes when the next one's is. What the last stage reads stays
    until ``release`` is called or the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        with released(keep=scratch):
            docs = scratch.table(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
