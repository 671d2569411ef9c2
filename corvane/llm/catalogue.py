"""Queries of the training-text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import centroids, decontaminate, exact_dedup, language, minhash, packing, pieces, pii, secrets, sharding, toxicity, url_filter, whitening
from .shared import documents, small_batches


def op1_toxicity(spark, sf_dir):
    """A toxicity score for every document; a third of the ids is held out of training."""
    small_batches(spark)
    return toxicity.score_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_minhash(spark, sf_dir):
    """Near-duplicate documents on 4-word shingles at a similarity of 0.8 or more."""
    return minhash.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op3_sharding(spark, sf_dir):
    """Jump consistent hashing of all documents into 24 shards."""
    return sharding.shard(documents(spark, sf_dir), 24)


def op4_sentencepiece(spark, sf_dir):
    """All documents through the 32k piece model and back."""
    import public_tokenizers

    small_batches(spark)
    return pieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_secret_scan(spark, sf_dir):
    """Candidates for secrets in every document, scored by the forest; digests stand for the strings."""
    return secrets.redacted(documents(spark, sf_dir))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_url_filter(spark, sf_dir):
    """A verdict for every page's url."""
    return url_filter.judge(documents(spark, sf_dir, "pages"), URL_RULES)


def op7_decontamination(spark, sf_dir):
    """Words of every document inside ten-word phrases of the benchmark."""
    small_batches(spark)
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op8_pii(spark, sf_dir):
    """Personal data in every document."""
    small_batches(spark)
    return pii.find_pii(documents(spark, sf_dir))


def op9_exact_dedup(spark, sf_dir):
    """Groups of equal texts over all documents."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_language_id(spark, sf_dir):
    """Language of every document and every page, with doc_id or page_id.

    A document's lang column is its declared language and its source the host; it has no address, so no suffix. A page's
    evidence comes from its markup and url. Documents train the text model for both; each table has its own evidence tables.
    """
    docs = documents(spark, sf_dir)
    model = language.fit(docs, "doc_id", "text", "lang")
    of_docs = language.identify(docs, declared="lang", host="source", model=model)
    return of_docs.unionByName(language.identify_pages(documents(spark, sf_dir, "pages"), model=model), allowMissingColumns=True)


def op11_whitening(spark, sf_dir):
    """All vectors on their eight leading components. A deviation beyond a long is null there and whole in deviation_exact."""
    small_batches(spark)
    done = whitening.whiten(documents(spark, sf_dir, "embeddings"))
    return done.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.col("deviation").try_cast("long")})


def op12_packing(spark, sf_dir):
    """All documents as sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_centroids(spark, sf_dir):
    """All vectors in 16 clusters after three rounds."""
    return centroids.cluster(documents(spark, sf_dir, "embeddings"))


_ALL = (
    op1_toxicity, op2_minhash, op3_sharding, op4_sentencepiece, op5_secret_scan, op6_url_filter, op7_decontamination, op8_pii, op9_exact_dedup,
    op10_language_id, op11_whitening, op12_packing, op13_centroids,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op2_minhash": minhash.ORACLE_SQL, "op7_decontamination": decontaminate.ORACLE_SQL, "op3_sharding": sharding.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op13_centroids": centroids.oracle_sql(),
}
