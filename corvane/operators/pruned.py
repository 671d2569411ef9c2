"""Exact BM25 top-k that leaves out what can't be among the best: postings in blocks with the highest part of a score in each.

Documents are dealt into blocks by a hash of their id. A row of the index is one token in one block: its documents, their parts of a score
for one occurrence in the query, and the highest of them. The sum of a query's highest parts in a block bounds the score of every document there. A
search scores each query's most promising blocks first; the k-th best score found is a threshold that no document of a block with a
lower bound can reach, so those blocks' postings aren't scored. All others are, so the result is that of ``lexical.search``, ties included.
Blocks are buckets' work: bounds and scores are summed where the blocks lie, and only the best of each bucket are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical
from corvane.scratch import Scratch, dealt, sweep

#: Scores are rounded to six places before they rank; a bound that misses the threshold by less than this stays.
MARGIN = 2e-6
#: Fewer pairs of a query and a block than this are broadcast: two numbers each.
FEW = 1_000_000


@dataclass(frozen=True)
class Blocks:
    """``heads`` (tok, blk, n, most) and ``postings`` (tok, blk, found: array of did and part)."""

    heads: DataFrame
    postings: DataFrame
    scratch: Scratch


def build(index: lexical.Bm25, docs_per_block: int = 512, vocabulary: DataFrame | None = None) -> Blocks:
    """Blocks of about ``docs_per_block`` documents, each file in the order of tokens, so that a token's rows lie together.

    With a ``vocabulary`` (tok), for searches whose tokens are all in it, other tokens' postings are left out before the shuffle.
    """
    spark = index.postings.sparkSession
    scratch = Scratch(spark, "blocks")
    sweep(spark)  # the shuffle that made the postings may go before they are shuffled again
    idf = index.idf.select("tok", "idf")
    if vocabulary is not None:
        words = vocabulary.select("tok").distinct()
        small = lexical.size_of(words) < lexical.SMALL
        idf = idf.join(F.broadcast(words) if small else words, "tok", "left_semi")
        idf = F.broadcast(idf) if small else idf
    count = max(1, -(-index.n // docs_per_block))
    norm = F.col("tf") + index.k1 * (1 - index.b + index.b * F.col("dl") / F.lit(index.avgdl or 1.0))
    part = F.col("idf") * F.col("tf") * (index.k1 + 1) / norm
    rows = index.postings.join(idf, "tok").select("tok", F.pmod(F.xxhash64("did"), F.lit(count)).alias("blk"), F.struct("did", part.alias("part")).alias("p"))
    # dealt by block alone, so that all tokens of a document lie in one bucket; a block holds few documents, so lists are short whatever the token
    made = dealt(rows, "blk").groupBy("tok", "blk").agg(F.collect_list("p").alias("found"))
    made = made.select("tok", "blk", F.size("found").cast("long").alias("n"), F.array_max(F.transform("found", lambda p: p.part)).alias("most"), "found")
    table = scratch.bucketed("postings", made, "blk")
    return Blocks(table.select("tok", "blk", "n", "most"), table.select("tok", "blk", "found"), scratch)


def _scored(blocks: Blocks, terms: DataFrame, pairs: DataFrame, small: bool) -> DataFrame:
    """(qid, did, score) of all documents of the pairs' (qid, blk) blocks that have one of the query's tokens.

    With ``small``, terms and pairs are broadcast, and scores are summed in the blocks' buckets without a shuffle.
    """
    hint = F.broadcast if small else lambda df: df
    wanted = blocks.postings.join(hint(terms), "tok").join(hint(pairs), ["qid", "blk"])
    parts = wanted.select("blk", "qid", "qf", F.explode("found").alias("p"))
    return parts.groupBy("blk", "qid", F.col("p.did").alias("did")).agg(F.round(F.sum(F.col("qf") * F.col("p.part")), 6).alias("score")).filter("score > 0").drop("blk")


def search(blocks: Blocks, queries: DataFrame, qid: str, text: str, k: int = 10, seeds: int = 4, tokenize=T.tokens) -> DataFrame:
    """(qid, did, score, rank) of the best ``k`` documents with a positive score, the same rows as ``lexical.search``."""
    return run(blocks, queries, qid, text, k, seeds, tokenize)[0]


def run(blocks: Blocks, queries: DataFrame, qid: str, text: str, k: int = 10, seeds: int = 4, tokenize=T.tokens) -> tuple[DataFrame, DataFrame]:
    """The result, and the work (qid, postings, postings_read, blocks, blocks_read): what its blocks hold and what was read of them.

    The ``seeds`` blocks with the highest bounds are scored first. A query without ``k`` documents there has no threshold and reads all its blocks.
    """
    scratch = Scratch(queries.sparkSession, "pruned")
    terms = scratch.table("terms", lexical.query_terms(queries, qid, text, tokenize))
    small = lexical.size_of(terms) < lexical.SMALL
    heads = blocks.heads.join(F.broadcast(terms) if small else terms, "tok")
    bounds = heads.groupBy("qid", "blk").agg(F.sum(F.greatest(F.col("qf") * F.col("most"), F.lit(0.0))).alias("bound"), F.sum("n").alias("n"))
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "blk")
    bounds = scratch.table("bounds", bounds.withColumn("place", F.row_number().over(order)))
    few = small and bounds.count() < FEW
    first = scratch.table("first", lexical.top(_scored(blocks, terms, bounds.filter(F.col("place") <= seeds).select("qid", "blk"), few), k))
    least = first.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))  # a row for each query
    rest = bounds.filter(F.col("place") > seeds).join(least, "qid", "left").withColumn("needed", F.coalesce(F.col("bound") >= F.col("least") - MARGIN, F.lit(True)))
    more = _scored(blocks, terms, rest.filter("needed").select("qid", "blk"), few)
    result = lexical.top(first.drop("rank").unionByName(lexical.top(more, k).drop("rank")), k)
    seen = bounds.filter(F.col("place") <= seeds).select("qid", "n", F.lit(True).alias("needed")).unionByName(rest.select("qid", "n", "needed"))
    read = lambda c: F.sum(F.when(F.col("needed"), c).otherwise(F.lit(0)))
    work = seen.groupBy("qid").agg(F.sum("n").alias("postings"), read(F.col("n")).alias("postings_read"), F.count("*").alias("blocks"), read(F.lit(1)).alias("blocks_read"))
    return result, work
