"""Retrieval benchmarks from documents: queries, judgments, splits, templates and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import lexicon as lex
from corvane.functions import text as T
from corvane.scratch import Scratch

_SPACE = r"(?U)\s+"


def broken_spacing(q: Column) -> Column:
    """Four words or more of which at least half are single characters."""
    words = F.filter(F.split(q, _SPACE), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    return (F.size(words) >= 4) & (single * 2 >= F.size(words))


def metadata_query(q: Column) -> Column:
    """A case number, or nothing but digits and their separators."""
    return F.regexp_like(q, F.lit(r"(?U)\b[ek]\.\s*\d+")) | F.regexp_like(q, F.lit(r"(?U)^[\d/.\s-]+$"))


def _normed(words) -> Column:
    """The normalised words, each by itself, so that Spark makes a constant of them."""
    return F.array(*[T.norm_query(F.lit(w)) for w in words])


def bad_query(q: Column, stop=lex.STOP_QUERIES, generic=lex.GENERIC_QUERIES) -> Column:
    """Whether a query says too little: a stop phrase, broken letters, numbers only, one word, or generic words only."""

    def judge(n: Column) -> Column:
        words = F.filter(F.split(n, _SPACE), lambda w: w != "")
        return (
            F.array_contains(_normed(stop), n)
            | broken_spacing(n)
            | metadata_query(n)
            | F.regexp_like(n, F.lit(r"(?U)^(madde|md|m)\.?\s*\d+$"))
            | (F.size(words) < 2)
            | F.array_contains(_normed(generic), n)
            | (F.size(F.array_except(words, _normed(generic))) == 0)
        )

    return T.let(T.norm_query(q), judge)


def first_by_key(items: Column, key) -> Column:
    """Items in order, without those whose key has come before. Items and keys are computed once, not once an item."""

    def firsts(both: Column) -> Column:
        return F.filter(both.xs, lambda x, i: F.array_position(both.ks, F.get(both.ks, i)) == i + 1)

    return T.let(items, lambda xs: T.let(F.struct(xs.alias("xs"), F.transform(xs, key).alias("ks")), firsts))


def candidate_queries(text: Column, statutes: Column, heading: str = lex.SILVER_HEADING, subject: str = lex.SUBJECT, size: int = 120) -> Column:
    """Structs (text, type): the subject line and headings of the first 800 characters (semantic), two statutes (lexical)."""
    head = F.substring(text, 1, 800)
    typed = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.substring(x, 1, size).alias("text"), F.lit(kind).alias("type")))
    good = lambda xs: F.filter(xs, lambda x: ~bad_query(x))
    line = F.filter(F.array(T.strip(F.regexp_extract(head, "(?U)" + subject, 1))), lambda x: x != "")
    caps = F.transform(F.regexp_extract_all(head, F.lit("(?U)" + heading), F.lit(1)), T.strip)
    cited = F.transform(F.slice(F.coalesce(statutes, F.array().cast("array<string>")), 1, 2), T.strip)
    found = F.concat(typed(good(line), "semantic"), typed(F.transform(good(caps), F.lower), "semantic"), typed(good(cited), "lexical"))
    return first_by_key(found, lambda x: T.norm_query(x.text))


def training_queries(text: Column, heading: str = lex.TRAINING_HEADING, subject: str = lex.SUBJECT, stop=lex.TRAINING_STOP_QUERIES) -> Column:
    """Lower-cased headings of the first 600 characters, then the subject line cut to 80."""
    head = F.substring(text, 1, 600)
    allowed = lambda q: ~F.array_contains(T.words_literal(stop), q) & ~metadata_query(q)
    caps = F.transform(F.regexp_extract_all(head, F.lit("(?U)" + heading), F.lit(1)), lambda h: F.lower(T.strip(h)))
    caps = F.filter(caps, lambda q: (F.length(q) > 8) & (F.length(q) < 100) & (F.size(F.filter(F.split(q, _SPACE), lambda w: w != "")) >= 2) & allowed(q))
    line = F.filter(F.array(F.substring(F.lower(T.strip(F.regexp_extract(head, "(?U)" + subject, 1))), 1, 80)), lambda q: (q != "") & allowed(q))
    return F.concat(caps, line)


def shuffled(key: Column, seed: int) -> Column:
    """A sort key that shuffles alike in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(str(seed))))


def silver(decisions: DataFrame, most: int = 2, seed: int = 42, markers=lex.CONTENT_MARKERS, heading: str = lex.SILVER_HEADING, subject: str = lex.SUBJECT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of decisions (karar_id, text, title, kanunlar, kurul, esas_no, karar_no, tarih, ord).

    The picked queries are short and lie in a scratch table, as texts are searched for them once, however often queries and qrels are read.
    Of decisions with one id, the corpus has the last by ord; queries of theirs with one name are the last one's.
    At most ``most`` candidates a decision, picked by their hash with the seed.
    """
    named = decisions.withColumn("did", F.concat(F.lit("d"), F.col("karar_id").cast("string")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    row = F.struct("did", empty("title"), T.informative_passage(F.col("text"), markers).alias("text"), empty("kurul"), empty("esas_no"), empty("karar_no"), empty("tarih"))
    corpus = named.groupBy(F.col("did").alias("_d")).agg(F.max_by(row, "ord").alias("r")).select("r.*")
    cand = F.transform(candidate_queries(F.col("text"), F.col("kanunlar"), heading, subject), lambda x: F.struct(shuffled(F.concat(F.col("did"), F.lit("|"), x.text), seed).alias("k"), x.text.alias("text"), x.type.alias("type")))
    picked = named.select("did", "karar_id", "ord", F.posexplode(F.slice(F.array_sort(cand), 1, most)).alias("j", "x"))
    picked = picked.select("did", "ord", F.concat(F.lit("q"), F.col("karar_id").cast("string"), F.lit("_"), F.col("j")).alias("qid"), "x.text", "x.type")
    picked = Scratch(decisions.sparkSession, "silver").table("picked", picked)
    queries = picked.groupBy("qid").agg(F.max_by(F.struct("text", "type"), "ord").alias("r")).select("qid", "r.*")
    return corpus, queries, picked.select("qid", "did", F.lit(1).alias("rel"))


def silver_stats(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(name, n): sizes, and queries of each type."""
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    kinds = queries.groupBy(F.concat(F.lit("type_"), F.coalesce("type", F.lit("unknown"))).alias("name")).agg(F.count("*").alias("n"))
    return size(corpus, "corpus").union(size(queries, "queries")).union(size(qrels, "qrels")).union(kinds)


def split_of(ids: DataFrame, key: str, seed: int = 42, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """(key, split): train, dev and test shares of the shuffled distinct keys, by whole numbers rounded down.

    Places in the shuffled order come from ranges of the hash: each range is numbered by itself after the counts of
    the ranges before it, so no task sorts all keys.
    """
    parts = 4096
    rows = ids.select(key).distinct().withColumn("_k", shuffled(F.col(key), seed))
    rows = rows.withColumn("_part", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # at most 4096 rows
    assert parts == 16**3
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_k", key)) + F.col("_before")
    cut, cut2 = int(n * train), int(n * train) + int(n * dev)
    return rows.join(offsets, "_part").withColumn("_at", at).select(key, F.when(F.col("_at") <= cut, "train").when(F.col("_at") <= cut2, "dev").otherwise("test").alias("split"))


def disjoint(splits: DataFrame, key: str) -> DataFrame:
    """One row (overlaps): how many keys are in more than one split."""
    return splits.groupBy(key).agg(F.countDistinct("split").alias("_n")).agg(F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0).cast("long")).alias("overlaps"))


def gold_template(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, sample: int = 150, seed: int = 42) -> DataFrame:
    """Rows to annotate: ``sample`` shuffled queries with their judged documents, a 300-character excerpt and an empty relevance."""
    picked = queries.withColumn("_k", shuffled(F.col("qid"), seed)).orderBy("_k", "qid").limit(sample).drop("_k")
    rows = picked.join(qrels.select("qid", "did"), "qid").join(corpus.select("did", F.col("title").alias("_title"), F.col("text").alias("_text")), "did", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        F.col("qid").alias("query_id"),
        F.col("text").alias("query_text"),
        text("type").alias("query_type"),
        F.col("did").alias("candidate_doc_id"),
        text("_title").alias("candidate_title"),
        F.replace(F.substring(text("_text"), 1, 300), F.lit("\n"), F.lit(" ")).alias("candidate_excerpt"),
        F.lit("").alias("relevance_0_1_2"),
    )


def fallback_query(text: Column) -> Column:
    """The first sentence of the first 1500 characters that is long enough and no formality."""
    banned = ["i̇çtihat", "mahkemesi", "esas"]
    ok = lambda s: (
        (F.length(s) > 40) & (F.length(s) < 200) & ~metadata_query(F.lower(s)) & ~F.contains(F.split(F.lower(s), " ")[0], F.lit("karar"))
    )
    for word in banned:
        ok = (lambda before, w: lambda s: before(s) & ~F.contains(F.lower(s), F.lit(w)))(ok, word)
    found = F.filter(T.sentences(F.substring(text, 1, 1500)), ok)
    return F.transform(F.slice(found, 1, 1), lambda s: F.substring(F.lower(s), 1, 180))


def training_pairs(decisions: DataFrame, most: int = 3, least: int = 400, seed: int = 42, heading: str = lex.TRAINING_HEADING, subject: str = lex.SUBJECT) -> DataFrame:
    """(karar_id, query, passage) of decisions (karar_id, text, title, konu, kanunlar).

    Queries come from headings, the subject, statutes and the title, else from the first telling sentence. Each is paired
    with one of the decision's passages of at least ``least`` characters, chosen by a hash of the two.
    """
    allowed = lambda q: ~F.array_contains(T.words_literal(lex.TRAINING_STOP_QUERIES), q) & ~metadata_query(q)
    one = lambda c: F.filter(F.array(F.lower(F.coalesce(c, F.lit("")))), lambda q: (q != "") & allowed(q))
    low = F.lower(F.coalesce(F.col("title"), F.lit("")))
    at = F.instr(low, " - ")
    rest = F.when(at > 0, F.substring(low, at + F.lit(3), F.length(low))).otherwise("")
    cited = F.transform(F.slice(F.coalesce(F.col("kanunlar"), F.array().cast("array<string>")), 1, 2), F.lower)
    queries = F.concat(training_queries(F.col("text"), heading, subject), one(F.col("konu")), cited, one(rest))
    queries = F.array_distinct(F.filter(queries, lambda q: (F.length(q) > 8) & (F.length(q) < 200)))
    rows = decisions.filter(F.length("text") >= 2 * least).withColumn("_q", queries)
    rows = rows.withColumn("_q", F.when(F.size("_q") == 0, fallback_query(F.col("text"))).otherwise(F.slice("_q", 1, most)))
    rows = rows.filter(F.size("_q") > 0).withColumn("_c", F.filter(chunking.chunks(F.col("text"), 1200, 100), lambda c: F.length(c) >= least)).filter(F.size("_c") > 0)
    pairs = rows.select("karar_id", "_c", F.explode("_q").alias("query"))
    hashed = F.conv(F.substring(shuffled(F.concat(F.col("karar_id").cast("string"), F.lit("|"), F.col("query")), seed), 1, 8), 16, 10).cast("long")
    return pairs.select("karar_id", "query", F.element_at("_c", (hashed % F.size("_c") + 1).cast("int")).alias("passage"))
