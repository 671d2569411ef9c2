"""Models as plug-ins, the markup parser, the loader's counts, and the bucketed index' plans."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corvane.functions import markup, models
from corvane.functions import text as T
from corvane.operators import answers, grounding, lexical, rerank
from corvane.plans import index, queries
from corvane.sources import decisions, sinks

FOLDER = "/root/testdata/sf0.001"


def logged(folder, name, model):
    """A loader that leaves a file for each call, named by process."""

    def load():
        import os
        import uuid

        with open(f"{folder}/{name}-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            return model

    return load


def loads(folder, name):
    """(calls, processes) of a loader."""
    found = [f.split("-")[1] for f in os.listdir(folder) if f.startswith(f"{name}-")]
    return len(found), len(set(found))


def test_pages_parsed_a_few_at_a_time(spark):
    """A worker hands texts on a few pages at a time, however large its batches, and each page gets its own text."""
    pages = [None if i % 7 == 0 else f"<p>page {i}<br>x</p>" for i in range(3 * markup.HELD + 5)]
    made = list(markup.texts_of(iter([pa.array(pages, pa.string()), pa.array([], pa.string())])))
    assert max(map(len, made)) <= markup.HELD and pa.chunked_array(made).to_pylist() == [markup.text_of(h) for h in pages]
    got = spark.createDataFrame(list(enumerate(pages)), "i long, h string").coalesce(1).select("i", markup.parsed_html(F.col("h")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: markup.text_of(h).strip() for i, h in enumerate(pages)}


def test_models_load_once_in_a_process(spark, tmp_path):
    """Generation, the safety comparison, the index and reranking run with Python models; each process calls a loader once for all its tasks."""
    asked = spark.createDataFrame([(i, f"kira soru {i}") for i in range(40)], "qid long, query string").repartition(8)
    rows = [(i, p, 0.03 + p / 100, f"k{p}", "1", "2", f"kira davası metni {i} uzun bir cümle.") for i in range(40) for p in (1, 2)]
    results = spark.createDataFrame(rows, "qid long, pos int, score double, kurul string, esas_no string, karar_no string, text string").repartition(8)
    say = models.generator(logged(tmp_path, "say", lambda prompts: [f"Kira sözleşmesi sona erer [Karar 1]. {len(p)}" for p in prompts]))
    entails = models.scorer(logged(tmp_path, "entails", lambda a, b: [float("kira" in x.lower()) for x in a]))
    made = grounding.generate(asked, results, say).collect()
    assert len(made) == 40 and all(r.answer == f"Kira sözleşmesi sona erer [Karar 1]. {len(r.prompt)}" for r in made)
    safe = grounding.safety_comparison(asked, results, say, entails).collect()
    assert {(r.grounded_faithfulness, r.grounded_valid_citations) for r in safe} == {(1.0, 1)} and {r.plain_faithfulness for r in safe} == {1.0}
    docs = spark.createDataFrame([(i, "Uzun bir cümle burada durur. " * 60) for i in range(30)], "doc_id long, text string").repartition(8)
    encode = models.encoder(logged(tmp_path, "encode", lambda texts: [[len(t), t.startswith("passage: ")] for t in texts]))
    for _ in range(2):
        built = index.build(docs, encode).collect()
        assert built and all(list(r.embedding) == [len(r.text) + len("passage: "), 1.0] for r in built)
    pairs = asked.crossJoin(spark.createDataFrame([(1, 1, "kira"), (2, 2, "x")], "did int, rank int, text string"))
    best = rerank.rerank(pairs, models.scorer(logged(tmp_path, "rank", lambda q, t: [float(len(x)) for x in t])), top_k=1).collect()
    assert {(r.did, r.score) for r in best} == {(1, 4.0)} and len(best) == 40
    for name in ("say", "entails", "encode", "rank"):
        calls, processes = loads(tmp_path, name)
        assert calls == processes > 0, name


def test_models_take_nulls(spark):
    rows = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    got = rows.select(models.encoder(lambda: lambda ts: [[len(t)] for t in ts])("x"), models.scorer(lambda: lambda a, b: [len(p) - len(q) for p, q in zip(a, b)])("x", "y")).collect()
    assert [(list(r[0]), r[1]) for r in got] == [([0.0], -1.0), ([1.0], 1.0)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ('<a title="x > y">one</a><p>two', "one\ntwo"),
        ("<b><i>crossed</b></i> and <li>open<li>items", "crossed\n and\nopen\nitems"),
        ("<script>if (a < b) { '<p>no</p>' }</script>yes<style>p > q {}</style>", "yes"),
        ("a<!-- <p>no</p> -->b<!DOCTYPE html>c", "a\nb\nc"),
        ("&eacute;&#233;&amp;lt; &unknown; &lt;b&gt;", "éé&lt; &unknown; <b>"),
        ("a\n \n\n b  \t c<br/>d<br>e", "a\n b c\nd\ne"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<p>" * 5000 + "deep", "deep"),
    ],
)
def test_parser(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(markup.parsed_html(F.col("h"))).first()[0] == want


def test_parser_on_pages(spark):
    """Every page, also with its markup damaged, gives what the parser gives outside Spark; undamaged pages mostly what the expressions give."""
    import re

    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rng = random.Random(1)
    damaged = [(i, re.sub("<[^>]*>", lambda m: m.group() if rng.random() < 0.8 else rng.choice(["", "<b", "</p>", '<x y=">">']), h)) for i, h in pages]
    for rows in (pages, damaged):
        table = spark.createDataFrame(rows, "i long, h string")
        got = {r.i: r.t for r in table.select("i", markup.parsed_html(F.col("h")).alias("t")).collect()}
        for i, h in rows:
            t = re.sub(r"\n{3,}", "\n\n", re.sub(r"\s+\n", "\n", markup.text_of(h)))
            assert got[i] == re.sub(r"[ \t]+", " ", t).strip()
    plain = {r.i: r.t for r in spark.createDataFrame(pages, "i long, h string").select("i", T.clean_html(F.col("h")).alias("t")).collect()}
    whole = {r.i: r.t for r in spark.createDataFrame(pages, "i long, h string").select("i", markup.parsed_html(F.col("h")).alias("t")).collect()}
    assert sum(plain[i] == whole[i] for i in plain) > 0.98 * len(plain)


def test_loader_counts_in_one_scan(spark):
    """Counts by hand, from the same action that reads the decisions; the table is scanned once."""
    sizes = [499, 500, 501, 15_000, 15_001, 0]
    rows = [(i, str(i), None, None, None, "s", "x" * n if n else None) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "ord int, id string, esasNo string, kararNo string, kararTarihi string, source string, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counts = Observation("load")
    kept = decisions.from_hub(table.mapInArrow(count, table.schema), n=None, counts=counts).collect()
    assert counts.get == {"seen": 6, "kept": 4, "short": 2, "cut": 1} and len(kept) == 4 and seen.value == 6


def exchanges(df):
    """The plan's shuffles, adaptive or not."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_bucketed_index_needs_no_exchange(spark, tmp_path):
    """Grouping and joining by document reads the buckets as they are, in the session that wrote them and in one that enters them again."""
    table = queries._passages(spark, FOLDER).withColumnRenamed("doc_id", "karar_id")
    sinks.write_bucketed_index(table, "index_here", f"{tmp_path}/index", 6)
    again = decisions.read_bucketed_index(spark, "index_again", f"{tmp_path}/index", 6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bucketed in (spark.table("index_here"), again):
            texts = answers.full_text(bucketed)
            assert exchanges(texts) == 0 and exchanges(answers.full_text(table)) == 1
            assert sorted(texts.collect()) == sorted(answers.full_text(table).collect())
            hits = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "qid int, karar_id long")
            assert exchanges(hits.join(bucketed, "karar_id")) == 1 and exchanges(hits.join(table, "karar_id")) == 2
            assert hits.join(bucketed, "karar_id").count() == hits.join(table, "karar_id").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("index_here", "index_again"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_summary_joins_bucketed(spark, tmp_path):
    """Results' records come from the bucketed index: only the hits are dealt by document before the summary is made by query."""
    docs = queries._docs(spark, FOLDER).select(F.col("doc_id").alias("karar_id"), F.lit(0).alias("chunk_idx"), F.col("source").alias("kurul"), "text", T.statutes(F.col("text"), (queries.STATUTE,)).alias("kanunlar"))
    bucketed = sinks.write_bucketed_index(docs, "records_here", f"{tmp_path}/records", 6)
    hits = lexical.top(spark.createDataFrame([(q, d, 1.0 / (d + 1)) for q in (1, 2) for d in range(20)], "qid int, karar_id long, score double"), 10, "karar_id").withColumnRenamed("rank", "pos")
    want = sorted(map(str, answers.result_summary(hits.join(docs, "karar_id")).collect()))
    assert sorted(map(str, answers.result_summary(hits.join(bucketed, "karar_id")).collect())) == want and len(want) == 2
    assert exchanges(hits.hint("merge").join(bucketed, "karar_id")) < exchanges(hits.hint("merge").join(docs, "karar_id"))
    spark.sql("DROP TABLE records_here")
