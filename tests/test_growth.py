"""Work that must not be repeated as tables grow: plans, and results on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import text as T
from corvane.operators import benchmarking, lexical, relevance
from corvane.plans import queries
from corvane.scratch import spread

TEXTS = ["The token, and LICENSED under", None, "", "que\n pas; Velayet", "2004 SAYILI icra", "Nafaka boşanma-tazminat"]


@pytest.mark.parametrize(("name", "norm", "loop"), [("keyword_relevance", T.norm_keyword, relevance.keyword_relevant), ("graded_relevance", T.norm_graded, relevance.graded_relevance)])
def test_text_normalised_once(spark, tmp_path, name, norm, loop):
    """The rows of a loop over the queries, with the documents meeting one row of all queries instead of a row each."""
    docs = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    build = plan[plan.index("Join Cross") :]
    assert "collect_list" in build and len(re.findall(r"lower\(text#", plan)) == 1
    want = {}
    for qid, groups in queries.KEYWORDS:
        rows = docs.crossJoin(spark.createDataFrame([(groups,)], "groups array<array<string>>"))
        for r in rows.select("lang", loop(rows.groups, rows.text).alias("x")).collect():
            if name == "graded_relevance":
                want[qid, r.x] = want.get((qid, r.x), 0) + 1
            else:
                seen = want.get((qid, r.lang))
                want[qid, r.lang] = seen if r.x is None else (seen or 0) + int(r.x)
    assert {(r[0], r[1]): r[2] for r in found.collect()} == want and any(want.values())


def test_silver_searches_texts_once(spark):
    """Queries and judgments come from a table that is written once, and a text's candidates are made once, not once for each of them."""
    docs = spark.createDataFrame([(i, i, t, "", [], "k") for i, t in enumerate(["The plain cat\nSome Heading Here.\nOther Heading Here.\n", "", "La casa verde\nsome heading here.\n"])], "karar_id long, ord long, text string, title string, kanunlar array<string>, kurul string")
    docs = docs.selectExpr("*", "'' AS esas_no", "'' AS karar_no", "'' AS tarih")
    _, asked, qrels = benchmarking.silver(docs, most=5, heading=queries.HEADING, subject=queries.SUBJECT)
    assert all("regexp_extract" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (asked, qrels))
    assert sorted((r.qid[:2], r.text) for r in asked.collect()) == [("q0", "plain cat"), ("q0", "some heading here"), ("q2", "casa verde"), ("q2", "some heading here")]
    made = docs.select(benchmarking.candidate_queries(docs.text, docs.kanunlar, queries.HEADING, queries.SUBJECT).alias("c"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_containment_reads_texts_once(spark, tmp_path, monkeypatch):
    """Every pair of rows, repeated ids too, found where the texts are read; the same rows when the anchors are too many to broadcast."""
    texts = ["a bb cc dd ee ff gg a bb cc dd ee ff gg", "x bb cc dd ee ff y", None, "bb", "a bb cc dd", "zz bb  cc dd"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate([*texts, texts[0]])], "did long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    items = [(1, "a bb cc dd ee ff gg"), (2, "bb cc dd"), (2, "cc"), (3, "b cc dd ee ff y"), (4, None), (5, "a bb cc dd")]
    asked = spark.createDataFrame(items, "qid long, text string")
    want = sorted((q, d.did) for q, x in items for d in docs.collect() if x and d.text and x in d.text and len(x.split()) > 2)
    long = asked.filter("text IS NULL OR size(split(text, ' ')) > 2")
    found = relevance.containing(docs, long)
    assert sorted(map(tuple, found.collect())) == want and len(want) > len(set(want))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == len({min(5, len(x.split()) - 2) for _, x in items if x and len(x.split()) > 2})
    monkeypatch.setattr(relevance, "ITEMS", 0)
    assert set(map(tuple, relevance.containing(docs, asked).collect())) == {(q, d.did) for q, x in items for d in docs.collect() if x and d.text and x in d.text}


def test_texts_cut_once(spark, tmp_path):
    """No filter on the passages, or on the tokens, is put before the rows are dealt."""
    spark.createDataFrame([(1, "a b. " * 300), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    made = chunking.chunk_records(docs)
    assert made.count() == 2 and "Filter (size(" not in made._jdf.queryExecution().optimizedPlan().toString()
    index = lexical.fit(docs, "doc_id", "text", lambda t: F.split(t, " "))
    assert index.n == 2 and index.postings.filter("tok IS NULL").count() == 0


def test_documents_scored_in_their_rows(spark, monkeypatch):
    """Scores from the documents' rows are those of joined postings: ties, words that count against a document, no text, and slices of few documents."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(f"d{i:02d}", " ".join(rng.choices(["kira", "tapu", "miras", "icra", "haciz"], [9, 4, 2, 1, 1], k=rng.randrange(7))) or None) for i in range(70)], "did string, text string")
    asked = spark.createDataFrame([("a", "kira kira icra"), ("b", "tapu miras"), ("c", "yok"), (None, "haciz")], "qid string, text string")
    index = lexical.fit(docs, "did", "text", vocabulary=lexical.query_terms(asked, "qid", "text"))
    whole = lexical.fit(docs, "did", "text")
    assert index.idf.count() == whole.idf.count() == 5 and (index.n, index.avgdl) == (whole.n, whole.avgdl)
    assert {r.tok for r in index.postings.select("tok").distinct().collect()} == {"kira", "icra", "tapu", "miras", "haciz"}
    only = lexical.fit(docs, "did", "text", vocabulary=lexical.query_terms(asked.filter("qid = 'b'"), "qid", "text"))
    assert {r.tok for r in only.postings.select("tok").distinct().collect()} == {"tapu", "miras"} and sorted(only.idf.collect()) == sorted(whole.idf.collect())
    key = lambda df: sorted(map(str, df.collect()))
    every, best = key(lexical.scores(index, asked, "qid", "text")), [key(lexical.search(index, asked, "qid", "text", k)) for k in (1, 4, 200)]
    assert "Exchange" not in lexical.scores(index, asked, "qid", "text")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexical, "SCORES", 16)
    assert [key(lexical.search(index, asked, "qid", "text", k)) for k in (1, 4, 200)] == best
    monkeypatch.setattr(lexical, "SMALL", 0)  # joined
    assert key(lexical.scores(whole, asked, "qid", "text").select("qid", "did", "score")) == every
    assert [key(lexical.search(whole, asked, "qid", "text", k)) for k in (1, 4, 200)] == best


def test_texts_found_are_not_shuffled(spark):
    """Results go to the documents, and statutes are looked for in what was found, not in every text."""
    plan = queries._results(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.index("regexp_extract_all") < plan.index("Join Inner")


def test_ends_stripped_without_reading_the_middle(spark):
    """Every kind of white space goes at the ends, as a regular expression would have it, which is not used."""
    texts = [f"{chr(i)}a {chr(i)} b{chr(i)}\n{chr(i)}" for i in range(1, 0x3100)] + ["", " \n", None, "\r\n a\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert rows.filter("NOT got <=> want").count() == 0
    assert "regexp" not in rows.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_an_index_are_not_shuffled(spark, tmp_path):
    """Passages are cut, tokenised and counted where documents are read; only a table in few splits is dealt to all cores."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('wort', id % 7, ' und ', repeat('kira tapu. ', 30)) AS text")
    docs.repartition(8).write.parquet(f"{tmp_path}/many")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    many, one = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("many", "one"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(spread(many, "doc_id")) and "Repartition" in plan(spread(one, "doc_id"))
    a, b = lexical.fit(many, "doc_id", "text"), lexical.fit(one, "doc_id", "text")
    assert (a.n, a.avgdl) == (b.n, b.avgdl) and sorted(a.idf.collect()) == sorted(b.idf.collect())
    assert sorted(a.postings.collect()) == sorted(b.postings.collect())


def test_a_large_batch_is_counted_in_slices(spark, monkeypatch):
    """The statistics are the same when a batch is counted a few documents at a time, with as many frequencies held as one document has."""
    docs = spark.createDataFrame([(i, " ".join(f"wort{j % (i + 1)}" for j in range(30)) if i % 5 else None) for i in range(50)], "did long, text string").coalesce(1)
    rows = docs.select("did", T.tokens(F.col("text")).alias("toks"))
    whole = lexical.counted(rows)
    monkeypatch.setattr(lexical, "SLICE", 256)
    monkeypatch.setattr(lexical, "HELD", 1)
    small = lexical.counted(rows)
    terms = lambda df: sorted((r.did, r.dl, sorted(map(tuple, r.terms))) for r in df.filter("dl IS NOT NULL").collect())
    sums = lambda df: sorted(map(tuple, df.filter("tok IS NOT NULL").groupBy("tok").agg(F.sum("df")).collect()))
    assert terms(small) == terms(whole) and len(terms(whole)) == 50 and sums(small) == sums(whole)


def test_passages_are_not_stored_for_their_index(spark, monkeypatch):
    """dedupe_best_chunk cuts passages on their way into the index, once; no table of their texts is written."""
    made = []
    monkeypatch.setattr(queries, "_stored", lambda spark, name, df: made.append(name) or df)
    assert queries.dedupe_best_chunk(spark, "/root/testdata/sf0.001").count() and "passages" not in made
