"""Scratch tables, and the plans that read them."""

import os

import pytest
from pyspark.sql import functions as F

from corvane import scratch
from corvane.operators import dense, lexical, relevance, rerank
from corvane.plans import evaluation


def below(spark, name=""):
    folder = scratch.shared_dir(spark).removeprefix("file://") + "/scratch"
    return [x for x in (os.listdir(folder) if os.path.isdir(folder) else []) if x.startswith(name)]


def test_tables_go(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    kept = scratch.Scratch(spark, "kept")
    with scratch.released(keep=kept):
        assert kept.table("a", spark.range(3)).count() == 3
        assert scratch.Scratch(spark, "gone").table("a", spark.range(4)).count() == 4
    assert not below(spark, "gone-") and len(below(spark, "kept-")) == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    kept.table("b", spark.range(2))
    kept.drop("a")
    assert os.listdir(kept.path.removeprefix("file://")) == ["b"] and kept.exists()
    scratch.release(spark)
    assert not below(spark) and not kept.exists()


def test_failed_write_is_marked(spark):
    failing = scratch.Scratch(spark, "failing")
    with pytest.raises(Exception, match="no rows"):
        failing.table("a", spark.range(3).select(F.raise_error(F.lit("no rows")).cast("long").alias("x")))
    assert failing.marked and len(below(spark, "failing-")) == 1
    scratch.release(spark)
    assert not below(spark, "failing-") and not failing.exists()


def test_one_scan_serves_all_searches(spark, tmp_path):
    rows = [(i, f"word{i % 7} other{i % 3} text") for i in range(40)]
    spark.createDataFrame(rows, "did long, text string").write.parquet(f"{tmp_path}/docs")
    index = lexical.fit(spark.read.parquet(f"{tmp_path}/docs"), "did", "text")
    asked = spark.createDataFrame([(1, "word3 other1")], "qid long, text string")
    found = lexical.search(index, asked, "qid", "text", 5)
    assert f"{tmp_path}/docs" in "".join(index.docs.inputFiles())
    assert found.count() == 5 and f"{tmp_path}/docs" not in "".join(found.inputFiles())  # the corpus is not read again


def test_containing(spark):
    texts = ["a b c d e f g", "x a b c d e f y", "b c d", "abc", None, "", "a b\nc d e f g h", "b c d"]
    items = ["a b c d e f", "b c d", "b c", "c", None, "c d e f g", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "did int, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "qid int, text string")
    want = sorted((q, d) for q, i in enumerate(items) for d, t in enumerate(texts) if i is not None and t is not None and i in t)
    assert sorted(map(tuple, relevance.containing(docs, asked, 3).collect())) == want
    long = asked.filter("qid IN (0, 1, 5)")
    found = relevance.containing(docs, long, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, found.collect())) == [p for p in want if p[0] in (0, 1, 5)]
    assert relevance.containing(docs, asked.limit(0)).count() == 0


def test_latency_and_matrix(spark):
    run = spark.createDataFrame([(1, d, d, "kira tahliye", t, r) for d, t, r in [(1, "nafaka", 0), (2, "kira tahliye", 1)]], "qid int, did int, rank int, query string, text string, rel int")
    rows = {r.config: r for r in evaluation.matrix({"x": run}).collect()}
    assert rows["x"].mrr == 0.5 and rows["x + rerank"].mrr == 1.0
    took = evaluation.latency(spark, {"x": lambda: rerank.rerank(run)}, 2).first()
    assert took.config == "x" and took.avg_latency_ms > 0
    lines = evaluation.eyeball(run.withColumn("score", F.lit(0.5)).withColumn("kurul", F.lit(None).cast("string")), 1).collect()
    assert [r.line for r in lines] == ["[1] ? | nafaka..."]


def test_dense_slices(spark, monkeypatch):
    monkeypatch.setattr(dense, "SCORES", 8)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)], "i int, v array<double>").coalesce(1)
    got = dense.search(df, "i", "v", df.filter("i < 3"), "i", "v", 4).collect()
    vec = {r.i: r.v for r in df.collect()}
    want = {(q, d, k + 1) for q in range(3) for k, d in enumerate(sorted(vec, key=lambda d: (-sum(a * b for a, b in zip(vec[q], vec[d], strict=True)), d))[:4])}
    assert {(r.qid, r.did, r.rank) for r in got} == want
