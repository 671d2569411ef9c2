"""Search, fusion, metrics and statistics on hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import answers, benchmarking, dense, fusion, lexical, metrics, negatives, rerank, statistics


def run(spark, rows):
    return spark.createDataFrame(rows, "qid string, did string, score double, rank int")


def test_bm25_by_hand(spark):
    docs = ["kira tahliye kira", "tahliye davasi", "nafaka", "", None, "velayet nafaka"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "did int, text string")
    queries = spark.createDataFrame([("a", "kira kira tahliye"), ("b", "ve"), ("c", "zzz")], "qid string, text string")
    index = lexical.fit(corpus, "did", "text")
    toks = [(d or "").split() for d in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w in {x for t in toks for x in t} for c in [sum(w in t for t in toks)]}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    assert index.n == n and abs(index.avgdl - avgdl) < 1e-12
    want = {}
    for i, t in enumerate(toks):
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in ["kira", "kira", "tahliye"] if w in t)
        if s:
            want[i] = round(s, 6)
    got = lexical.search(index, queries, "qid", "text").collect()
    assert {(r.qid, r.did): r.score for r in got} == {("a", i): s for i, s in want.items()}
    padded = lexical.padded_run(index, queries, "qid", "text", 5).collect()
    ids = {q: [r.did for r in sorted(padded, key=lambda r: r.rank) if r.qid == q] for q in "abc"}
    assert ids == {"a": [0, 1, 2, 3, 4], "b": [], "c": [0, 1, 2, 3, 4]}


def test_dense_blocks_and_ties(spark):
    draw = np.random.default_rng(0)
    vectors = draw.normal(size=(60, 8)).round(1)
    vectors[7] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>").repartition(5)
    want = []
    v32 = vectors.astype(np.float32).astype(float)
    for q in range(0, 60, 10):
        s = np.round(v32 @ v32[q], 6)
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-s[j], j))[:4]
        want += [(q, j, k + 1) for k, j in enumerate(order)]
    for block in (4096, 2):
        got = dense.search(df, "i", "v", df.filter("i % 10 = 0 AND i < 60"), "i", "v", 4, True, block).collect()
        assert sorted((r.qid, r.did, r.rank) for r in got) == sorted(want)
    assert dense.search(df, "i", "v", df.limit(0), "i", "v").count() == 0
    pooled = df.limit(1).select(dense.masked_mean(F.expr("array(array(3f, 0f), array(9f, 9f), array(1f, 0f))"), F.expr("array(1, 0, 1)")).alias("x")).first().x
    assert pooled == [1.0, 0.0]


def test_fusion(spark):
    a = run(spark, [("q", "x", 0.9, 1), ("q", "y", 0.8, 2), ("r", "d", 0.5, 1)])
    b = run(spark, [("q", "y", 9.0, 1), ("q", "z", 8.0, 2), ("r", "s", 3.0, 1)])
    got = {(r.qid, r.did): r for r in fusion.reciprocal_rank_fusion(a, b).collect()}
    assert abs(got["q", "y"].score - (1 / 62 + 1 / 61)) < 1e-12 and got["q", "y"].pos == 1
    assert got["r", "d"].pos == 1 and got["r", "s"].pos == 2 and got["r", "s"].dense_score == 0
    groups = spark.createDataFrame([("x", "g"), ("y", "g"), ("z", "h")], "did string, group string")
    best = [(r.did, r.pos) for r in fusion.hybrid(a, b, 2, groups=groups).filter("qid = 'q'").orderBy("pos").collect()]
    assert best == [("y", 1), ("z", 2)]


def test_judged_metrics(spark):
    qrels = spark.createDataFrame([("a", "d2", 1), ("b", "d1", 1), ("b", "d3", 1), ("c", "d1", 1), ("x", "d1", 1)], "qid string, did string, rel int")
    ranked = run(spark, [("a", "d1", 3.0, 1), ("a", "d2", 2.0, 2), ("a", "d9", 1.0, 3), ("b", "d1", 3.0, 1), ("b", "d2", 2.0, 2), ("b", "d3", 1.0, 3), ("n", "d1", 1.0, 1)])
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("n",)], "qid string")
    got = {r.qid: r for r in metrics.judged(ranked, qrels, asked).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].hit_1, got["a"].hit_5, got["a"].mrr_10, got["a"].ndcg_10, got["a"].map) == (0, 1, 0.5, 0.63093, 0.5)
    assert got["b"].ndcg_10 == 0.919721 and got["b"].map == 0.833333
    assert (got["c"].hit_100, got["c"].mrr_10, got["c"].ndcg_10, got["c"].map) == (0, 0, 0, 0)


def test_self_ideal_metrics(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0)], "qid string, rank int, rel int")
    got = metrics.self_ideal(rows).first()
    assert got.ndcg_1 == 0 and got.ndcg_3 == 0.63093 and got.mrr == 0.5 and got.hit_1 == 0 and got.hit_3 == 1


def test_negatives(spark):
    ranked = run(spark, [("q", f"d{i}", 1.0 - i / 100, i) for i in range(1, 9)])
    pairs = spark.createDataFrame([("q", "d3"), ("none", "d1")], "qid string, pos string")
    assert negatives.hard_negatives(ranked, pairs).first().negative_ids == ["d4", "d5", "d6", "d7"]
    assert negatives.hard_negatives(ranked, pairs, ceiling=0.95).first().negative_ids == ["d6", "d7", "d8"]
    mined = negatives.hard_negatives(ranked, pairs, most=1)
    made = negatives.triplets(mined, spark.createDataFrame([("q", "ask")], "qid string, text string"), spark.createDataFrame([("d3", "p" * 1300), ("d4", "n")], "did string, text string")).first()
    assert made.anchor == "query: ask" and made.positive == "passage: " + "p" * 1200 and made.negative == "passage: n"


def test_statistics(spark):
    a = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "qid long, m double")
    b = a.withColumn("m", F.col("m") + F.when(F.col("qid") % 2 == 0, 0.5).otherwise(0.1))
    same = statistics.paired_bootstrap(a, a, "m", 200).first()
    assert (same.diff_mean, same.p_value, same.ci_lo, same.ci_hi) == (0, 1, 0, 0)
    assert statistics.paired_bootstrap(b, a, "m", 500).first().p_value == 0
    ci = statistics.bootstrap_ci(a, "m", 2000).first()
    assert ci.lo < ci.mean == 1.0 < ci.hi and abs((ci.hi - ci.lo) / 2 - 1.96 * np.std([i % 3 for i in range(30)]) / 30**0.5) < 0.06
    twin = statistics.bootstrap_ci_numpy(a.withColumn("s", F.lit("x")), "m", "s", 500).first()
    rng, v = np.random.default_rng(42), np.array([i % 3 for i in range(30)], float)
    means = [rng.choice(v, size=30, replace=True).mean() for _ in range(500)]
    assert abs(twin.lo - np.percentile(means, 2.5)) < 1e-9
    t = statistics.paired_t(b, a, "m").first()
    d = np.array([0.5 if i % 2 == 0 else 0.1 for i in range(30)])
    assert abs(t.t - d.mean() / (d.std(ddof=1) / 30**0.5)) < 1e-4 and t.p_value == 0
    assert abs(statistics._student_tail(2.0, 10) - 0.07338803) < 1e-7 and abs(statistics._student_tail(0.5, 3) - 0.6514479) < 1e-6
    spread = statistics.multi_seed(a.withColumn("s", F.col("qid") % 2), "s", ["m"]).first()
    assert spread.mean == 1.0 and spread.std == 0.0
    assert "Δ = +0.300" in statistics.comparison("b", b, "a", a, "m", 100).first().report


def test_splits_and_answers(spark):
    ids = spark.range(1005).withColumnRenamed("id", "k")
    parts = benchmarking.split_of(ids, "k")
    assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 804, "dev": 100, "test": 101}
    assert benchmarking.disjoint(parts, "k").first().overlaps == 0
    queries = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q")], "qid string, query string")
    results = spark.createDataFrame([("a", 1, 1 / 61, 0.5), ("b", 1, 2 / 61, 0.0)], "qid string, pos int, score double, dense_score double")
    assert {r.qid: r.reason for r in answers.abstain_fused(queries, results).collect()} == {"a": "dusuk_guven", "b": None, "c": "yetersiz_dokuman"}
    assert {r.qid: r.abstain for r in answers.abstain_cosine(queries, results).collect()} == {"a": False, "b": True, "c": True}
    levels = spark.createDataFrame([(0.51,), (0.39,), (0.37,)], "s double").select(answers.confidence(F.col("s")).level.alias("x")).collect()
    assert [r.x for r in levels] == ["Yüksek", "Orta", "Sınırlı"]


def test_rerank_with_a_model(spark):
    rows = spark.createDataFrame([("q", 1, 1, "kira", "tahliye"), ("q", 2, 2, "kira", "kira"), ("q", 3, 30, "kira", "kira")], "qid string, did int, rank int, query string, text string")
    assert [r.did for r in rerank.rerank(rows).orderBy("rank").collect()] == [2, 1]
    load = lambda: lambda queries, texts: [float(len(t)) for t in texts]
    assert [r.did for r in rerank.rerank(rows, rerank.model_scorer(load)).orderBy("rank").collect()] == [1, 2]


ORACLES = ["tokenize", "bm25_topk", "dense_topk", "hybrid_rrf", "chunk_records", "silver_queries", "keyword_relevance", "metrics_qrels", "result_summary", "context", "faithfulness", "split_80_10_10"]


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    from collections import Counter

    import duckdb

    from corvane.plans import oracle, queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    assert Counter(map(tuple, df.select(cols).collect())) == Counter(con.sql(f"SELECT {', '.join(cols)} FROM ({oracle.ORACLE_SQL[name]})").fetchall())
