"""Readers, writers, grounding and streaming."""

import json

from pyspark.sql import functions as F

from corvane.operators import benchmarking, grounding
from corvane.plans import index
from corvane.sources import decisions, sinks
from corvane.streaming import ingest


def test_json_decisions(spark, tmp_path):
    body = "<p>" + "uzun metin. " * 60 + "</p>"
    records = [
        {"KARAR": {"KARAR": body}, "metadata": {"KARAR_ID": "1", "ESAS_NO": ""}, "ESAS_NO": "2020/1"},
        {"karar_html_excerpt": "<p>kısa</p>"},
        {"karar_html_excerpt": "", "KARAR": body, "KARAR_ID": "3"},
        {"metadata": {"KARAR": f"<title>T</title>{body}SONUÇ: x", "KARAR_ID": "4", "HUKUM": "h"}},
    ]
    path = tmp_path / "in.json"
    path.write_text(json.dumps({"KARARLAR": records}))
    rows = decisions.from_json(decisions.json_records(spark, str(path))).collect()
    assert [r.karar_id for r in rows] == ["1", "3", "4"] and rows[0].esas_no == "2020/1"
    assert rows[2].title == "T" and rows[2].sonuc == "SONUÇ: x" and rows[2].hukum == "h" and rows[1].hukum == ""
    assert decisions.json_records(spark, str(path), 2).count() == 2
    assert decisions.from_json(decisions.json_records(spark, str(path)), limit=1).count() == 1


def test_hub_decisions(spark):
    text = "3. Ceza Dairesi\nSUÇ: Hırsızlık\n" + "x" * 20_000
    rows = [(0, "a", "1", None, "01.01.2020", "ygty2", text), (1, "b", None, None, None, None, "short"), (2, "c", "2", "3", None, "zz", "y" * 600)]
    got = decisions.from_hub(spark.createDataFrame(rows, "ord int, id string, esasNo string, kararNo string, kararTarihi string, source string, text string")).collect()
    assert [r.karar_id for r in got] == ["a", "c"] and len(got[0].text) == 15_000
    assert got[0].kurul == "3. Ceza Dairesi" and got[0].title == "3. Ceza Dairesi - E. 1, K. None" and got[0].konu == "Hırsızlık"
    assert got[0].source_label == "Yargıtay (Ceza Daireleri)" and got[1].kurul == "zz"


def test_benchmark_round_trip(spark, tmp_path):
    rows = [(1, 0, "KONU: kira tahliye davası\n" + "z" * 50, "t", "k", "1", "2", None, ["madde 51 kanun"]), (1, 1, "KONU: nafaka artırım davası\n", "u", "k", "1", "2", None, None)]
    made = spark.createDataFrame(rows, "karar_id int, ord int, text string, title string, kurul string, esas_no string, karar_no string, tarih string, kanunlar array<string>")
    corpus, queries, qrels = benchmarking.silver(made)
    assert corpus.first().title == "u" and corpus.count() == 1 and qrels.count() == 3
    stats = sinks.write_beir(corpus, queries, qrels, str(tmp_path)).first()
    assert (stats.n_corpus, stats.n_qrels) == (1, 3)
    back = decisions.read_beir(spark, str(tmp_path))
    assert [df.count() for df in back] == [corpus.count(), queries.count(), 3] and back[0].first().metadata.tarih == ""
    sinks.write_template(benchmarking.gold_template(queries, corpus, qrels), str(tmp_path / "gold"))
    assert spark.read.option("header", True).csv(str(tmp_path / "gold")).count() >= 2


def test_results_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"mrr": 0.83333, "avg_ms": 22.32}), ("b", {"mrr": 0.9, "avg_ms": 10.0})], "config string, agg map<string, double>")
    sinks.write_results(rows, str(tmp_path / "r"))
    flat = spark.read.json(str(tmp_path / "r")).count()
    (tmp_path / "all.json").write_text(json.dumps([{"config": "a", "agg": {"mrr": 0.83333, "avg_ms": 22.32}}]))
    got = {r.metric: r.value for r in decisions.read_results(spark, str(tmp_path / "all.json")).collect()}
    assert flat == 2 and got == {"mrr": 0.833, "avg_ms": 22.0}
    means = spark.createDataFrame([("a", 0.5, None), ("b", 0.9, 0.1)], "system string, mrr double, map double")
    assert [r.line.split() for r in sinks.comparison_table(means, "system", ["mrr", "map"]).collect()] == [["b", "0.9000", "0.1000"], ["a", "0.5000", "0.0000"]]
    path = str(tmp_path / "cache")
    assert sinks.cached(spark.range(3), path).count() == 3 and sinks.cached(spark.range(9), path).count() == 3
    assert [df.count() for df in decisions.literal_queries(spark)] == [15, 30, 10]
    assert "0.900" in sinks.model_card("m", "b", {"x": 0.9}) and "- n: 1" in sinks.dataset_card("d", {"n": 1})


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "kira tahliye. " * 40), ("b", "x")], "karar_id string, text string")
    made = index.build(docs)
    sinks.write_index(made, str(tmp_path / "i"), 2)
    back = decisions.read_index(spark, str(tmp_path / "i"))
    assert back.count() == 1 and abs(sum(x * x for x in back.first().embedding) - 1) < 1e-9
    assert index.stats(back, "karar_id").first().n_docs == 1


def test_grounding(spark):
    queries = spark.createDataFrame([("a", "kira?"), ("b", "yok?")], "qid string, query string")
    text = "Bu karar kira sözleşmesinin feshi hakkındadır. Kısa. Kiracının tahliyesi için ihtar gerekir ve süre beklenir."
    results = spark.createDataFrame([("a", 1, "d1", 0.03, "K", "1", "2", text), ("a", 2, "d2", 0.02, None, None, None, None)], "qid string, pos int, did string, score double, kurul string, esas_no string, karar_no string, text string")
    ctx = grounding.context(results).first()
    assert ctx.context == f"[Karar 1] (K E.1/K.2)\n{text}\n\n[Karar 2] (? E.?/K.?)\n" and ctx.n_docs == 2
    made = {r.qid: r for r in grounding.generate(queries, results).collect()}
    assert made["b"].abstained and made["b"].reason == "yetersiz_dokuman" and made["b"].prompt is None
    assert made["a"].answer.endswith("[Karar 1]") and not made["a"].abstained and "SORU: kira?" in made["a"].prompt
    out = {r.qid: r for r in grounding.safety_comparison(queries, results).collect()}
    assert out["a"].grounded_faithfulness > 0.4 and out["b"].grounded_faithfulness is None and out["b"].plain_abstained
    cite = spark.range(1).select(grounding.citation_stats(F.lit("[Karar 1] [Karar 7] [Karar 1]"), F.lit(3)).alias("c")).first().c
    assert (cite.n_citations, cite.valid_citations, cite.citation_validity) == (2, 1, 0.5)
    qrels = spark.createDataFrame([("a", "d1", 1)], "qid string, did string, rel int")
    answers = spark.createDataFrame([("a", "[Karar 1] [Karar 2]"), ("b", "x")], "qid string, answer string")
    assert {r.qid: r.citation_relevance for r in grounding.citation_relevance(answers, results, qrels).collect()} == {"a": 0.5, "b": None}


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "kira tahliye. " * 40), (2, "kira kira")], "id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.start(stream, str(tmp_path / "out"), "id").awaitTermination(120)
    assert {r.tok: r.df for r in ingest.document_frequencies(spark, str(tmp_path / "out")).collect()} == {"kira": 2, "tahliye": 1}
    assert spark.read.parquet(str(tmp_path / "out/passages")).count() == 1
