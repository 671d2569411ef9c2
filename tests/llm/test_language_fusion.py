"""The fusion of all kinds of evidence against plain Python, and samples that don't grow."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import language, shared, url_filter

LANGS = ["de", "en", "es", "fr"]


def plain(rows, model, tempering=0.5, shrinkage=20.0, least=0.6):
    """(text_lang, lang_id, confidence, kept) of each row (text, declared, suffix, host), by sums over the rows."""
    score = language.TextScorer(model, tempering)
    ll = [score(r[0] or "") for r in rows]
    post = []
    for x in ll:
        e = [math.exp(v - max(x)) for v in x]
        post.append([v / sum(e) for v in e])
    whole = [sum(p[i] for p in post) for i in range(4)]
    n = sum(whole)
    prior = [(w + 1) / (n + 4) for w in whole]
    sums = [defaultdict(lambda: [0.0] * 4) for _ in range(3)]
    for r, p in zip(rows, post, strict=True):
        for k in range(3):
            if r[k + 1] is not None:
                sums[k][r[k + 1]] = [a + b for a, b in zip(sums[k][r[k + 1]], p, strict=True)]
    out = []
    for r, x, p in zip(rows, ll, post, strict=True):
        declared, suffix, host = ([0.0] * 4 if r[k + 1] is None else [max(0.0, a - b) for a, b in zip(sums[k][r[k + 1]], p, strict=True)] for k in range(3))
        mix = lambda xs, ps: [(a + shrinkage * b) / (sum(xs) + shrinkage) for a, b in zip(xs, ps, strict=True)]
        by_host = mix(host, mix(suffix, prior))
        said = [1.0] * 4 if r[1] is None else [(d + 1) / (q * n + 4) for d, q in zip(declared, prior, strict=True)]
        total = [a + math.log(b) + math.log(c) for a, b, c in zip(x, said, by_host, strict=True)]
        best = max(total)
        confidence = 1 / sum(math.exp(t - best) for t in total)
        spoke = max(x) > min(x)
        out.append((LANGS[x.index(max(x))] if spoke else None, LANGS[total.index(best)], confidence, spoke and confidence >= least))
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_fusion_equals_plain_python(spark, small, monkeypatch):
    monkeypatch.setattr(language, "SMALL", small)
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).collect()
    model = language.train([(r.text, r.lang) for r in source[:60] if r.lang], LANGS)
    rows = []
    for k, r in enumerate(source):
        text = (r.text or "")[: [20, 60, 4000, 0][k % 4]]
        rows.append((None if k == 7 else text, [r.lang, None, "xx", "en"][k % 4] if k % 5 else r.lang, [None, "de", "fr", "net"][k % 4 if k % 3 else 0], [r.source, None, "h1"][k % 3]))
    rows += [rows[2], ("", None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, d string, s string, h string")
    got = {r.i: r for r in language.identify(df, "i", "t", declared="d", suffix="s", host="h", model=model).collect()}
    for i, (text_lang, lang, confidence, kept) in enumerate(plain(rows, model)):
        assert (got[i].text_lang, got[i].lang_id, got[i].kept) == (text_lang, lang, kept), (i, rows[i], got[i])
        assert abs(got[i].confidence - confidence) < 1e-9


def test_smallest_hashes(spark):
    ids = spark.range(30_000).select(F.col("id").alias("_i"), (F.col("id") % 10 == 0).cast("int").alias("_y"))
    ids = ids.union(spark.range(5_000).selectExpr("77", "0")).union(spark.createDataFrame([(None, 1), (5, 2)], "_i long, _y int"))
    got = {(r._y, r._r): r._i for r in shared.smallest_hashes(ids, "_y", 50).collect()}
    rows = ids.filter("_i IS NOT NULL").select("_y", "_i", F.xxhash64("_i").alias("h")).distinct().collect()
    for y in (0, 1, 2):
        want = [r._i for r in sorted((r for r in rows if r._y == y), key=lambda r: (r.h, r._i))][:50]
        assert [got.get((y, k + 1)) for k in range(len(want))] == want
    assert len(got) == 101
    same = spark.range(4_000).selectExpr("1 AS _i", "0 AS _y").union(spark.createDataFrame([(2, 0), (3, 0)], "_i int, _y int"))
    assert shared.smallest_hashes(same, "_y", 2).count() == 2
    assert shared.smallest_hashes(ids.limit(0), "_y", 3).count() == 0


@pytest.mark.parametrize("small", [100_000, 0])
def test_hosts_by_salt(spark, small, monkeypatch):
    monkeypatch.setattr(url_filter, "SMALL", small)
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.net/a" if k % 4 else None, None) for k in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages, [("net/", "block"), ("h1.net/a", "allow")]).collect()}
    assert len(got) == 40
    for k, r in got.items():
        assert (r.host, r.rule, r.verdict) == (("", None, "allow") if k % 4 == 0 else (f"h{k % 3}.net", *(("h1.net/a", "allow") if k % 3 == 1 else ("net/", "block"))))
