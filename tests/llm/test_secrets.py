"""Secret scan: candidates, features and the forest against Python, and held-out findings."""

import re

import numpy as np
import pytest

from corvane.llm import secrets as s


@pytest.fixture(scope="module")
def forest(spark):
    return s.train(spark)


def python_features(c, before, after):
    n, share = len(c), lambda p: len(re.findall(p, c)) / len(c)
    turns = sum(len(re.findall(p, c)) for p in ("[0-9](?=[A-Za-z])", "[A-Za-z](?=[0-9])", "[a-z](?=[A-Z])", "[A-Z](?=[a-z])"))
    words = "|".join(sorted({w for w in s.DICTIONARY if w.isascii()}, key=lambda w: (-len(w), w)))
    return [
        min(n, 256), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[+/_=-]"), share("[0-9a-f]"), turns / n, share("[aeiouAEIOU]"), len(set(c[:256])) / min(n, 256),
        1 - len(re.sub(words, "", c.lower())) / n, c.count("/"), bool(re.search(s.NEAR_SECRET, before)), bool(re.search(s.NEAR_HARMLESS, before)), bool(re.search(s.ASSIGNED, before)), bool(re.search(s.BOUND, before)),
        bool(re.search("[\"'`]$", before) and re.search("^[\"'`]", after)), bool(re.search(r"(?i)(://|www\.|\.)\S*$", before) or re.search(r"^\.[a-z]{2,4}\b", after)),
    ]


def brute(rows, forest):
    out = []
    for i, t in rows:
        for m in re.finditer(s.CANDIDATE, t or ""):
            before, after = t[: m.start()], t[m.end() :]
            last = [x.end() for x in re.finditer(s.CANDIDATE, before)]
            nxt = re.search(s.CANDIDATE, after)
            before, after = before[last[-1] if last else 0 :][-40:], after[: nxt.start() if nxt else len(after)][:40]
            x = np.array(python_features(m[0], before, after), float)
            out.append((i, m.start(), m.end(), m[0], round(sum(s.evaluate(t, x) for t in forest) / len(forest), 6)))
    return out


def test_documents_and_odd_rows(spark, forest):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "é" * 50 + ' token = "' + "a1B2c3D4" * 4 + '" x ' + "z9" * 20), (-4, "A" * 100_000), (-5, "q" * 15), (-6, "w" * 16), (-6, "w" * 16), (None, "token=" + "f0" * 20)]
    df = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS score", "'x' AS size", "2 AS start")
    got = sorted((tuple(r)[:5] for r in s.scan(df, forest=forest).collect()), key=str)
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()], forest), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=2e-6)
    planted = [r for r in s.scan(docs, forest=forest).collect() if re.fullmatch("[0-9a-f]{40}", r.candidate)]
    assert planted and all(r.is_secret for r in planted)
    assert s.scan(df.limit(0), forest=forest).count() == 0


def test_held_out_findings(spark, forest):
    rows = [(i, t, y) for i, (t, y) in enumerate(s.labelled_findings(copies=6, seed=5))]
    got = {r.doc_id: r.is_secret for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string, y int"), forest=forest).collect()}
    right = np.mean([got[i] == bool(y) for i, _, y in rows])
    false = np.mean([got[i] for i, _, y in rows if not y])
    assert right > 0.93 and false < 0.06, (right, false)


def test_plan_has_no_python(spark, forest):
    df = s.redacted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), forest=forest)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
