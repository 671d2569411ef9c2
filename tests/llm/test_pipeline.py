"""The corpus pipeline's stages, one after the other, against brute force."""

import hashlib
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_minhash import brute as brute_near


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def cut(text, items, window=10):
    """The text without benchmark passages; None if no word is left of a hit text."""
    phrases = set()
    for t in items:
        w = [x for x, *_ in words(t)]
        phrases |= {tuple(w[k : k + window]) for k in range(max(len(w) - window + 1, min(1, len(w))))}
    w, hit = words(text), set()
    for n in {len(p) for p in phrases}:
        for k in range(len(w) - n + 1):
            if tuple(x for x, *_ in w[k : k + n]) in phrases:
                hit |= {*range(k, k + n)}
    if hit and len(hit) == len(w):
        return None
    out, last = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += text[last : w[k][1]]
        if k + 1 not in hit:
            last = w[k][2]
    return out + (text or "")[last:] if hit else text or ""


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    base = source.filter("doc_id = 16").first().text
    extra = [
        (100_001, base, "en", "src1", 5), (100_002, base + " one more word", "en", "src1", 5), (100_003, None, "en", None, None), (100_004, "", None, "s", 0),
        (100_005, items[0], "en", "src2", 7), (100_006, "The end of the " + items[1] + " and to the of", "en", "src2", 7), (100_007, "$$$ 123", "en", "src2", 7), (None, "the of and to is that " * 5, "en", "src2", 7),
        (100_001, base, "en", "src1", 5), (100_008, "the and of to was " * 9_000, None, None, None),
    ]
    source.union(spark.createDataFrame(extra, source.schema)).withColumnsRenamed({}).selectExpr("*", "1 AS kept", "'x' AS spans", "2 AS n_hit").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    language, exact, near, leaks, encode = (f for _, f in corpus_pipeline.STAGES)

    docs1 = language(spark, docs, str(tmp_path)).cache()
    rows1 = [r.asDict() for r in docs1.collect()]
    assert docs1.columns == columns
    gone = {r.doc_id for r in docs.collect()} - {r["doc_id"] for r in rows1}
    assert {100_003, 100_004, 100_007} <= gone and len(gone) < 8

    docs2 = exact(spark, docs1, str(tmp_path)).cache()
    rows2 = [r.asDict() for r in docs2.collect()]
    top = {}
    for r in rows1:
        top[r["text"]] = max(top.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert docs2.columns == columns and sorted((r["text"], -1 if r["doc_id"] is None else r["doc_id"]) for r in rows2) == sorted(top.items())

    docs3 = near(spark, docs2, str(tmp_path)).cache()
    rows3 = [r.asDict() for r in docs3.collect()]
    kept = {i for (i, _, _, k) in brute_near([(r["doc_id"], r["text"]) for r in rows2], 5, 80) if k}
    assert docs3.columns == columns and {r["doc_id"] for r in rows3} == kept and len(rows3) < len(rows2)

    docs4 = leaks(spark, docs3, str(tmp_path)).cache()
    rows4 = {r.doc_id: r for r in docs4.collect()}
    want = {r["doc_id"]: t for r in rows3 if (t := cut(r["text"], items)) is not None}
    assert docs4.columns == columns and {i: r.text for i, r in rows4.items()} == want
    assert 100_005 not in rows4 and all(r.n_chars == len(r.text) for i, r in rows4.items() if i and r.text != next(x["text"] for x in rows3 if x["doc_id"] == i))

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode(spark, docs4, str(tmp_path)).collect()}
    ids = {i: sp.encode(r.text, add_eos=True) for i, r in rows4.items()}
    assert got == {(i, len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for i, x in ids.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_empty(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
