"""Exact dedup, sharding, piece encoding and language ID against plain versions on small tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import exact_dedup, language, pieces, sharding
from corvane.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, `_h` string, shard int"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "", "a", "a", "A", "a ", "long " * 30_000, "é\u0000x", "  two  spaces ", "▁ mark", "\n\t", "日本語 text", None, "a"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty, long and repeated texts, a repeated id, and columns named like internal ones."""
    rows = [(i, t, "en", None, "x", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (3, "a", None, "s", None, 2), (None, "lonely", "fr", "s", None, 3), (None, "a", "fr", "s", None, 3)], DOCS).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.mark.parametrize(("bits", "page_bits", "many"), [(64, 14, 64), (3, 14, 64), (64, 1, 1), (3, 2, 1)])
def test_exact_dedup_odd(spark, odd, bits, page_bits, many, monkeypatch):
    """Three hash bits make chains of different texts, few page bits make pages double; results stay exact."""
    monkeypatch.setattr(exact_dedup, "PAGE_BITS", page_bits)
    got = exact_dedup.exact_dedup(odd, bucket_keys=2, hash_bits=bits, many=many).collect()
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = []
    for i, t in rows:
        ids = [a for a, b in rows if b == t]
        keep = max((a for a in ids if a is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("page_bits", [8, 2])
def test_directory_doubles(spark, page_bits, monkeypatch):
    """No bucket is overfull at any depth, and none is split without need, beyond what its page needs."""
    monkeypatch.setattr(exact_dedup, "PAGE_BITS", page_bits)
    keys = spark.range(2000).selectExpr("xxhash64(id) AS _h").distinct()
    depth = {r._page: r._depth for r in exact_dedup.directory(keys, 100, Scratch(spark, "directory")).collect()}
    hashes = [r._h % 2**64 for r in keys.collect()]
    sizes = Counter((d, h >> (64 - d)) for h in hashes for d in [depth[h >> (64 - page_bits)]])
    assert max(sizes.values()) <= 100 and len(sizes) > 16
    for page, d in depth.items():
        if d > page_bits:  # one bit less would not do
            assert max(Counter(h >> (65 - d) for h in hashes if h >> (64 - page_bits) == page).values()) > 100
        else:
            assert sum(h >> (65 - d) == page >> (page_bits - d + 1) for h in hashes) > 100


def test_wrong_directory_breaks(spark, odd, monkeypatch):
    """Texts and slots meet through the directory: without a page, its rows are lost."""
    right = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: right(*a).orderBy("_page").offset(1))
    assert exact_dedup.exact_dedup(odd).count() < odd.count()


def test_texts_are_shuffled_once(spark, small):
    """Of the exchanges of a run, one holds the texts; the others hold keys."""
    folder = exact_dedup.exact_dedup(small)
    plan = folder._jdf.queryExecution().executedPlan().toString()
    assert "_text" not in plan and "Python" not in plan and "Arrow" not in plan


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd):
    keys = [0, 1, 2, 24, 10**12, 2**62, -1, -(2**63), 2**63 - 1, 123456789, None]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(sharding.F.col("k"), 24).alias("s")).collect()
    assert [(r.s.shard, r.s.grown) for r in got] == [(jump(r.k or 0, 24), jump(r.k or 0, 25)) for r in got]
    rows = sharding.shard(odd, 5).collect()
    assert len(rows) == odd.count() and {r.law for r in rows} == {"key"}
    for s in range(5):
        slots = [(r.slot, r.doc_id) for r in rows if r.shard == s]
        assert sorted(x for x, _ in slots) == list(range(len(slots)))
        assert [d for _, d in sorted(slots) if d is not None] == sorted(d for _, d in slots if d is not None)
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sharding.shard(odd.limit(0), 5).count() == 0


def test_sharding_is_even_and_moves_little(spark):
    rows = spark.range(20_000).select(sharding.jump_hash(sharding.F.col("id"), 24).alias("s")).collect()
    counts = Counter(r.s.shard for r in rows)
    assert len(counts) == 24 and max(counts.values()) < 1.2 * 20_000 / 24
    moved = [r.s for r in rows if r.s.shard != r.s.grown]
    assert all(s.grown == 24 for s in moved) and 0.02 < len(moved) / 20_000 < 0.06


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the▁ \t\n.é日\U0001f600<s>")), max_size=60) | st.text(max_size=40))
def test_chunks_equal_library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = text.encode("utf-8", "ignore").decode()
    with open(MODEL, "rb") as f:
        ids, decoded = pieces.Chunks(f.read(), 3).encode([text])[0]
    want = sp.encode(text)
    assert ids == " ".join(map(str, want)) and decoded == sp.decode(want)


def test_pieces_equal_library(spark, odd, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (odd, small, odd.limit(0)):
        got = pieces.encode_documents(docs, MODEL, with_ids=True).collect()
        want = []
        for r in docs.collect():
            ids = sp.encode(r.text or "", add_eos=True)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)), tuple(ids), sp.decode(ids)))
        assert Counter((*r[:4], tuple(r.ids), r.decoded) for r in got) == Counter(want)


def test_language_text_alone_is_accurate(spark, small):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = small.selectExpr("doc_id AS _id", "text AS _text", "lang AS _label")
    langs = ["de", "en", "es", "fr"]
    model = language.train(language.sample(labelled, langs, 40), langs)
    got = {r.doc_id: r for r in language.identify(held, model=model).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i].text_lang == want[i] for i in want) / len(want) > 0.95


def test_language_evidence(spark, odd):
    """Pages of one host are English; a short ambiguous text there follows host, markup and suffix."""
    langs = ("en", "fr")
    model = language.train([("the and of that with this", "en"), ("le la les des que une dans", "fr")] * 5, list(langs))
    rows = [(i, "the and of that with this", "en", "com", "h1") for i in range(30)] + [(i, "le la les des que une", "fr", "fr", "h2") for i in range(30, 60)]
    rows += [(60, "zz", None, None, "h1"), (61, "zz", "fr", "fr", "h2"), (62, "zz", None, "fr", None), (63, None, "fr", None, None), (64, "123 $$", "en", "com", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, tld string, host string")
    got = {r.doc_id: r for r in language.identify(df, declared="said", suffix="tld", host="host", model=model, languages=langs).collect()}
    assert [got[i].lang_id for i in (0, 30, 60, 61, 62, 63, 64)] == ["en", "fr", "en", "fr", "fr", "fr", "en"]
    assert not got[63].kept and not got[64].kept and got[63].text_lang is None and got[0].kept
    assert language.identify(odd, declared="lang", host="source", label="lang", keep=("text", "_h")).count() == odd.count()
    assert language.identify(odd.limit(0), declared="lang", host="source", label="lang").count() == 0


def test_oracles(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    from corvane.llm import catalogue

    for name in ("op3_sharding", "op9_exact_dedup"):
        df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        assert Counter(map(tuple, df.select(cols).collect())) == Counter(con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_chunk_table():
    with open(MODEL, "rb") as f:
        model = f.read()
    texts = ["the cat  the dog", "", "the cat", "a  b  the"]
    table = pieces.Chunks(model, 100)
    first = table.encode(texts)
    assert table.segmented == len({"▁the", "▁cat", "▁▁the", "▁dog", "▁a", "▁▁b"})
    assert table.encode(texts) == first and table.segmented == 6  # nothing is segmented twice
    small = pieces.Chunks(model, 2)
    assert small.encode(texts) == first and small.encode(texts[2:]) == first[2:]
    assert pieces.table_of(model, 7) is pieces.table_of(model, 7)


def test_pieces_keep_any_column(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", "y")], "doc_id long, text string, n_tokens long, _text string, _id string")
    row = pieces.encode_documents(df, MODEL, keep=("_text", "_id")).first()
    assert (row.doc_id, row._text, row._id) == (1, "x", "y") and row.n_tokens > 1
    assert pieces.encode_documents(df.withColumnRenamed("n_tokens", "ids"), MODEL, keep=("ids",)).first().ids == 7
    assert pieces.encode_documents(df.limit(0), MODEL).count() == 0
