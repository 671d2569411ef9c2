"""FM-index and decontamination against plain search."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import decontaminate as d
from corvane.llm.fm_index import FMIndex, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index(sequences, patterns):
    text = np.array([x for s in sequences for x in [*s, 0]], np.int32)
    ends = {int(p): k for k, p in enumerate(np.flatnonzero(text == 0))}
    order = sorted(range(len(text)), key=lambda p: [(int(x), ends[p + k]) if x == 0 else (int(x), 0) for k, x in enumerate(text[p:])])
    assert suffix_array(text).tolist() == order
    table = np.zeros((len(patterns), 4), np.int32)
    for k, p in enumerate(patterns):
        table[k, : len(p)] = p
    index = FMIndex(text, 4, sample=3)
    got = sorted(zip(*(x.tolist() for x in index.locate(*index.search(table, np.array([len(p) for p in patterns])))), strict=True))
    want = [(k, i) for k, p in enumerate(patterns) for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
    assert got == sorted(want)


def brute(docs, items, window):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - window + 1, min(1, len(w)))):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = Counter()
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owner := windows.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    found |= owner
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert Counter(map(tuple, d.contamination(docs, bench).collect())) == want
    assert sum(n for k, n in want.items() if k[5]) > 20


def test_odd_rows_blocks_and_cleaning(spark):
    items = [(1, "alpha beta gamma"), (2, "One two THREE four five six"), (2, "seven eight"), (3, None), (4, "..."), (None, "zeta eta"), (5, "é Ünder straße"), (6, "beta gamma delta x y")]
    rows = [(1, "so ALPHA, beta; gamma delta x y z"), (2, "one two three four. one two three four five six seven eight nine"), (3, None), (4, ""), (5, "vor é ünder, Ünder straße é Ünder straße!"), (6, "zeta eta"), (7, "alpha beta gamma " * 9_000), (1, "so ALPHA, beta; gamma delta x y z"), (None, "seven eight")]
    docs = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, items int, spans string")
    bench = spark.createDataFrame([(*r, "e") for r in items], "item_id long, text string, doc_id string")
    want = brute(rows, [x for x in items if x[0] is not None], 3)
    for size in (16_000_000, 20):
        assert Counter(map(tuple, d.contamination(docs, bench, window=3, block_bytes=size).collect())) == want
    clean = {r.doc_id: r for r in d.find_benchmark(docs, bench, window=3, block_bytes=20, clean=True, keep=("items", "spans", "text")).collect()}
    assert clean[1].cleaned == "so  z" and clean[5].cleaned == "vor é ünder, Ünder straße !" and clean[6].cleaned == "zeta eta"
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert d.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
