"""Packing: ids and cuts against the tokenizers library, valid sequences, and few of them."""

import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import catalogue, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return packing.ByteBpe(file.read())


def expected_pieces(library, rows, most=1024):
    out = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % most or most
        cuts = [0, *range(first, len(ids) + 1, most)] if len(ids) > most else [0, len(ids)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def check_sequences(rows, most=1024):
    """Every sequence is gapless from 0 and not overfull; returns how many there are."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


def test_whole_table(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = catalogue.op12_packing(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected_pieces(library, docs))
    plain = packing.Bins.best_fit([r.length for r in got], 1024).count()
    assert -(-sum(r.length for r in got) // 1024) <= check_sequences(got) <= plain


def test_odd(spark, library):
    """Nulls, empty and long texts, a special token's string, long white space, repeated rows and ids, clashing names, several groups and rounds."""
    texts = [None, "", "a", "a", "x<|endoftext|>y", " " * 50_000, "word " * 20_000, "\n\n b\t c", "é日本", "b" * 5000]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "lonely", "x", 1, 2), (2, "other", "x", 1, 2)] + [(9, "same text", "x", 1, 2)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, `_r` int, length int")
    got = packing.pack(docs, PATH, group=7, rounds=3, keep_ids=True).collect()
    want = expected_pieces(library, [r[:2] for r in rows])
    order = lambda p: tuple(-1 if x is None else x for x in p)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    check_sequences(got)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_rounds_join_groups(spark):
    """Eight groups leave an underfull bin each; dealt anew they end near the least number."""
    docs = spark.createDataFrame([(i, "a " * (5 + i * 37 % 200)) for i in range(400)], "doc_id long, text string")
    got = packing.pack(docs, PATH, group=50).collect()
    least = -(-sum(r.length for r in got) // 1024)
    one = packing.pack(docs, PATH, group=50, rounds=1).collect()
    assert check_sequences(got) <= least + 1 < check_sequences(one)


def test_merges_can_be_ranks(encoder):
    assert encoder.provable()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab's  \x1c\x85 \n\t1.²日", max_size=40))
def test_encoder_equals_library(text):
    with open(PATH, "rb") as file:
        encoder = packing.encoder(file.read())
    assert encoder.encode(text) == encoder.slow.encode(text, add_special_tokens=False).ids


def test_cut():
    assert [packing.cut(n, 4) for n in (1, 4, 5, 8, 11)] == [[1], [4], [1, 4], [4, 4], [3, 4, 4]]


def fewest(lengths, most):
    """The least number of bins, by trying every assignment."""
    for n in range(1, len(lengths) + 1):
        for places in product(range(n), repeat=len(lengths)):
            if all(sum(x for x, p in zip(lengths, places) if p == b) <= most for b in range(n)):
                return n
    return 0


def test_search_keeps_pieces_and_helps():
    """Squared fill never falls, pieces stay, and over many small cases the search comes near the optimum."""
    rng = random.Random(4)
    plain = best = searched = 0
    for _ in range(60):
        lengths = [rng.randint(1, 10) for _ in range(rng.randint(1, 6))]
        bins = packing.Bins(lengths, 10, [[i] for i in range(len(lengths))])  # the worst start: a bin a piece
        before = sum(f * f for f in bins.fill)
        bins.improve()
        assert sorted(i for b in bins.bins for i in b) == list(range(len(lengths)))
        assert all(f == sum(lengths[i] for i in b) <= 10 for f, b in zip(bins.fill, bins.bins)) and sum(f * f for f in bins.fill) >= before
        plain += packing.Bins.best_fit(lengths, 10).count()
        searched += packing.Bins.best_fit(lengths, 10).improve().count()
        best += fewest(lengths, 10)
    assert best <= searched <= plain and searched - best <= 2


@pytest.mark.parametrize(("lengths", "bins"), [([6, 3, 4, 1], [[0, 3], [1], [2]]), ([5, 5, 7, 3], [[0, 3], [1], [2]])], ids=["move", "one for one"])
def test_trades(lengths, bins):
    found = packing.Bins(lengths, 10, [list(b) for b in bins]).improve()
    assert found.count() == 2 and found.trades >= 1


def test_two_for_one_empties_a_bin():
    """8 and 3 + 3 + 4: only pairs for single pieces make three full bins of four underfull ones."""
    lengths = [6, 2, 3, 3, 4, 5, 5, 2]
    found = packing.Bins(lengths, 10, [[0, 1], [2, 3], [4, 5], [6, 7]]).improve()
    assert found.count() == 3 and sum(found.fill) == 30
