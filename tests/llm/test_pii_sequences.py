"""Sequences cover whole texts and end where no span can be."""

import pytest

from corvane.llm import pii

NUMBER = "(555) 123-4567"
RUN = "x" * 60


def test_sequences_cover_the_text():
    draw = __import__("random").Random(3)
    text = " ".join(draw.choice(["alpha", "beta,", "at", "gamma.", "dot", NUMBER, "1 2", "delta"] + ["word"] * 30) for _ in range(3000))
    tokens = pii.tokens_of(text)
    parts = pii.sequences(tokens, 50, 4)
    assert [t for p in parts for t in p] == tokens and all(len(p) <= 100 for p in parts)
    hard = pii.tokens_of("1 " * 1000)
    assert [len(p) for p in pii.sequences(hard, 50, 4)] == [100] * 9 + [100] and pii.sequences([]) == []


def test_cut_texts_give_the_same_spans(monkeypatch):
    """Over a whole table, with a labelled example put into each document: cut and uncut texts have the same spans."""
    import pyarrow.parquet as pq

    crf, table = pii.default_model(), pii.labelled_table(copies=4, seed=5)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    mixed = []
    for k, t in enumerate(texts):
        at = t.find(" ", len(t) // 2)
        mixed.append(f"{t[:at]} {table[k % len(table)][0]} {t[at:]}" if at >= 0 else t)
    base = [pii.base_spans(t) for t in mixed]
    whole = pii.added_spans(mixed, base, crf)
    monkeypatch.setattr(pii.sequences, "__defaults__", (60, 10))
    cut = pii.added_spans(mixed, base, crf)
    assert sum(map(len, whole)) > 30
    same = sum(len({*a} & {*b}) for a, b in zip(whole, cut, strict=True))
    assert same >= 0.95 * sum(len({*a} | {*b}) for a, b in zip(whole, cut, strict=True))


def test_number_before_a_long_run_is_found():
    crf = pii.default_model()
    text = f"please call {NUMBER},{RUN}{RUN} and more words"
    found = pii.added_spans([text], [pii.base_spans(text)], crf)[0]
    assert any(s <= text.index("555") and text.index("4567") + 4 <= e and kind == pii.KINDS.index("phone") for s, e, kind in found), found


CASES = [
    "mail JOHN AT EXAMPLE DOT COM now",
    "İ mail JOHN AT EXAMPLE DOT COM now",
    f"write {'x' * 20}(at)example.com today",
    f"write {'x' * 60}(at)example.com today",
    f"write {'x' * 300} anna(at)example.com today",
]


@pytest.mark.parametrize("text", CASES)
def test_addresses_in_words(text):
    crf = pii.default_model()
    found = pii.added_spans([text], [pii.base_spans(text)], crf)[0]
    assert [k for *_, k in found] == [pii.KINDS.index("email")], found


def test_kept_columns_of_any_name(spark):
    rows = [(1, "a@b.co", 5, "x", "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_phone long, _text string, _id string")
    got = pii.find_pii(df, keep=("_text", "_id")).collect()
    assert [(r.doc_id, r.n_email, r._text, r._id) for r in sorted(got, key=lambda r: r.doc_id or 0)] == [(None, 0, None, None), (1, 1, "x", "y")]
    assert pii.find_pii(df.withColumnRenamed("n_phone", "spans"), keep=("spans",)).count() == 2


def test_tokens_of_odd_texts():
    """Places and shapes as single matches give them; long white space, at the end too, stays linear."""
    import re
    import time

    for text in ("", " ", "a", "  Ab12 _x@y.z　\x1c7٠ \U0001d7d9é\n", "x  " * 50, "\n a-b"):
        want, end = [], -1
        for m in re.finditer(r"[^\W\d_]+|[0-9]+|[^\s]", text):
            want.append((m.start(), m.end(), pii.shape(m[0], m.start() != end)))
            end = m.end()
        assert pii.tokens_of(text) == want
    began = time.process_time()
    assert len(pii.tokens_of("a" + " " * 300_000 + "b" + " " * 300_000)) == 2
    assert time.process_time() - began < 5
    assert not hasattr(pii.shape, "cache_info")  # one look-up by the token, not a call with two arguments
