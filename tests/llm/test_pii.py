"""Personal data against the plain patterns, and the random field on held-out rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            good = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0)
                or (kind == "phone" and 9 <= len(d) <= 15)
            )
            if good:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-_ 0159+()é%", max_size=40) | st.from_regex(r"(\+?[0-9 .-]{8,30}|[a-c._]{1,4}@[ab_.@-]{1,12}){1,3}", fullmatch=True))
def test_base(text):
    assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def model():
    return pii.default_model()


def test_field_on_held_out_rows(model):
    right = wrong = missed = 0
    for text, spans in pii.labelled_table(copies=5, seed=99):
        base = pii.base_spans(text)
        got = {x[:3] for x in pii.added_spans([text], [base], model)[0]} | set(base)
        want = {x for x in spans if pii.plausible(text[x[0] : x[1]], x[2])} | set(base)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.9, (right, wrong, missed)


def test_viterbi_is_best(model):
    """Against all label sequences of a short text."""
    q = pii.tokens_of("w at 555")
    codes, lengths = model.encode([q, pii.tokens_of("call 12"), []])
    score, move = model.scores(codes), model.move + model.barred
    got = model.viterbi(codes, lengths)
    for row in range(2):
        n = lengths[row]
        every = np.array(np.meshgrid(*[range(len(pii.LABELS))] * n, indexing="ij")).reshape(n, -1).T
        total = score[row, 0][every[:, 0]] + model.starts()[every[:, 0]]
        for t in range(1, n):
            total = total + move[every[:, t - 1], every[:, t]] + score[row, t][every[:, t]]
        assert every[total.argmax()].tolist() == got[row, :n].tolist()


def test_documents_and_odd_rows(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "call (017) 555-7713 now"), (-4, "9" * 100_000), (-5, "a" * 100_000 + "@"), (-6, "é ann at mail dot com."), (-6, "1.2.3.4"), (None, "x@y.z"), (-6, "1.2.3.4"), (-7, "+1 " * 50_000)]
    df = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS spans", "2 AS n_ip")
    got = pii.find_pii(df, crf=model).collect()
    name = lambda xs: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in xs)
    want = Counter()
    for r in df.collect():
        b = brute(r.text or "") if len(r.text or "") < 100_000 else pii.base_spans(r.text)
        want[r.doc_id, *[sum(x[2] == k for x in b) for k in range(4)], hashlib.sha256(name(b).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    spans = {r.doc_id: r.spans for r in got}
    assert spans[-3] == "phone:5:19" and spans[-6] in ("ip:0:7", "email:2:21") and spans[-1] == ""
    assert pii.find_pii(df.limit(0), crf=model).count() == 0
    for r in got:  # base spans stay
        assert len(r.spans.split(",") if r.spans else []) >= r.n_email + r.n_ip + r.n_card + r.n_phone
