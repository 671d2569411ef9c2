"""The whole answer, its cards, marked snippets and summaries over whole tables against a plain version."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions import lexicon as lex
from corvane.operators import answers
from corvane.plans import queries

FOLDER = "/root/testdata/sf0.001"


def marked(query, text, span=420):
    """Words of four letters or more in marks, longest first, around the first of them, escaped."""
    words = list(dict.fromkeys(w for w in re.findall(r"\w{4,}", query) if w.lower() not in lex.HIGHLIGHT_STOP))
    places = [p for w in words if (p := text.lower().find(w.lower())) >= 0]
    start = max(0, min(places) - 80) if places else 0
    cut = re.sub(r"\s+", " ", text[start : start + span]).strip()
    for w in sorted(words, key=len, reverse=True):
        cut = re.sub(rf"(?<!\w)({re.escape(w)})(?!\w)", r"§§\1§§", cut, flags=re.I)
    whole = ("… " if start else "") + cut + (" …" if len(text) > span else "")
    return re.sub("§§(.+?)§§", r"<mark>\1</mark>", whole.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def distinct_openings(rows):
    kept, seen = [], set()
    for r in rows:
        sign = re.sub(r"[\W_]", lambda m: "_" if m.group() == "_" else "", (r.text or "")[:120].lower())[:80]
        if sign not in seen:
            kept.append(r)
            seen.add(sign)
    return kept


def counted(names, most):
    return Counter(names).most_common(most)  # ties in the order of their first place


def test_respond_whole_table(spark):
    asked = {r.qid: r.query for r in queries._asked(spark, FOLDER).collect()}
    results, whole = defaultdict(list), defaultdict(dict)
    for r in queries._results(spark, FOLDER).collect():
        results[r.qid].append(r)
    for r in queries._passages(spark, FOLDER).collect():
        whole[r.doc_id][r.chunk_idx] = r.text
    got = defaultdict(list)
    for r in queries.respond(spark, FOLDER).collect():
        got[r.qid].append(r)
    assert set(got) == set(asked)
    states = Counter()
    for q, query in asked.items():
        rows = sorted(results[q], key=lambda r: r.pos)
        first = got[q][0]
        states[first.state] += 1
        if not rows or (rows[0].dense_score or 0) < 0.2:
            assert (first.state, first.summary, first.n_cards, len(got[q])) == ("abstained", None, first.n_cards, 1) and first.place is None
            continue
        kept = distinct_openings(rows)
        assert first.state == "answered" and [r.place for r in sorted(got[q], key=lambda r: r.place)] == list(range(1, len(kept) + 1)) and first.n_cards == len(kept)
        for card, r in zip(sorted(got[q], key=lambda r: r.place), kept):
            text = "\n\n".join(dict.fromkeys(t for _, t in sorted(whole[r.did].items())))
            level = "Yüksek" if r.dense_score >= 0.2 + 0.2 else "Orta" if r.dense_score >= 0.2 + 0.08 else "Sınırlı"
            assert (card.kurul, card.reference, card.level) == (r.kurul or "Bilinmeyen Daire", f"Esas {r.esas_no} · Karar {r.karar_no} · —", level)
            assert card.snippet == marked(query, r.text) and card.chips == (r.kanunlar or [])[:3]
            assert card.full_text == text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\n", "<br>")
        board, n = counted([r.kurul or "?" for r in kept], 1)[0]
        many = len({r.kurul or "?" for r in kept})
        lines = [f"<b>{len(kept)}</b> emsal " + (f"çoğunlukla <b>{board}</b>" if n > 1 else f"<b>{many} farklı daireden</b>") + " geldi."]
        verdicts = counted([k for r in kept for k, p in lex.VERDICTS.items() if re.search(p, (r.text or "").lower())], 3)
        laws = counted([k for r in kept for k in r.kanunlar], 2)
        lines += [f"<b>Hüküm dağılımı:</b> {' · '.join(f'{k} ({c})' for k, c in verdicts)}"] * bool(verdicts) + [f"<b>Sık atıf:</b> {'; '.join(k for k, _ in laws)}"] * bool(laws)
        assert first.summary == "<br>".join(lines)
    assert states["answered"] > 5 and states["abstained"] > 0, states


def test_marked_snippets_whole_table(spark):
    """Every hit of every item, as the query gives it."""
    rows = queries._bm25(spark, FOLDER, 10).join(queries._asked(spark, FOLDER), "qid").join(queries._docs(spark, FOLDER).select(F.col("doc_id").alias("did"), "text"), "did")
    want = {(r.qid, r.did): marked(r.query, r.text) for r in rows.collect()}
    assert {(r.qid, r.did): r.snippet for r in queries.marked_snippet(spark, FOLDER).collect()} == want and len(want) > 100


@pytest.mark.parametrize("query", [None, "", "  \n"])
def test_empty_queries(spark, query):
    schema = "qid int, did long, pos int, karar_id long, kurul string, esas_no string, karar_no string, tarih string, text string, kanunlar array<string>, dense_score double"
    rows = spark.createDataFrame([(1, 1, 1, 1, None, "", None, "t", "kira", None, 0.9), (2, 1, 1, 1, None, "", None, "t", "kira", None, 0.9)], schema)
    asked = spark.createDataFrame([(1, query), (2, "kira davası"), (3, "yok")], "qid int, query string")
    got = {r.qid: r for r in answers.respond(asked, rows, spark.createDataFrame([], "karar_id long, full_text string")).collect()}
    assert [got[i].state for i in (1, 2, 3)] == ["empty", "answered", "abstained"] and got[1].cards is None
    card = got[2].cards[0]
    assert (card.place, card.kurul, card.reference, card.snippet, card.full_text) == (1, "Bilinmeyen Daire", "Esas ? · Karar ? · t", "<mark>kira</mark>", "")
