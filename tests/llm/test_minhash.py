"""Near-duplicate groups against all pairs."""

import os
import random
from collections import Counter

import pytest

from corvane.llm import components, minhash
from corvane.llm.shared import Scratch


def brute(rows, words, percent):
    """{row: (n, component, kept)} by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    of = Counter()
    at = {}
    for k, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(k)
    for ks in at.values():
        for x in ks:
            for y in ks:
                if x < y:
                    of[x, y] += 1
    for (x, y), common in of.items():
        if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common) and None not in (rows[x][0], rows[y][0]):
            a, b = sorted((find(rows[x][0]), find(rows[y][0])))
            top[b] = a
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Counter(map(tuple, minhash.near_duplicates(docs, words=4).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)


def test_chain_hub_and_odd_rows(spark):
    """A chain whose ends differ, copies, a hub of near copies, and rows with nulls or repeated ids."""
    draw = random.Random(1)
    text = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows, chain = [], list(text)
    for i in range(40):
        rows.append((1000 - i, " ".join(chain)))
        chain[(7 * i) % 120] = f"x{i}"
    hub = [f"v{i}" for i in range(200)]
    for i in range(60):
        own = list(hub)
        for _ in range(i % 5):
            own[draw.randrange(200)] = f"y{draw.randrange(10**6)}"
        rows.append((2000 + i, " ".join(own)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "a b c d"), (7, "w w w w w"), (8, "W w w w w"), (None, "a b"), (None, None), (9, "é É"), (10, "é é"), (11, "z " * 50_000)]
    rows += [(4, "a b")] * 2
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, c int, n int, label int")
    got = Counter(map(tuple, minhash.near_duplicates(docs, words=4).collect()))
    assert got == brute(rows, 4, 80)
    assert minhash.near_duplicates(docs.limit(0), words=4).count() == 0


def test_signature_is_unbiased():
    """The share of equal values estimates the similarity."""
    draw = minhash.np.random.default_rng(3)
    sketch = minhash.Sketch(2000, 5)
    shared, a, b = (draw.integers(0, 2**63, n, minhash.np.uint64) for n in (300, 100, 100))
    x, y = (minhash.np.unique(minhash.np.concatenate([shared, s])) for s in (a, b))
    assert abs((sketch.signature(x) == sketch.signature(y)).mean() - 0.6) < 0.04


@pytest.mark.parametrize("n", [1, 50])
def test_components(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.v: r.label for r in components.connected(links, Scratch(spark, "test"), "t").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}


def test_components_grow(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    scratch = Scratch(spark, "test")
    first = components.extend_components(None, frame([(5, 6), (7, 8), (1, 2)]), scratch, "a")
    second = components.extend_components(first, frame([(6, 8), (9, 2), (20, 21)]), scratch, "b")
    assert {r.v: r.label for r in second.collect()} == {5: 5, 6: 5, 7: 5, 8: 5, 1: 1, 2: 1, 9: 1, 20: 20, 21: 20}
    third = components.extend_components(second, frame([]), scratch, "c")
    assert third.count() == 9


def test_ids_with_several_texts(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "ABCDE"}
    rows = [(3, text["A"]), (5, text["A"]), (5, text["B"]), (7, text["B"]), (10, text["C"]), (9, text["C"]), (11, text["C"]), (11, text["D"]), (8, text["D"]), (20, text["E"]), (20, None), (20, ""), (19, text["E"]), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash.near_duplicates(docs, words=4).collect())) == brute(rows, 4, 80)


def family(n, seed=2):
    """Texts of a template of 840 words and four passages of 40 words from a pool, in which each passage is in about eight texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(10**7)}"
    template = [word() for _ in range(840)]
    pool = [[word() for _ in range(40)] for _ in range(n // 2)]
    return [(k, " ".join(template + [w for p in draw.sample(pool, 4) for w in p])) for k in range(n)]


def test_template_families_stay_linear(spark, monkeypatch):
    """Texts that share a template but aren't near copies make pairs in proportion to their number, and no link is lost."""
    confirm, counts = minhash._confirm, {}

    def counted(pairs, sets, percent):
        counts[n] = counts.get(n, 0) + pairs.count()
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(minhash, "_confirm", counted)
    for n in (240, 480):
        rows = family(n)
        rows += [(n + k, rows[k][1].replace("w1", "v1", 3)) for k in range(0, n, 40)]
        got = Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert got == brute(rows, 5, 80)
    # 10,992 and 23,342 of 28,680 and 114,960 pairs when this was written, those with hubs included
    assert counts[480] < 2.4 * counts[240] and counts[480] < 52 * 480, counts


def test_no_link_is_lost_near_the_threshold(spark):
    """Random edits of one text, whose similarities lie on both sides of the threshold, against all pairs."""
    draw = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(draw.randrange(2, 9)):
            own[draw.randrange(80)] = f"x{draw.randrange(60)}"
        rows.append((k, " ".join(own[: draw.randrange(60, 81)])))
    assert Counter(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect())) == brute(rows, 2, 80)


def test_tables_go(spark):
    folder = Scratch(spark, "x").path.rpartition("/")[0].removeprefix("file://")
    before = set(os.listdir(folder))
    found = minhash.near_duplicates(spark.createDataFrame([(k, "a b c d e f g " * (k % 3 + 1)) for k in range(9)], "doc_id long, text string"))
    assert found.count() == 9
    (new,) = [x for x in set(os.listdir(folder)) - before if x.startswith("minhash-")]
    assert not {"shared", "sets"} & set(os.listdir(f"{folder}/{new}")) and not [x for x in os.listdir(f"{folder}/{new}") if x.startswith(("pairs", "links", "open"))]
