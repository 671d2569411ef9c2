"""Items are found in the texts' bytes: the pairs of a plain search, on odd rows."""

import random

from corvane.operators import relevance

SPACES = [" ", "  ", "\t", "\n", "\r\n", "\f", "\x0b", "\xa0", " "]


def test_containment_in_bytes(spark, tmp_path, monkeypatch):
    """Items of every anchor's length, equal anchors, repeated rows, nulls and any characters; no window of a text becomes a row."""
    rng = random.Random(6)
    words = ["a", "b", "é", "日本", "𐐀", "the", "x,", "\0"]
    made = lambda n: "".join(rng.choice(words) + rng.choices(SPACES, [20, 1, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(n))
    texts = [made(rng.randrange(60)) for _ in range(60)] + [None, "", " ", "a", " a b c d e f"]
    items = [(i % 40, t[(at := rng.randrange(len(t))) : at + rng.randrange(4, 40)]) for i, t in enumerate(t for t in texts[:60] if t)]
    items += [items[0], (7, "no where to be found"), (8, "a b c x y z"), (9, None), (None, "a b c d"), (10, " a b "), (11, "b c d e f g")]
    items = [(q, x) for q, x in items if x is None or len([w for w in x.split(" ") if w]) > 2 or x == " a b "]
    rows = [(i % 50, t) for i, t in enumerate([*texts, texts[0]])]
    spark.createDataFrame(rows, "did long, text string").write.parquet(f"{tmp_path}/docs")
    docs, asked = spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(items, "qid long, text string")
    want = sorted(((q, d) for q, x in items for d, t in rows if x is not None and t is not None and x in t), key=str)
    found = relevance.containing(docs, asked)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == want and len(want) >= 50
    monkeypatch.setattr(relevance, "SLICE", 64)
    assert sorted(map(tuple, relevance.containing(docs, asked).collect()), key=str) == want
    monkeypatch.setattr(relevance, "ITEMS", 0)
    joined = set(map(tuple, relevance.containing(docs, asked).collect()))
    assert joined - set(want) == set() and set(want) - joined == set()
