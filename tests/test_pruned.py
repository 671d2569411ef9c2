"""Top-k over blocks of postings: the same rows as the full sum, and fewer postings read."""

import random

import pytest

from corvane.operators import lexical, pruned
from corvane.plans import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("k", "size", "seeds"), [(1, 3, 1), (3, 1, 2), (5, 4, 1), (50, 7, 2)])
def test_equals_full_search(spark, k, size, seeds):
    """Few words and many ties; frequent words whose idf is raised; null and empty texts; queries without a hit; fewer than k documents."""
    rng = random.Random(k)
    words = ["kira", "tahliye", "nafaka", "velayet", "miras", "tapu"]
    docs = [(i, " ".join(rng.choices(words, [9, 5, 3, 1, 1, 1], k=rng.randrange(6))) or None) for i in range(60)]
    corpus = spark.createDataFrame(docs, "did long, text string")
    asked = spark.createDataFrame([(1, "kira"), (2, "kira kira miras tapu"), (3, "velayet nafaka"), (4, "hiç"), (5, None)], "qid int, text string")
    index = lexical.fit(corpus, "did", "text")
    want = lexical.search(index, asked, "qid", "text", k).collect()
    got = pruned.search(pruned.build(index, size), asked, "qid", "text", k, seeds).collect()
    assert sorted(map(tuple, ((r.qid, r.did, r.score, r["rank"]) for r in got))) == sorted((r.qid, r.did, r.score, r["rank"]) for r in want) and len(want) > 0


def test_reads_fewer_postings(spark):
    """All items over the whole table: under half of their postings is read for the best document, and rows are those of the full search."""
    index, asked = queries._index(spark, FOLDER), queries.table(spark, FOLDER, "benchmark")
    blocks = pruned.build(index, 16, lexical.query_terms(asked, "item_id", "text"))
    got, work = pruned.run(blocks, asked, "item_id", "text", 1, 2)
    key = lambda r: (r.qid, r.did, r.score, r["rank"])
    assert sorted(map(key, got.collect())) == sorted(map(key, lexical.search(index, asked, "item_id", "text", 1).collect()))
    total = work.selectExpr("sum(postings) AS all", "sum(postings_read) AS some").first()
    assert 0 < total.some < total.all / 2, total


def test_empty(spark):
    index = lexical.fit(spark.createDataFrame([], "did long, text string"), "did", "text")
    assert pruned.search(pruned.build(index), spark.createDataFrame([(1, "kira")], "qid int, text string"), "qid", "text").count() == 0
