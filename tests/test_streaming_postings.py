"""A stream's BM25 statistics against those of the documents that are left, batch by batch."""

import random

import pytest

from corvane.operators import lexical
from corvane.streaming import postings

WORDS = ["kira", "tahliye", "nafaka", "velayet", "miras", "tapu", "icra", "haciz"]


def found(index, queries):
    return sorted(map(tuple, lexical.search(index, queries, "qid", "text", 5).collect()))


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "kira tahliye"), (2, "nafaka nafaka velayet"), (3, "haciz")], "qid int, text string")


def test_equals_a_batch_fit(spark, queries, tmp_path):
    """After each of five batches of new, replaced, repeated and deleted documents, and after a batch that runs twice."""
    rng, live = random.Random(3), {}
    folder = str(tmp_path)
    for number in range(5):
        events = []
        for turn in range(12):
            i, text = rng.randrange(15), " ".join(rng.choices(WORDS, k=rng.randrange(9))) or None
            gone = rng.random() < 0.2
            events.append((i, text, gone, turn))
        events += [(None, "kira", False, 0), (99, "never", True, 0)]
        for i, text, gone, _ in events:
            if i is not None:
                live.pop(i, None)
                if not gone:
                    live[i] = text
        batch = spark.createDataFrame([*events, events[-3]], "doc long, text string, gone boolean, turn int")
        for _ in range(1 + (number == 3)):
            postings.upsert(batch, number, folder, "doc", deleted="gone", order="turn")
        whole = lexical.fit(spark.createDataFrame(list(live.items()), "doc long, text string"), "doc", "text")
        index = postings.index(spark, folder)
        assert (index.n, index.avgdl) == (whole.n, whole.avgdl)
        assert sorted(index.idf.collect()) == sorted(whole.idf.collect())
        assert sorted(index.postings.select("did", "dl", "tok", "tf").collect()) == sorted(whole.postings.select("did", "dl", "tok", "tf").collect())
        cut = postings.index(spark, folder, vocabulary=lexical.query_terms(queries, "qid", "text"))
        assert found(index, queries) == found(cut, queries) == found(whole, queries)


def test_stream_and_restart(spark, queries, tmp_path):
    """Files that come later continue the same tables; a large change is joined without a broadcast."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "kira tahliye"), (2, "nafaka"), (3, None)]
    stream = lambda: spark.readStream.schema("doc long, text string").parquet(source)
    for part in (rows, [(2, "kira"), (4, "haciz icra")]):
        spark.createDataFrame(part, "doc long, text string").coalesce(1).write.mode("append").parquet(source)
        postings.start(stream(), folder, "doc").awaitTermination()
    live = spark.createDataFrame([(1, "kira tahliye"), (2, "kira"), (3, None), (4, "haciz icra")], "doc long, text string")
    assert found(postings.index(spark, folder), queries) == found(lexical.fit(live, "doc", "text"), queries)


def test_nothing_yet(spark, queries, tmp_path):
    empty = postings.index(spark, str(tmp_path / "none"))
    assert empty.n == 0 and found(empty, queries) == []
    postings.upsert(spark.createDataFrame([], "doc long, text string"), 0, str(tmp_path / "one"), "doc")
    assert postings.index(spark, str(tmp_path / "one")).n == 0


def test_frequencies_are_counted_with_the_terms(spark, queries, tmp_path):
    """A batch's frequencies come in parts with its documents' rows, and rows of a vocabulary hold its words only."""
    folder = str(tmp_path)
    postings.upsert(spark.createDataFrame([(1, "kira kira tapu"), (2, "kira"), (3, None)], "doc long, text string"), 0, folder, "doc")
    postings.upsert(spark.createDataFrame([(1, "tapu haciz")], "doc long, text string"), 1, folder, "doc")
    parts = spark.read.parquet(f"{folder}/docs/batch=0").filter("tok IS NOT NULL").groupBy("tok").sum("df").collect()
    assert {(r[0], r[1]) for r in parts} == {("kira", 2), ("tapu", 1)}
    index = postings.index(spark, folder, vocabulary=lexical.query_terms(queries, "qid", "text"))
    assert {(r.tok, r.df) for r in index.idf.collect()} == {("kira", 1), ("tapu", 1), ("haciz", 1)} and index.n == 3
    assert sorted((r.did, r.tok, r.tf) for r in index.postings.collect()) == [(1, "haciz", 1), (2, "kira", 1)]
