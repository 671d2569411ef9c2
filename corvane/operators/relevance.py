"""Relevance by keywords (groups of terms of which any must be complete) and by containment."""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.functions import text as T
from corvane.functions.words import cut


def normed_groups(groups: Column, norm) -> Column:
    """Groups with their terms normalised, for the functions that take normalised texts."""
    return F.transform(groups, lambda g: F.transform(g, norm))


def keyword_complete(groups: Column, doc: Column) -> Column:
    """Whether the text has all terms of any group; both are normalised already."""
    return F.exists(groups, lambda g: F.forall(g, lambda t: F.contains(doc, t)))


def grade(groups: Column, doc: Column) -> Column:
    """2 if the first group is complete, 1 if another is, else 0; both are normalised already."""
    first = F.array_position(F.transform(groups, lambda g: F.forall(g, lambda t: F.contains(doc, t))), F.lit(True))
    return T.let(first, lambda at: F.when(at == 1, 2).when(at > 1, 1).otherwise(0))


def keyword_relevant(groups: Column, text: Column) -> Column:
    """Whether the text has all terms of any group, both normalised, the text once."""
    return T.let(T.norm_keyword(text), lambda doc: keyword_complete(normed_groups(groups, T.norm_keyword), doc))


def graded_relevance(groups: Column, text: Column) -> Column:
    """2 if the first group is complete, 1 if another is, else 0; both are normalised, the text once."""
    return T.let(T.norm_graded(text), lambda doc: grade(normed_groups(groups, T.norm_graded), doc))


#: Up to so many items, and bytes of them, anchors go to the tasks; with more they are shuffled.
ITEMS, BYTES = 100_000, 64 << 20
#: Bytes of a batch whose words are cut at once; arrays made meanwhile are some ten times as large.
SLICE = 4 << 20


@cache
def _no_space() -> np.ndarray:
    """Whether a code point belongs to words between spaces, tabs, line ends and form feeds."""
    found = np.ones(0x110000, bool)
    found[[9, 10, 12, 13, 32]] = False
    return found


def containing(docs: DataFrame, items: DataFrame, words: int = 5) -> DataFrame:
    """(qid, did) of all documents (did, text) that contain an item (qid, text) verbatim.

    An item's words between its first and its last one are whole words of any text that contains it. The first ``words`` of these
    are its anchor; anchors meet the documents' windows of as many words by hash, and the pairs that meet are held against the texts, where they
    meet if the items are few, so that texts aren't joined again. Items of one or two words have no such words and are held against every
    document. Null texts contain nothing and null items nothing.
    """
    split = lambda c: F.split(c, r"[ \t\n\r\f]+")
    window = lambda i, k: F.xxhash64(*[F.get("_w", i + j) for j in range(k)])
    asked = items.select("qid", F.col("text").alias("_item")).filter("_item IS NOT NULL").withColumn("_w", split(F.col("_item")))
    asked = asked.withColumn("_k", F.greatest(F.lit(0), F.least(F.lit(words), F.size("_w") - 2)))
    sizes = asked.groupBy("_k").agg(F.count("*").alias("n"), F.sum(F.octet_length("_item")).alias("b")).collect()  # at most words + 1 rows
    small = sum(r.n for r in sizes) <= ITEMS and sum(r.b for r in sizes) <= BYTES
    text = docs.select("did", "text").withColumn("_w", split(F.col("text")))
    out = StructType([asked.schema["qid"], docs.schema["did"]])
    found = []
    for k in sorted(r._k for r in sizes if r._k):
        if small:
            few = asked.filter(F.col("_k") == k).select("qid", "_item", F.slice("_w", 2, k).alias("_a"))
            found.append(docs.select("did", "text").mapInArrow(_holding(few.toArrow(), k, to_arrow_schema(out)), out))
        else:
            place = F.when(F.size("_w") >= k, F.sequence(F.lit(0), F.greatest(F.size("_w") - k, F.lit(0))))
            anchors = asked.filter(F.col("_k") == k).select("qid", window(F.lit(1), k).alias("_h"))
            rows = text.select("did", "_w", F.explode(place).alias("_i")).select("did", window(F.col("_i"), k).alias("_h"))
            met = rows.join(anchors, "_h").select("qid", "did").distinct()
            again, whole = asked.filter(F.col("_k") == k).select(F.col("qid").alias("_q"), "_item"), docs.select(F.col("did").alias("_d"), "text")
            met = met.join(again, F.col("qid").eqNullSafe(F.col("_q"))).join(whole, F.col("did").eqNullSafe(F.col("_d")))  # null ids too
            found.append(met.filter(F.contains("text", F.col("_item"))).select("qid", "did"))
    if any(r._k == 0 for r in sizes):
        found.append(docs.select("did", "text").join(asked.filter("_k = 0").select("qid", "_item"), F.contains("text", F.col("_item"))).select("qid", "did"))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], out)


def _holding(few: pa.Table, k: int, types: pa.Schema):
    """The function of a task that gives (qid, did) of its documents (did, text) and the items of ``few`` (qid, _item, _a: an anchor of ``k`` words) that they contain."""
    few = few.combine_chunks()
    qids, items = few["qid"].combine_chunks(), few["_item"].to_pylist()
    coded = few["_a"].combine_chunks().flatten().cast(pa.large_string()).dictionary_encode()
    known, anchors = coded.dictionary, coded.indices.to_numpy().reshape(-1, k).astype(np.int64)
    order = np.lexsort(anchors.T[::-1])
    kinds, first, often = np.unique(anchors[order], axis=0, return_index=True, return_counts=True)
    key = lambda codes: reduce(lambda h, c: h * 1_000_003 + c.astype(np.uint64), codes.T, np.zeros(len(codes), np.uint64))
    keys = key(kinds)
    by_key = np.argsort(keys, kind="stable")
    keys, first, often = keys[by_key], first[by_key], often[by_key]
    at_place = np.zeros((k, len(known) + 1), bool)  # which words are at each place of an anchor; the last column is of words in none
    for j in range(k):
        at_place[j, anchors[:, j]] = True

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("text"))
        words, many = cut(texts, _no_space())
        code = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy()[words.indices.to_numpy()]
        doc, ends = np.repeat(np.arange(len(many)), many), np.cumsum(many)
        at = np.flatnonzero(at_place[0][code])
        at = at[at + k <= ends[doc[at]]]
        for j in range(1, k):
            at = at[at_place[j][code[at + j]]]
        # anchors with the window's key, all of them where keys or anchors are alike; what they are of is held against the text
        have = key(code[at[:, None] + np.arange(k)])
        low, high = np.searchsorted(keys, have, "left"), np.searchsorted(keys, have, "right")
        met = np.unique(np.stack([doc[at], low, high], 1)[high > low], axis=0).tolist()
        pairs = {(d, int(order[first[u] + i])) for d, lo, hi in met for u in range(lo, hi) for i in range(often[u])}
        rows, seen, text = [], -1, ""
        for d, a in sorted(pairs):
            if d != seen:
                seen, text = d, texts[d].as_py()
            if items[a] in text:
                rows.append((a, d))
        a, d = (pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))
        dids = batch.column(batch.schema.get_field_index("did"))
        return pa.RecordBatch.from_arrays([qids.take(a).cast(types.field(0).type), dids.take(d).cast(types.field(1).type)], schema=types)

    def run(batches):
        for whole in batches:
            step = max(1, whole.num_rows * SLICE // max(whole.nbytes, 1))
            for at in range(0, whole.num_rows, step):
                yield of_slice(whole.slice(at, step))

    return run
