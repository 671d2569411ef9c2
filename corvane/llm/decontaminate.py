"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is one Arrow batch of documents. Its words become symbols of the test phrases' alphabet. A word outside
it can't be inside an occurrence, so the text is cut there, and pieces shorter than the shortest phrase are left
out of the index. All phrases are searched backwards through the ranks of the wavelet matrix, occurrences are
located by walking to a sampled suffix position, and the words they cover merge into removal spans.

The phrases go to the tasks in blocks of about ``block_bytes`` of benchmark text. With more than one block, what a block found is
written to the shared folder before the next block is read, so the driver and a task hold one block at a time, whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import Scratch, extend

#: A-Z in lower case; digits, letters and bytes of other characters as they are; blanks for the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """Distinct windows of items as rows of symbols."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in items]
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            words = split_words(text)
            for i in range(max(len(words) - window + 1, min(1, len(words)))):
                owners.setdefault(tuple(words[i : i + window]), set()).add(k)
        self.alphabet = {w: i + 1 for i, w in enumerate(sorted({w for p in owners for w in p}))}
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), window), np.int32)
        for row, p in enumerate(owners):
            self.table[row, : len(p)] = [self.alphabet[w] for w in p]
        self.owners = [sorted(x) for x in owners.values()]
        self.shortest = int(self.lengths.min(initial=window))


def search_shard(words: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """For each document, its merged spans of covered words [start, end), and the items that occur."""
    spans: list[list[tuple[int, int]]] = [[] for _ in words]
    items: list[set[int]] = [set() for _ in words]
    get, size = phrases.alphabet.get, np.array([len(w) for w in words], np.int64)
    # a 0 after each document keeps pieces within it
    symbols = np.zeros(int(size.sum()) + len(words), np.int32)
    at = 0
    for w in words:
        symbols[at : at + len(w)] = [get(x, 0) for x in w]
        at += len(w) + 1
    inside = symbols > 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= phrases.shortest
    first, last = first[long], last[long]
    if not len(first) or not len(phrases.lengths):
        return spans, items
    length = last - first + 1  # with the 0 that follows
    origin = np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)
    index = FMIndex(symbols[origin], len(phrases.alphabet) + 1)
    which, place = index.locate(*index.search(phrases.table, phrases.lengths))
    if not len(which):
        return spans, items
    begin = origin[place]
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + phrases.lengths[which], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8), [0]]))
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    starts = np.flatnonzero(edge == 1)
    for s, e, d in zip(starts.tolist(), np.flatnonzero(edge == -1).tolist(), (np.searchsorted(offset, starts, "right") - 1).tolist(), strict=True):
        spans[d].append((s - int(offset[d]), e - int(offset[d])))
    doc = np.searchsorted(offset, begin, "right") - 1
    for pair in np.unique(doc * len(phrases.owners) + which).tolist():
        items[pair // len(phrases.owners)].update(phrases.owners[pair % len(phrases.owners)])
    return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; overlapping and touching ones become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _characters(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Word spans as code points, from the first word's start to the last word's end."""
    if not spans:
        return []
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    count = lambda b: len(raw[:b].decode())
    return [[count(at[s][0]), count(at[e - 1][1])] for s, e in spans]


def _without(text: str, marks: list[list[int]]) -> str:
    """The text without the marked spans."""
    return "".join(text[a:b] for a, b in zip([0, *(e for _, e in marks)], [*(s for s, _ in marks), len(text)], strict=True)) if marks else text


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks of about ``block_bytes`` the items make, and the blocks, each collected when it is asked for."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("i"), F.coalesce(benchmark[text_col], F.lit("")).alias("t")).filter("i IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // block_bytes + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, ([(r.i, r.t) for r in items.filter(part == k).collect()] for k in range(n))


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 16_000_000,
    clean: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items, spans, and the columns of ``keep``.

    A phrase is ``window`` consecutive words of an item, or a shorter item's words. n_hit counts the words
    inside any occurrence, items lists the occurring items' ids as sorted strings, and spans the code
    points [start, end) to remove. With ``clean``, cleaned is the text without its spans. A null text has
    no words; items without words or with a null id have no phrases; items that repeat an id count as one.
    Repeated rows are rows of their own. An empty table on either side gives no hits. Other columns are not read but for those
    of ``keep``, whose names may be any that the result's own columns don't have.
    """
    df = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"), *[docs[c].alias(f"_keep_{c}") for c in keep])
    df = df.withColumn("_spans", F.expr("CAST(array() AS array<array<int>>)")).withColumn("_items", F.expr("CAST(array() AS array<string>)"))
    count, parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    scratch = Scratch(docs.sparkSession, "benchmark")
    for number, block in enumerate(parts, 1):
        phrases, last = Phrases(block, window), number == count

        def start(phrases=phrases, last=last):
            def make(batch):
                texts = batch["_text"].to_pylist()
                words = [split_words(t) for t in texts]
                spans, items = search_shard(words, phrases)
                spans = [_merge([*map(tuple, old), *new]) for old, new in zip(batch["_spans"].to_pylist(), spans, strict=True)]
                items = [sorted({*old, *(phrases.ids[k] for k in new)}) for old, new in zip(batch["_items"].to_pylist(), items, strict=True)]
                if not last:
                    return [[[list(x) for x in s] for s in spans], items]
                marks = [_characters(t, s) for t, s in zip(texts, spans, strict=True)]
                out = [[len(w) for w in words], [sum(e - s for s, e in x) for x in spans], items, marks]
                return out + ([[_without(t, m) for t, m in zip(texts, marks, strict=True)]] if clean else [])

            return make

        new = "n_words long, n_hit long, items array<string>, spans array<array<int>>" + ", cleaned string" * clean
        df = extend(df, new if last else "_new_spans array<array<int>>, _new_items array<string>", start, drop=("_spans", "_items", "_text")[: 3 if last else 2])
        df = df.withColumnsRenamed({"_new_spans": "_spans", "_new_items": "_items"})
        if not last:
            df = scratch.table(f"block-{number}", df)
            if number > 1:
                scratch.drop(f"block-{number - 1}")
    return df.select(F.col("_id").alias(id_col), "n_words", "n_hit", "items", "spans", *["cleaned"] * clean, *[F.col(f"_keep_{c}").alias(c) for c in keep])


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The counts of ``find_benchmark``, with the items as a digest, and contaminated (n_hit > 0)."""
    found = find_benchmark(docs, benchmark, **options)
    names = F.concat_ws(",", "items")
    return found.select(found.columns[0], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS p FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM phrases),
docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS p FROM docs, sizes WHERE len(w) >= n),
found AS (SELECT DISTINCT doc_id, n, pos, item FROM places JOIN phrases USING (n, p)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM (SELECT DISTINCT doc_id, n, pos FROM found)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
