"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles, as 64-bit hashes. Each of ``permutations`` hash functions gives two
signature values, the set's minimum and its maximum under it (Ji et al., "Min-Max Hash for Jaccard Similarity", 2013):
half the hash evaluations of plain MinHash, and an unbiased estimate of lower variance. ``rows`` values make a band;
documents that agree on a band are candidates, and candidates are confirmed on their full sets.

With the default 80 permutations there are 32 bands of 5 values: a pair at the threshold of 0.8 misses all
bands with a probability of 0.000003, and one at 0.9 practically never.

Work is kept in proportion to the input:

* Documents with one set are one class; only its smallest id takes part.
* In each bucket of a band, members meet a hub, the member with the smallest hash (a star, with another hub in each
  band); then, in buckets with more than one component left, the one with the largest.
* What is left are classes that share a bucket with another component. Those that can link are found by a prefix join over all of them:
  shingles are put in one order, first those of a single component, then the rarest first. Of two linked sets, the smaller one
  has a common shingle among its first n - 2sn / (1 + s) + 1, the larger one among its first n - sn + 1. So what a whole family of
  texts shares, a template say, comes last and is never joined on, and pairs without a rare shingle in common are never made.
* Texts are read twice; sets are only built for classes that share a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import extend_components
from .shared import Scratch, extend, sweep

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct shingle hashes of a text: lower-cased A-Z, words between ASCII white space."""

    def __init__(self, words: int, table_words: int = 150_000):
        self.k, self.most, self.table = words, table_words, _Words()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.table) > self.most:
            self.table.clear()
        h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        sums = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):  # Horner's rule, mixed at each word so that order counts
            sums = _finish(sums * _MIX[i % 4] + h[i : len(h) - k + 1 + i])
        return np.unique(sums)


class Sketch:
    """Band hashes of a set."""

    def __init__(self, permutations: int, rows: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.factors = draw.integers(1, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = draw.integers(0, 2**63, permutations, np.uint64)
        self.bands, self.rows = 2 * permutations // rows, rows
        self.weights = draw.integers(1, 2**63, (self.bands, rows), np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum and maximum under each permutation, side by side. Blocks of shingles stay in the processor's cache."""
        low, high = np.full(len(self.factors), 2**64 - 1, np.uint64), np.zeros(len(self.factors), np.uint64)
        for k in range(0, len(shingles), 512):
            x = np.multiply.outer(self.factors, shingles[k : k + 512])
            x += self.offsets[:, None]
            np.minimum(low, x.min(1), out=low)
            np.maximum(high, x.max(1), out=high)
        return np.stack([low, high], 1).ravel()

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        values = _finish(self.signature(shingles))[: self.bands * self.rows].reshape(self.bands, self.rows)
        return _finish((values * self.weights).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), the pairs with 100 * intersection >= percent * union on their full sets."""
    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("_sa")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("set").alias("_sb")), "b")

    def start():
        def linked(x: np.ndarray, y: np.ndarray) -> bool:
            merged = np.sort(np.concatenate([x, y]))
            common = int((merged[1:] == merged[:-1]).sum())
            return 100 * common >= percent * (len(merged) - common)

        return lambda batch: [[linked(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch["_sa"], batch["_sb"], strict=True)]]

    return extend(both, "_linked boolean", start, drop=("_sa", "_sb")).filter("_linked").select("a", "b")


def _rare_pairs(pool: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of the open classes of different components that can reach the threshold, by a prefix join on rare shingles.

    A link needs intersection * (100 + percent) >= percent * (n + other n), so with the other set at least as large, 2 * percent * n /
    (100 + percent) common shingles, and with the other at most as large, percent * n / 100. In any one order of all shingles the
    first common one is then at a place in either set that leaves as many behind it. Shingles of one component only are
    first in the order, as they can't be common to a pair; a class whose others are too few drops out. After its first common shingle a
    pair has at most as many as are left in either set, so a pair is only made on a shingle with enough left in both.
    """
    # an id that stands for several sets counts with all their shingles and the least and the largest size
    classes = pool.groupBy("c").agg(F.min("n").alias("n"), F.max("n").alias("m"), F.min("label").alias("label"))
    pieces = classes.join(sets, "c").select("c", "n", "m", "label", F.explode("set").alias("g"))
    across = pieces.groupBy("g").agg(F.min("label").alias("_l0"), F.max("label").alias("_l1"), F.count("*").alias("f")).filter("_l0 < _l1").select("g", "f")
    ranked = pieces.join(across, "g").groupBy("c", "n", "m", "label").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("_r"))
    least = lambda by, of: F.size("_r") - F.ceil(F.col("n") * by / F.lit(float(of))).cast("int") + 1
    ranked = ranked.withColumn("probe", least(percent, 100)).withColumn("index", least(2 * percent, 100 + percent)).filter("probe > 0")
    # rest is how many shingles of the set come after this one
    entry = ranked.select("c", "n", "m", "label", "index", F.size("_r").alias("_size"), F.posexplode(F.expr("slice(_r, 1, probe)")).alias("at", "_x"))
    entry = scratch.table("entries", entry.select("c", "n", "m", "label", "index", "at", F.col("_x.g").alias("g"), (F.col("_size") - 1 - F.col("at")).alias("rest")))
    left = entry.filter("at < index").select("g", F.col("c").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("label").alias("la"), F.col("rest").alias("ra"))
    right = entry.select("g", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("rest").alias("rb"))
    enough = (F.least("ra", "rb") + 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    sides = (F.col("la") != F.col("lb")) & (F.struct("na", "a") < F.struct("nb", "b")) & (F.col("ma") * 100 >= F.col("nb") * percent)
    return left.join(right, "g").filter(sides & enough).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    permutations: int = 80,
    rows: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked if their sets' Jaccard similarity is at least ``percent`` hundredths; component_id is
    the smallest id reachable over links, and kept says whether that is the row's own. A text with fewer
    than ``words`` words is one shingle; a null text or one without words has an empty set and stays by
    itself. Rows that repeat an id are one vertex, with the links of all of them. A row with a null id is
    linked with nothing; its component_id is null and kept is true. An empty table gives an empty result.
    Ids are integers. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    base = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))

    def start():
        shingle, sketch = Shingler(words), Sketch(permutations, rows)

        def make(batch):
            out = [[], [], []]
            for text in batch["_text"].to_pylist():
                s = shingle(text)
                out[0].append(len(s))
                out[1].append(_digest(s) if len(s) else None)
                out[2].append(sketch(s) if len(s) else None)
            return out

        return make

    sketched = scratch.table("sketched", extend(base, "n long, digest binary, bands array<long>", start))
    usable = sketched.filter("_id IS NOT NULL AND n > 0")
    classes = scratch.table("classes", usable.groupBy("digest").agg(F.min("_id").alias("c")))
    # ids with several sets, rarely any: their classes are linked
    several = sketched.filter("_id IS NOT NULL").groupBy("_id").agg(F.min("digest").alias("_d0"), F.max("digest").alias("_d1"), F.min("n").alias("_n0"))
    several = scratch.table("several", several.filter("_d0 <> _d1 OR (_n0 = 0 AND _d0 IS NOT NULL)").select("_id"))
    held = usable.join(several, "_id").join(classes, "digest").groupBy("_id", "c").agg(F.count("*")).select("_id", "c")
    held = scratch.table("held", held.join(held.groupBy("_id").agg(F.min("c").alias("_c")), "_id"))
    own = usable.join(classes.select(F.col("digest").alias("_d"), "c"), (F.col("digest") == F.col("_d")) & (F.col("_id") == F.col("c")), "left_semi")
    own = own.dropDuplicates(["_id", "digest"])
    members = own.select(F.col("_id").alias("c"), "n", "digest", F.posexplode("bands").alias("band", "h"))
    draw = F.struct(F.xxhash64("c", "band").alias("x"), "c")
    buckets = members.groupBy("band", "h").agg(F.min(draw).c.alias("low"), F.max(draw).c.alias("high")).filter("low <> high")
    shared = scratch.table("shared", members.join(buckets, ["band", "h"]).select("band", "h", "c", "n", "digest", "low", "high"))
    needed = shared.select("c", "digest").distinct()

    def start_sets():
        shingle = Shingler(words)

        def make(batch):
            sets = [shingle(t) for t in batch["_text"].to_pylist()]
            return [[_digest(s) == d for s, d in zip(sets, batch["digest"].to_pylist(), strict=True)], [s.view(np.int64) for s in sets]]

        return make

    texts = base.join(needed, base["_id"] == needed["c"]).select("c", "digest", "_text").dropDuplicates(["c", "digest", "_text"])
    sets = extend(texts, "same boolean, set array<long>", start_sets, drop=("_text", "digest")).filter("same").select("c", "set")
    sets = scratch.table("sets", sets)
    sweep(docs.sparkSession)
    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    labels = None
    for turn, hub in enumerate(("low", "high", None)):
        pool = shared
        if labels is not None:
            named = shared.join(labels, shared["c"] == labels["v"], "left").withColumn("label", F.coalesce("label", "c")).drop("v")
            open_ = named.groupBy("band", "h").agg(F.min("label").alias("_l0"), F.max("label").alias("_l1")).filter("_l0 < _l1").select("band", "h")
            pool = scratch.table(f"open-{turn}", named.join(open_, ["band", "h"]))
        if hub:
            hubs = pool.filter(F.col("c") == F.col(hub))
            hubs = hubs.select("band", "h", F.col("c").alias("b"), F.col("n").alias("nb"), *([F.col("label").alias("lb")] if labels is not None else []))
            pairs = pool.filter(F.col("c") != F.col(hub)).join(hubs, ["band", "h"]).filter(fits("n", "nb"))
            pairs = (pairs.filter("label <> lb") if labels is not None else pairs).select(F.col("c").alias("a"), "b")
        else:
            pairs = _rare_pairs(pool, sets, percent, scratch)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.table(f"pairs-{turn}", pairs)
        found = scratch.table(f"links-{turn}", _confirm(pairs, sets, percent))
        older, labels = labels, extend_components(labels, found, scratch, f"components-{turn}")
        scratch.drop(f"pairs-{turn}", f"links-{turn}", *[f"open-{turn}", f"components-{turn - 1}"] * (older is not None))
        sweep(docs.sparkSession)
    scratch.drop("shared", "sets", "entries")
    links = held.filter("c <> _c").select(F.col("c").alias("a"), F.col("_c").alias("b"))
    if not links.isEmpty():
        labels = extend_components(labels, links, scratch, "components-ids")
    found = classes.join(labels, classes["c"] == labels["v"], "left").select(F.col("digest").alias("_d"), F.coalesce("label", "c").alias("component_id"))
    out = sketched.join(found, F.col("digest") == F.col("_d"), "left")
    if not held.isEmpty():  # an empty row of an id that also has words
        whole = held.select(F.col("_id").alias("_i"), F.col("_c").alias("v")).distinct().join(labels, "v", "left").select("_i", F.coalesce("label", "v").alias("_of"))
        out = out.join(whole, F.col("_id") == F.col("_i"), "left").withColumn("component_id", F.coalesce("component_id", "_of"))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


#: For four words and a similarity of 0.8: pairs that share a shingle, and their reach by a recursive query.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, md5_number(s) AS s
    FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM split WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM split UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_id LEFT JOIN sizes USING (doc_id)
"""
