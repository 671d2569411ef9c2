"""Secret scan with a random forest that removes false positives, in DataFrame functions only.

Candidates are long runs of key characters and private-key headers. Splitting a text at the candidates gives what stands
before and after each, and by the lengths its place, without a scan in Python. Features are the candidate's length,
shares of character classes, transitions between them, coverage by a dictionary, signs of a path, and words beside it.

The forest is fitted in numpy on a small table of labelled findings (made here from templates; its features come from the
same DataFrame functions) and turned into CASE expressions, so scoring stays in the JVM. Nothing is shuffled.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The candidate pattern, the dictionary, and words beside secrets and beside harmless strings.
CANDIDATE = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|[A-Za-z0-9+/_=-]{16,}+"
DICTIONARY = (
    "the and for with that this from are was not you all can has have been will one about other which when there would into more some "
    "time user name data file path test example config value string number index table query field class model token secret public private "
    "key keys code line page http https www com org net html json xml src lib bin usr var home main java python script module package "
    "version update release build document documents image images static assets content upload download content article section chapter "
    "ation tion ing ment ness able under over inter trans super service server client request response handler manager controller "
    "und der die das nicht eine ung heit keit lich les des que pour dans avec para con los las una ción mente"
).split()
NEAR_SECRET = r"(?i)(token|secret|passw|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
NEAR_HARMLESS = r"""(?i)(?<![a-z])(sha-?1|sha-?256|md5|commit|checksum|digest|hash|uuid|guid|etag|integrity|revision|build|isbn|fixture)\s{0,2}[:=]?\s{0,2}["'`]?$"""
BOUND = NEAR_SECRET + r"""\w{0,12}["'`]?\s{0,2}[:=]{1,2}\s{0,2}["'`]?$"""
ASSIGNED = r"""[:=]\s?["'`]?$"""
FEATURES = ("size", "digits", "upper", "lower", "marks", "hex", "turns", "vowels", "distinct", "covered", "slashes", "named", "harmless", "assigned", "bound", "quoted", "url")


def candidates(docs: DataFrame, id_col: str, text_col: str, width: int = 40) -> DataFrame:
    """(id, _start, _end, _cand, _before, _after): every candidate with ``width`` characters on both sides; places in code points."""
    text = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).filter(F.regexp_like("_text", F.lit(CANDIDATE)))
    cut = text.select("_id", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_c"), F.split("_text", CANDIDATE, -1).alias("_gaps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, x: F.struct((s.at + x.a + x.b).alias("at"), F.array_append(s.all, s.at + x.a).alias("all"))
    sizes = F.transform("_c", lambda c, i: F.struct(F.length(F.get(F.col("_gaps"), i)).alias("a"), F.length(c).alias("b")))
    rows = cut.withColumn("_starts", F.aggregate(sizes, start, step, lambda s: s["all"]))
    one = F.transform("_c", lambda c, i: F.struct(F.get(F.col("_starts"), i).alias("s"), c.alias("c"), F.right(F.get(F.col("_gaps"), i), F.lit(width)).alias("b"), F.left(F.get(F.col("_gaps"), i + 1), F.lit(width)).alias("a")))
    out = rows.select("_id", F.explode(one).alias("x"))
    return out.select("_id", F.col("x.s").alias("_start"), (F.col("x.s") + F.length("x.c")).alias("_end"), F.col("x.c").alias("_cand"), F.col("x.b").alias("_before"), F.col("x.a").alias("_after"))


def features(found: DataFrame) -> DataFrame:
    """The candidates with a column for each feature."""
    c, n = F.col("_cand"), F.length("_cand").cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    turns = count("[0-9](?=[A-Za-z])") + count("[A-Za-z](?=[0-9])") + count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")
    words = "|".join(sorted({w for w in DICTIONARY if w.isascii()}, key=lambda w: (-len(w), w)))
    left = F.length(F.regexp_replace(F.lower(c), words, "")).cast("double")
    flag = lambda b: F.coalesce(b.cast("double"), F.lit(0.0))
    made = {
        "size": F.least(n, F.lit(256.0)),
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "lower": count("[a-z]") / n,
        "marks": count("[+/_=-]") / n,
        "hex": count("[0-9a-f]") / n,
        "turns": turns / n,
        "vowels": count("[aeiouAEIOU]") / n,
        "distinct": F.size(F.array_distinct(F.split(F.substring(c, 1, 256), ""))).cast("double") / F.least(n, F.lit(256.0)),
        "covered": 1 - left / n,
        "slashes": count("/"),
        "named": flag(F.regexp_like("_before", F.lit(NEAR_SECRET))),
        "harmless": flag(F.regexp_like("_before", F.lit(NEAR_HARMLESS))),
        "assigned": flag(F.regexp_like("_before", F.lit(ASSIGNED))),
        "bound": flag(F.regexp_like("_before", F.lit(BOUND))),
        "quoted": flag(F.regexp_like("_before", F.lit("[\"'`]$")) & F.regexp_like("_after", F.lit("^[\"'`]"))),
        "url": flag(F.regexp_like("_before", F.lit(r"(?i)(://|www\.|\.)\S*$")) | F.regexp_like("_after", F.lit(r"^\.[a-z]{2,4}\b"))),
    }
    return found.withColumns(made)


def labelled_findings(copies: int = 16, seed: int = 17) -> list[tuple[str, int]]:
    """(text, label): texts with one candidate each, made from templates of secrets (1) and harmless strings (0)."""
    draw = random.Random(seed)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    hexa, digit = "0123456789abcdef", "0123456789"
    low = "abcdefghijklmnopqrstuvwxyz"
    mixed = low + low.upper() + digit
    word = lambda: "".join(draw.choice(["an", "er", "th", "on", "re", "lo", "in", "ed", "ver", "sch", "qui", "os", "ta", "ing", "ble", "tion"]) for _ in range(draw.randint(1, 3)))
    long_word = lambda: "".join(word() for _ in range(12))[: draw.randint(17, 40)]
    name = lambda: draw.choice(["token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "TOKEN", "apiKey"])
    quote = lambda s: f'"{s}"' if draw.random() < 0.6 else s
    sep = lambda: draw.choice([" = ", "=", ": ", ":"])
    rows = []
    for _ in range(copies):
        w = lambda: word() + " " + word()
        secret = [
            f"{w()} {name()}{sep()}{quote(pick(hexa, draw.choice([32, 40, 48, 64])))} {w()}",
            f"{w()} {name()}{sep()}{quote(pick(hexa, 40))} {w()}",
            f"{w()} {name().upper()}{sep()}{quote(pick(hexa, draw.choice([32, 40])).upper())} {w()}",
            f"{w()} {name()}{sep()}{quote(pick(mixed, draw.randint(20, 64)))} {w()}",
            f"{w()} {name()}{sep()}{quote(pick(mixed + '+/', draw.randint(24, 60)) + '==')} {w()}",
            f"{w()} AKIA{pick(low.upper() + digit, 16)} {w()}",
            f"{w()} key{sep()}{quote('ghp_' + pick(mixed, 36))}",
            f"Authorization: Bearer {pick(mixed + '_-', draw.randint(30, 60))}",
            f"{w()} sk_live_{pick(mixed, 24)} {w()}",
            f"{w()}\n-----BEGIN {draw.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{w()}",
        ]
        harmless = [
            f"{w()} {long_word()} {w()}",
            f"{w()} {long_word().capitalize()}, {w()}",
            f"{w()} {long_word().upper()}!! {w()}",
            f"{w()} {name()} {long_word()} {w()}",
            f"{w()} {draw.choice(['sha256', 'md5', 'commit', 'checksum', 'sha-1'])}{sep()}{quote(pick(hexa, draw.choice([32, 40, 64])))} {w()}",
            f"{w()} {pick(digit, draw.randint(16, 24))} {w()}",
            f"{w()} uuid {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)} {w()}",
            f"{w()} https://www.{word()}.com/{word()}/{long_word()}/{word()} {w()}",
            f"{w()} /usr/lib/{word()}/{word()}/{long_word()}.so {w()}",
            f"{w()} {'=' * draw.randint(16, 40)} {w()}",
            f"{w()} {'-' * draw.randint(16, 40)} {w()}",
            f"{w()} user_{word()}_config_{word()}_value {w()}",
            f"{w()} {name()} = {'x' * draw.randint(16, 30)} {w()}",
            f"{w()} {name()} = your_{word()}_token_{word()} {w()}",
            f"{w()} {'-'.join(word() for _ in range(8))} {w()}",
        ]
        rows += [(t, 1) for t in secret] + [(t, 0) for t in harmless]
    return rows


def _grow(x: np.ndarray, y: np.ndarray, depth: int, tries: int, rng) -> tuple:
    """A tree as nested (feature, threshold, left, right), or a leaf (share of secrets,)."""
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return (round(share, 6),)
    best = None
    for f in rng.choice(x.shape[1], tries, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(at):
            continue
        p, q = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (len(y) - at)
        impurity = at * p * (1 - p) + (len(y) - at) * q * (1 - q)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = float(impurity[k]), int(f), round(float((v[at[k] - 1] + v[at[k]]) / 2), 6)
    if best is None:
        return (round(share, 6),)
    _, f, cut = best
    left = x[:, f] <= cut
    if left.all() or not left.any():
        return (round(share, 6),)
    return f, cut, _grow(x[left], y[left], depth - 1, tries, rng), _grow(x[~left], y[~left], depth - 1, tries, rng)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 6, seed: int = 23) -> list[tuple]:
    """A forest: each tree on a resample, with a random third of the features at each split."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows], depth, max(1, x.shape[1] // 3), rng))
    return forest


def evaluate(tree: tuple, row: np.ndarray) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def expression(tree: tuple) -> Column:
    """The tree as CASE expressions over the features."""
    if len(tree) == 1:
        return F.lit(tree[0])
    return F.when(F.col(FEATURES[tree[0]]) <= tree[1], expression(tree[2])).otherwise(expression(tree[3]))


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None, **options) -> list[tuple]:
    """Fit a forest on labelled findings; each text's first candidate is the finding. The table is small (a few hundred rows)."""
    rows = [{"i": i, "t": t} for i, (t, _) in enumerate(findings or labelled_findings())]
    labels = [y for _, y in findings or labelled_findings()]
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i: int, t: string>>")).alias("r")).select("r.i", "r.t")
    made = features(candidates(table, "i", "t")).select("_id", "_start", *FEATURES).collect()
    first = {}
    for r in sorted(made, key=lambda r: (r._id, r._start)):
        first.setdefault(r._id, r)
    x = np.array([[r[f] for f in FEATURES] for r in first.values()])
    return fit(x, np.array([labels[i] for i in first]), **options)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: list[tuple] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, start, end (code points, end exclusive), candidate, score, is_secret.

    score is the mean of the trees' shares of secrets; is_secret says whether it is at least ``threshold``. Texts without
    candidates, empty and null ones have no rows; repeated rows have their findings each. A null id stays null. An empty
    table gives an empty result.
    """
    forest = forest or train(docs.sparkSession)
    scored = features(candidates(docs, id_col, text_col))
    total = expression(forest[0])
    for tree in forest[1:]:
        total = total + expression(tree)
    scored = scored.withColumn("score", F.round(total / len(forest), 6))
    return scored.select(F.col("_id").alias(id_col), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_cand").alias("candidate"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """The findings with a digest in the candidate's place."""
    return scan(docs, **options).withColumn("candidate", F.sha2("candidate", 256)).withColumnRenamed("candidate", "candidate_sha256")
