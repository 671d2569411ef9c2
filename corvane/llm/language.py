"""Language identification by Bayesian fusion of evidence.

Each row has up to four kinds of evidence, taken as independent given the language:

* its text: a naive Bayes likelihood over hashed character trigrams of words, whose sum over the text is
  tempered, as neighbouring trigrams aren't independent;
* the language that its markup declares, through a confusion table P(declared | language);
* the suffix of its address and its host, as a prior: the host's language shares shrunk towards its suffix's, and those towards the
  whole table's. A row's own text is left out of these counts.

The tables are grouped sums of text posteriors over all rows. Only the trigram model is fitted on a bounded
sample: ``train_rows`` labelled rows a language, the ones with the smallest hash of their id; a third of the ids is held out of it.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import clean_html
from corvane.functions.words import cut

from .shared import Scratch, extend, passage, smallest_hashes
from .url_filter import host_of

BUCKETS = 1 << 16
#: Evidence tables of up to so many values are broadcast.
SMALL, SALTS = 100_000, 16
_WORD = re.compile(r"[^\W\d_]+")


@cache
def _letters() -> np.ndarray:
    """Whether each code point belongs to words, as ``_WORD`` has it."""
    found = np.zeros(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(len(found))))):
        found[m.start() : m.end()] = True
    return found


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What ``_WORD`` finds in all texts, one after the other and encoded by distinct words, and how many words each text has."""
    return cut(texts, _letters())


def hashed_trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased words between spaces, one word after the other, and how many each word has.

    The hash is a polynomial, alike in each process. A trigram stands around each letter.
    """
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py()
    code = np.frombuffer(f" {joined} ".lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    around = ((code[:-2] * 961 + code[1:-1]) * 961 + code[2:])[code[1:-1] != 32]
    hashed = (around * 40503 % 2147483647 % BUCKETS).astype(np.int64)
    return hashed, np.diff(np.flatnonzero(code == 32)) - 1 if len(words) else np.zeros(0, np.int64)


def train(examples: list[tuple[str, str]], languages: list[str], smoothing: float = 0.05) -> np.ndarray:
    """Log probabilities (bucket, language) of trigrams from (text, language) pairs."""
    counts = np.full((BUCKETS, len(languages)), smoothing)
    for text, lang in examples:
        words, _ = cut_words(pa.array([text]))
        hits, n = hashed_trigrams(words.dictionary)
        often = np.repeat(np.bincount(words.indices.to_numpy(), minlength=len(n)), n)
        counts[:, languages.index(lang)] += np.bincount(hits, often, BUCKETS)
    return np.log(counts / counts.sum(0)).astype(np.float32)


class TextScorer:
    """Log likelihoods of texts; each distinct word of a batch is scored once."""

    #: Longer words are summed one by one.
    LONG = 64

    def __init__(self, model: np.ndarray, tempering: float):
        self.model, self.tempering = model, tempering

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Log likelihoods (word, language), each summed in the order of the word's letters."""
        hits, n = hashed_trigrams(words)
        first, order = np.cumsum(n) - n, np.argsort(-n, kind="stable")
        out = np.zeros((len(n), self.model.shape[1]), np.float32)
        long = np.searchsorted(-n[order], -self.LONG)
        for i in order[:long]:
            out[i] = self.model[hits[first[i] : first[i] + n[i]]].sum(0)
        order = order[long:]
        total, at, size = out[order], first[order], -n[order]
        for k in range(-size[0] if len(size) else 0):  # the k-th letters of all words that have so many
            many = np.searchsorted(size, -k)
            total[:many] += self.model[hits[at[:many] + k]]
        out[order] = total
        return out

    def many(self, texts: pa.Array) -> list[list[float]]:
        """Tempered log likelihoods by language of each text: the sum to the power ``tempering`` of the word count over it."""
        words, counts = cut_words(texts)
        table, at = self.of_words(words.dictionary), words.indices.to_numpy()
        spoke = counts > 0
        total = np.zeros((len(counts), table.shape[1]))
        if len(at):
            first, n = (np.cumsum(counts) - counts)[spoke], counts[spoke]
            for i in range(table.shape[1]):
                total[spoke, i] = np.add.reduceat(table[:, i].astype(np.float64)[at], first)
            total -= total.max(1, keepdims=True)
            total[spoke] = total[spoke] / n[:, None] * np.array([x**self.tempering for x in n.tolist()])[:, None]
        return total.tolist()

    def __call__(self, text: str) -> list[float]:
        return self.many(pa.array([text]))[0]


#: A text of the training sample is at most this long; of longer ones a passage is taken.
SAMPLE_CHARS = 200_000


def sample(labelled: DataFrame, languages: list[str], train_rows: int) -> list[tuple[str, str]]:
    """(text, language) of at most ``train_rows`` rows a language from columns _id, _text and _label, by the hash of the id.

    Ids are chosen without their texts, then the texts of the chosen are read; of texts that share an id and a label, the
    first. Rows without an id or a text are left out.
    """
    ids = labelled.select(F.col("_id").alias("_i"), "_label").filter(F.col("_label").isin(languages))
    # train_rows ids a language at most
    chosen = F.broadcast(smallest_hashes(ids, "_label", train_rows).select(F.col("_i").alias("_id"), "_label"))
    rows = labelled.filter(F.length("_text") > 0).join(chosen, ["_id", "_label"]).groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    return sorted((r._text, r._label) for r in rows.select(passage("_text", "_id", SAMPLE_CHARS).alias("_text"), "_label").collect())


def is_held_out(id_col: Column) -> Column:
    """Whether an id's row is kept from training, so that accuracy can be measured on it: crc32 of the id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(rows: DataFrame, id_col: str, text_col: str, label: str | None, languages: tuple[str, ...] = ("de", "en", "es", "fr"), train_rows: int = 300) -> np.ndarray:
    """What ``train`` gives for the sample of rows that ``label`` marks and that aren't held out."""
    languages = sorted(languages)
    marked = F.lit(None).cast("string") if label is None else rows[label].cast("string")
    rows = rows.select(rows[id_col].alias("_id"), F.coalesce(rows[text_col], F.lit("")).alias("_text"), marked.alias("_label")).filter(~is_held_out(F.col("_id")))
    return train(sample(rows, languages, train_rows), languages)


def markup_language(html: Column) -> Column:
    """The primary language subtag that markup declares, in lower case: of the html tag, else of a content-language meta tag; else null."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    root = F.regexp_extract(plain, r"(?is)<html\s(?:[^>]*?[\s\"'])?(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,8})", 1)
    meta = F.regexp_extract(plain, r"(?is)<meta\s[^>]*?http-equiv\s*=\s*[\"']?content-language[^>]*>", 0)
    content = F.regexp_extract(meta, r"(?is)\scontent\s*=\s*[\"']?\s*([a-z]{2,8})", 1)
    return F.lower(F.coalesce(F.nullif(root, F.lit("")), F.nullif(content, F.lit(""))))


def address_host(url: Column) -> Column:
    """The host of an address in lower case, without user, port and closing dots; null where there is none."""
    return F.nullif(F.regexp_replace(host_of(url), r"^.*@|:\d*$|\.+(?=:\d*$|$)", ""), F.lit(""))


def address_suffix(url: Column) -> Column:
    """The last label of an address's host; null for numbers and for hosts of one label."""
    return F.nullif(F.regexp_extract(address_host(url), r"\.([^.\d\[\]:][^.\[\]:]*)$", 1), F.lit(""))


def identify_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``identify`` on raw pages: the markup's text, and as evidence its declared language, the address's suffix and its host."""
    html, url = pages[html_col], pages[url_col]
    rows = pages.select(pages[id_col], clean_html(html).alias("_page"), markup_language(html).alias("_markup"), address_suffix(url).alias("_top"), address_host(url).alias("_site"))
    return identify(rows, id_col, "_page", declared="_markup", suffix="_top", host="_site", **options)


def identify(
    rows: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: str | None = None,
    suffix: str | None = None,
    host: str | None = None,
    label: str | None = None,
    model: np.ndarray | None = None,
    languages: tuple[str, ...] = ("de", "en", "es", "fr"),
    train_rows: int = 300,
    tempering: float = 0.5,
    shrinkage: float = 20.0,
    min_confidence: float = 0.6,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row: id, text_lang, lang_id, confidence, kept, and the columns of ``keep``.

    ``declared``, ``suffix`` and ``host`` name columns of evidence; without one, or where it is null, that evidence is
    neutral. A declared value needs not be a language: what it says is learnt from the rows that have it. ``model`` is
    what ``train`` gives; without it, one is fitted on rows that ``label`` marks. A text without words
    gives no evidence; its text_lang is null, and its lang_id comes from the rest. kept is true where the
    text has words and confidence, the posterior of lang_id, is at least ``min_confidence``; ties of
    languages fall to the first by name. Repeated rows are rows of their own. An empty table gives an empty result.
    Other columns are not read but for those of ``keep``, whose names may be any that the result's own columns don't have.
    """
    languages = sorted(languages)
    k = len(languages)
    text = F.coalesce(rows[text_col], F.lit(""))
    value = lambda c: rows[c].cast("string") if c else F.lit(None).cast("string")
    base = rows.select(rows[id_col].alias("_id"), text.alias("_text"), value(declared).alias("_declared"), value(suffix).alias("_suffix"), value(host).alias("_host"), *[rows[c].alias(f"_keep_{c}") for c in keep])
    if model is None:
        model = fit(rows, id_col, text_col, label, languages, train_rows)

    def start():
        score = TextScorer(model, tempering)
        return lambda batch: [score.many(batch["_text"])]

    scored = extend(base, "_ll array<double>", start, slice_bytes=4 << 20)  # arrays made meanwhile are some ten times as large
    exps = F.transform("_ll", lambda x: F.exp(x - F.array_max("_ll")))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    scratch = Scratch(rows.sparkSession, "language")
    scored = scratch.table("scored", scored.withColumn("_p", F.transform(exps, lambda x: x / total)))
    sums = [F.sum(F.col("_p")[i]).alias(f"_s{i}") for i in range(k)]
    whole = scored.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"_s{i}") for i, s in enumerate(sums)]).first()
    n_all = max(sum(whole), 1e-9)
    prior = [(whole[i] + 1) / (n_all + k) for i in range(k)]
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    joined = scored
    for c in ("_declared", "_suffix", "_host"):
        table = scratch.table(c, scored.filter(F.col(c).isNotNull()).groupBy(c).agg(F.array(*sums).alias(f"{c}_sums")))
        if table.count() <= SMALL:  # some ten megabytes are broadcast, so that the rows stay where they are
            joined = joined.join(F.broadcast(table), c, "left")
        else:  # rows without a value stay out of the join, and a frequent value's rows are dealt over ``SALTS`` tasks
            salted = joined.filter(F.col(c).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("_id", "_ll"), F.lit(SALTS)))
            copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            met = salted.join(copies, [c, "_salt"], "left").drop("_salt")
            joined = met.unionByName(joined.filter(F.col(c).isNull()), allowMissingColumns=True)
    zeros = array([0] * k)
    own = lambda c: F.coalesce(F.zip_with(c, "_p", lambda s, p: F.greatest(s - p, F.lit(0.0))), zeros)
    size = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("_sx", own("_suffix_sums")).withColumn("_hx", own("_host_sums")).withColumn("_dx", own("_declared_sums"))
    mix = lambda xs, ps: F.zip_with(xs, ps, lambda x, p: (x + shrinkage * p) / (size(xs) + shrinkage))
    joined = joined.withColumn("_suffix_prior", mix(F.col("_sx"), array(prior)))
    joined = joined.withColumn("_prior", mix(F.col("_hx"), F.col("_suffix_prior")))
    # P(declared | language) is in proportion to the declared value's sum for a language over the language's.
    said = F.when(F.col("_declared").isNull(), array([1] * k)).otherwise(F.zip_with("_dx", array(prior), lambda x, p: (x + 1.0) / (p * n_all + k)))
    joined = joined.withColumn("_post", F.zip_with(F.zip_with("_ll", said, lambda a, b: a + F.log(b)), "_prior", lambda a, b: a + F.log(b)))
    top = F.array_max("_post")
    names = F.array(*[F.lit(x) for x in languages])
    joined = joined.withColumn("_at", F.array_position("_post", top)).withColumn("_conf", 1.0 / size(F.transform("_post", lambda x: F.exp(x - top))))
    spoke = F.array_max("_ll") > F.array_min("_ll")
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(spoke, F.element_at(names, F.array_position("_ll", F.array_max("_ll")).cast("int"))).alias("text_lang"),
        F.element_at(names, F.col("_at").cast("int")).alias("lang_id"),
        F.col("_conf").alias("confidence"),
        (spoke & (F.col("_conf") >= min_confidence)).alias("kept"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
