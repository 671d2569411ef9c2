"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding (words of at least four training texts; others share one) beside the mean
embedding of its hashed character trigrams. Two gated recurrent layers read a window of words in both directions,
attention pools their states, and a logistic unit scores the window. A text is cut into windows of ``WINDOW`` words
that overlap by half, down to its very end, and its score is that of its highest window.

Training has labels of whole texts only: of a toxic text the highest windows learn, of a clean one all windows and the
highest ones most. Gradients are written out by hand; Adam takes ``steps`` steps on balanced batches of texts. The
sample it learns from is bounded by ``train_rows`` texts of each label and ``train_chars`` characters in all.

In scoring, what the layers take in from a word is computed once for a distinct word and kept in a bounded table.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import extend, passage, smallest_hashes

WINDOW, STRIDE = 48, 24
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def trigrams(word: str, buckets: int) -> list[int]:
    """Hashed character trigrams of a word between marks; alike in each process."""
    s = f"<{word}>"
    return [((ord(a) * 31 + ord(b)) * 1009 + ord(c)) * 40503 % 2147483647 % buckets for a, b, c in zip(s, s[1:], s[2:], strict=False)]


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows [start, end) over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    return [*((s, s + WINDOW) for s in range(0, n - WINDOW, STRIDE)), (n - WINDOW, n)]


class Net:
    """Parameters and both passes of the network."""

    def __init__(self, vocabulary: list[str], hidden: int = 10, embed: int = 10, buckets: int = 4096, seed: int = 5):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0 stands for other words
        self.hidden, self.embed, self.buckets = hidden, embed, buckets
        self.p = {
            "word": normal(len(vocabulary) + 1, embed, scale=0.05),
            "char": normal(buckets, embed, scale=0.3),
            "in": normal(2, 2 * embed, 3 * hidden, scale=(2 * embed) ** -0.5),
            "bias": np.zeros((2, 1, 3 * hidden), np.float32),
            "turn": normal(2, hidden, 3 * hidden, scale=hidden**-0.5),
            "look": normal(2 * hidden, hidden, scale=(2 * hidden) ** -0.5),
            "ask": normal(hidden, scale=hidden**-0.5),
            "out": normal(2 * hidden, scale=(2 * hidden) ** -0.5),
            "rest": np.zeros(1, np.float32),
        }

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """What both layers take in from each word (2, word, 3 * hidden), and what the way back needs."""
        ids = np.array([self.ids.get(w, 0) for w in words], np.int64)
        grams = [trigrams(w, self.buckets) for w in words]
        count = np.array([len(g) for g in grams], np.int64)
        flat = np.array([x for g in grams for x in g], np.int64)
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(count) - count) / count[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][ids], chars], 1)
        return x @ self.p["in"] + self.p["bias"], (ids, flat, count, x)

    def forward(self, taken: np.ndarray, index: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows. ``index`` (window, place) numbers words of ``taken``; places from the length on don't count."""
        h, (n, length) = self.hidden, index.shape
        state = np.zeros((2, n, h), np.float32)
        states = np.zeros((length, 2, n, h), np.float32)
        trail = []
        back_to_front = index[:, ::-1]  # short windows are padded at their end, so the second layer starts in the padding
        ragged = bool((lengths < length).any())
        for t in range(length):
            x = np.stack([taken[0][index[:, t]], taken[1][back_to_front[:, t]]])
            turned = state @ self.p["turn"]
            gates = np.tanh(0.5 * (x[:, :, : 2 * h] + turned[:, :, : 2 * h])) * np.float32(0.5) + np.float32(0.5)
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + r * turned[:, :, 2 * h :])
            after = new + z * (state - new)
            if ragged:
                on = np.stack([t < lengths, length - 1 - t < lengths])[:, :, None]
                after = np.where(on, after, state)
            if keep:
                trail.append((state, turned[:, :, 2 * h :], z, r, new))
            state = after
            states[t] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], 2)  # (place, window, 2 * hidden)
        seen = np.tanh(both @ self.p["look"])
        heed = seen @ self.p["ask"]
        if ragged:
            heed = np.where(np.arange(length)[:, None] < lengths, heed, np.float32(-1e9))
        heed = np.exp(heed - heed.max(0))
        heed /= heed.sum(0)
        pooled = np.einsum("tn,tnh->nh", heed, both)
        logits = pooled @ self.p["out"] + self.p["rest"][0]
        return (logits, (trail, both, seen, heed, pooled, index, back_to_front, lengths)) if keep else logits

    def backward(self, slope: np.ndarray, kept: tuple, taken_from: tuple, shape: tuple) -> dict[str, np.ndarray]:
        """Gradients for ``slope``, the derivative by the logits; ``shape`` is that of what was taken in."""
        trail, both, seen, heed, pooled, index, back_to_front, lengths = kept
        ids, flat, count, x = taken_from
        h, length, p = self.hidden, len(trail), self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["rest"] = slope @ pooled, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * p["out"]
        d_both = heed[:, :, None] * d_pooled
        d_heed = np.einsum("nh,tnh->tn", d_pooled, both)
        d_heed = heed * (d_heed - (heed * d_heed).sum(0))
        g["ask"] = np.einsum("tn,tnh->h", d_heed, seen)
        d_seen = d_heed[:, :, None] * p["ask"] * (1 - seen**2)
        g["look"] = np.einsum("tnh,tnk->hk", both, d_seen)
        d_both += d_seen @ p["look"].T
        d_taken = np.zeros(shape, np.float32)
        d_state = np.zeros((2, len(slope), h), np.float32)
        for t in range(length - 1, -1, -1):
            state, turned_new, z, r, new = trail[t]
            d_state = d_state + np.stack([d_both[t, :, :h], d_both[length - 1 - t, :, h:]])
            on = np.stack([t < lengths, length - 1 - t < lengths])[:, :, None]
            d_after, passed = np.where(on, d_state, 0), np.where(on, 0, d_state)
            d_new = d_after * (1 - z) * (1 - new**2)
            d_z = d_after * (state - new) * z * (1 - z)
            d_r = d_new * turned_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], 2)
            d_turned = np.concatenate([d_z, d_r, d_new * r], 2)
            g["turn"] += state.transpose(0, 2, 1) @ d_turned
            d_state = passed + d_after * z + d_turned @ p["turn"].transpose(0, 2, 1)
            np.add.at(d_taken[0], index[:, t], d_x[0])
            np.add.at(d_taken[1], back_to_front[:, t], d_x[1])
        g["bias"] = d_taken.sum(1, keepdims=True)
        g["in"] = x.T @ d_taken
        d_in = (d_taken @ p["in"].transpose(0, 2, 1)).sum(0)
        np.add.at(g["word"], ids, d_in[:, : self.embed])
        np.add.at(g["char"], flat, np.repeat(d_in[:, self.embed :] / count[:, None], count, 0))
        return g


def train(texts: list[str], labels: list[int], steps: int = 300, texts_a_step: int = 24, windows_a_text: int = 24, rate: float = 0.01, least_texts: int = 4, seed: int = 9) -> Net:
    """Fit a network. Without texts of both labels, it gives what one label is worth: a constant score."""
    split = [words_of(t) for t in texts]
    spread: dict[str, int] = {}
    for ws in split:
        for w in set(ws):
            spread[w] = spread.get(w, 0) + 1
    net = Net(sorted(w for w, c in spread.items() if c >= least_texts))
    groups = [[k for k, y in enumerate(labels) if y == v and split[k]] for v in (0, 1)]
    if not all(groups):
        net.p["out"][:] = 0
        net.p["rest"][0] = 4.0 if groups[1] else -4.0
        return net
    draw = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        chosen = [int(k) for g in groups for k in draw.choice(g, texts_a_step // 2)]
        cuts = []
        for row, k in enumerate(chosen):
            ws = windows(len(split[k]))
            picked = draw.choice(len(ws), windows_a_text, replace=False) if len(ws) > windows_a_text else range(len(ws))
            cuts += [(row, k, *ws[i]) for i in picked]
        distinct: dict[str, int] = {}
        index = np.zeros((len(cuts), WINDOW), np.int64)
        for i, (_, k, s, e) in enumerate(cuts):
            index[i, : e - s] = [distinct.setdefault(w, len(distinct)) for w in split[k][s:e]]
        lengths = np.array([e - s for *_, s, e in cuts])
        taken, came = net.inputs(list(distinct))
        logits, kept = net.forward(taken, index, lengths, keep=True)
        row = np.array([r for r, *_ in cuts])
        y = np.array([labels[k] for k in chosen])[row]
        lift = np.exp(2 * (logits - logits.max()))
        share = lift / np.bincount(row, lift, len(chosen))[row]
        even = 1 / np.bincount(row, minlength=len(chosen))[row]
        weight = np.where(y == 1, share, 0.5 * share + 0.5 * even)
        slope = (weight * (1 / (1 + np.exp(-logits)) - y) / len(chosen)).astype(np.float32)
        for k, g in net.backward(slope, kept, came, taken.shape).items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= rate * (1.05 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


class Scorer:
    """Scores of texts, batch by batch."""

    def __init__(self, net: Net, table_words: int = 100_000, windows_a_batch: int = 1024):
        self.net, self.most, self.batch = net, table_words, windows_a_batch
        self.rows: dict[str, int] = {}
        self.taken = np.zeros((2, 4096, 3 * net.hidden), np.float32)

    def add(self, words: set[str]) -> None:
        """Table rows for words that have none."""
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        at = len(self.rows)
        while at + len(new) > self.taken.shape[1]:
            self.taken = np.concatenate([self.taken, np.zeros_like(self.taken)], 1)
        self.taken[:, at : at + len(new)] = self.net.inputs(new)[0]
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def __call__(self, texts: list[str]) -> list[float]:
        """The highest window's score of each text."""
        best = np.full(len(texts), -np.inf)
        pending: list[tuple[int, np.ndarray]] = []
        seen: dict[bytes, int] = {}
        copies: list[tuple[int, int]] = []
        for k, text in enumerate(texts):
            if text and (first := seen.setdefault(text, k)) != k:
                copies.append((k, first))
                continue
            words = words_of(text)
            if len(self.rows) > self.most:
                self.flush(pending, best)
                self.rows.clear()
            for part in range(0, max(1, len(words)), 50_000):
                self.add(set(words[part : part + 50_000]))
            at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            for s, e in windows(len(words)):
                pending.append((k, at[s:e]))
                if len(pending) >= self.batch:
                    self.flush(pending, best)
        self.flush(pending, best)
        for k, first in copies:
            best[k] = best[first]
        return (1 / (1 + np.exp(-best))).tolist()

    def flush(self, pending: list[tuple[int, np.ndarray]], best: np.ndarray) -> None:
        """Score the pending windows, whole ones and short ones apart."""
        for whole in (True, False):
            part = [x for x in pending if (len(x[1]) == WINDOW) == whole]
            if not part:
                continue
            lengths = np.array([len(x) for _, x in part])
            index = np.zeros((len(part), max(1, int(lengths.max()))), np.int64)
            for i, (_, x) in enumerate(part):
                index[i, : len(x)] = x
            logits = self.net.forward(self.taken, index, lengths).astype(np.float64)
            logits = np.where(lengths > 0, logits, -6.0)  # nothing said
            np.maximum.at(best, [k for k, _ in part], logits)
        pending.clear()


def is_held_out(id_col) -> object:
    """Whether the id's row is kept from training: crc32 of the id as text modulo 3 is 1. A null id is kept from it too."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, train_chars: int) -> tuple[list[str], list[int]]:
    """Labelled training texts: the smallest hashes of the ids, at most ``train_rows`` of each label.

    Ids are ranked without their texts. Texts are taken in that order while they fit in ``train_chars`` in all, half for
    each label. Of a text longer than a sixteenth of its label's half, a passage of that size is taken, at a place drawn by
    the hash of its id, so that a label's half holds sixteen texts at least. The chosen ids are at most twice ``train_rows``, so they are broadcast.
    """
    usable = labels.select(labels[id_col].alias("_i"), labels[label_col].cast("int").alias("_y")).filter(~is_held_out(F.col("_i")) & F.col("_y").isin(0, 1))
    chosen = F.broadcast(smallest_hashes(usable, "_y", train_rows))
    texts = docs.select(docs[id_col].alias("_i"), docs[text_col].alias("_t")).filter("_t IS NOT NULL").join(chosen, "_i")
    texts = texts.withColumn("_t", passage("_t", "_i", train_chars // 32))
    whole = Window.partitionBy("_y").orderBy("_r", "_t").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(F.length("_t").cast("long")).over(whole) <= train_chars // 2
    rows = texts.withColumn("_fits", fits).filter("_fits").select("_r", "_y", "_t").collect()
    rows.sort(key=lambda r: (r._y, r._r, r._t))
    return [r._t for r in rows], [r._y for r in rows]


def score_documents(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    train_rows: int = 1500,
    train_chars: int = 12_000_000,
    steps: int = 300,
    net: Net | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, and the columns of ``keep``.

    score is the network's, from the text alone; predicted is 1 where it is at least ``threshold``. A text
    without words, a null one too, scores 0.0025. held_out tells rows that training never sees; a null id
    is one of them. Labels other than 0 and 1 and labels without a text are left out. ``net`` replaces training.
    Repeated rows are rows of their own. An empty table gives an empty result. Other columns are not read but for those of
    ``keep``, whose names may be any that the result's own columns don't have.
    """
    if net is None:
        net = train(*sample(docs, labels, id_col, text_col, label_col, train_rows, train_chars), steps=steps)
    df = docs.select(docs[id_col].alias("_id"), is_held_out(docs[id_col]).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("_text"), *[docs[c].alias(f"_keep_{c}") for c in keep])

    def start():
        scorer = Scorer(net)
        return lambda batch: [scorer(batch["_text"].to_pylist())]

    scored = extend(df, "score double", start)
    return scored.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
