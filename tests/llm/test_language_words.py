"""Words cut in bytes and scored together, against a regular expression and a loop over trigrams."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import language

ODD = [
    "", None, " \n", "12 34_5", "ΑΣ ΣΑΣ ΟΔΟΣ.", "İstanbul ß ǅ", f"{'a' * 70} {'b' * 64} {'c' * 65}É{'d' * 300}", "日本語。テキスト", "𐐀𐐁 x²y", "é́a", "\0a\0b", "one", "two", "'tis", "x" * 63,
]


def trigrams(word):
    s = f" {word.lower()} "
    return [((ord(a) * 961 + ord(b)) * 961 + ord(c)) * 40503 % 2147483647 % language.BUCKETS for a, b, c in zip(s, s[1:], s[2:], strict=False)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = lambda: "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(80)))
    return ODD + [made() for _ in range(300)]


def test_words_are_cut_in_bytes(texts, monkeypatch):
    """The words of the regular expression for every character, without running it on the texts."""
    want = [language._WORD.findall(t or "") for t in texts]
    every = "".join(f"{chr(i)} " for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    letters = language._WORD.findall(every)
    language._letters()  # made of the expression once in a process
    monkeypatch.setattr(language, "_WORD", None)
    for kind in (pa.string(), pa.large_string()):
        words, counts = language.cut_words(pa.array([None, *texts], kind).slice(1))  # arrays may begin anywhere in their buffers
        assert counts.tolist() == [len(w) for w in want] and words.cast(pa.large_string()).to_pylist() == [w for ws in want for w in ws]
    assert language.cut_words(pa.array([every]))[0].to_pylist() == letters


def test_scores_are_those_of_a_loop(texts):
    """A batch of texts has the very numbers of each text's words and trigrams summed one by one."""
    labelled = [(t, "ab"[i % 2]) for i, t in enumerate(texts) if t]
    model = language.train(labelled, ["a", "b"])
    counts = np.full((language.BUCKETS, 2), 0.05)
    for text, lang in labelled:
        for hit in [h for w in language._WORD.findall(text) for h in trigrams(w)]:
            counts[hit, "ab".index(lang)] += 1
    assert (model == np.log(counts / counts.sum(0)).astype(np.float32)).all()
    want = []
    for text in texts:
        rows = [model[trigrams(w)].sum(0) for w in language._WORD.findall(text or "")]
        total = np.sum(rows, axis=0, dtype=np.float64) if rows else np.zeros(2)
        want.append(((total - total.max()) / max(len(rows), 1) * len(rows) ** 0.5).tolist())
    score = language.TextScorer(model, 0.5)
    assert score.many(pa.array(texts)) == want
    assert [score.many(pa.array(texts).slice(i, 7)) for i in range(0, len(texts), 7)] == [want[i : i + 7] for i in range(0, len(want), 7)]
    assert score.many(pa.array([None, ""])) == [[0.0, 0.0]] * 2 and score("two") == want[texts.index("two")]
