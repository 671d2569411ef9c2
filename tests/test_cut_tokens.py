"""Tokens cut in the Arrow pass are those of the column expression."""

import random

from pyspark.sql import functions as F

from corvane.functions import lexicon as lex
from corvane.functions import text as T
from corvane.operators import lexical

ODD = ["", None, " \n", "ab abc abcd a_1 12 123", "DIŞ kapı İSTANBUL ΟΔΟΣ ıııı ǅǅǅ", "日本 日本語。テキスト", "𐐀𐐀𐐀 x²³ é́a", "\0abc\0", " ".join(lex.STOP_WORDS[:20]) + " Hukuk", "the THE tapu" * 3]


def test_tokens_cut_in_the_arrow_pass(spark):
    """Lengths, terms and frequencies for every character are those of ``T.tokens``, whose expression isn't run on the texts."""
    rng = random.Random(4)
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ODD + ["".join(rng.choices(points[:500] + points[::97], k=300)) for _ in range(40)]
    texts += [" ".join(c * 3 for c in points[at : at + 5000]) for at in range(0, len(points), 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "did long, text string")
    assert "regexp_extract_all" not in lexical.to_count(docs)._jdf.queryExecution().optimizedPlan().toString()
    got, want = (lexical.counted(lexical.to_count(docs, f)).collect() for f in (T.tokens, lambda c: T.tokens(c)))
    terms = lambda rows: {r.did: (r.dl, sorted(map(tuple, r.terms))) for r in rows if r.dl is not None}

    def sums(rows):
        out = {}
        for r in (r for r in rows if r.tok is not None):
            out[r.tok] = out.get(r.tok, 0) + r.df
        return out

    assert terms(got) == terms(want) and len(terms(got)) == len(texts) and sums(got) == sums(want)
    some = docs.filter(F.col("did") < len(ODD)).select("did", T.tokens(F.col("text")).alias("t")).collect()
    assert all(terms(got)[r.did][0] == len(r.t) for r in some) and any(r.t for r in some)
