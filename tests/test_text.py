"""Text functions and passages against small models of their definitions and hand-computed cases."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import chunking
from corvane.functions import lexicon as lex
from corvane.functions import text as T
from corvane.operators import benchmarking as B


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def many(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="İhtiyati SATIŞ nasıl ve için") == ["htiyati", "satiş", "nasil"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abIıİé _.,9\n", max_size=30), min_size=40, max_size=60))
def test_tokens_model(spark, texts):
    want = [[w for w in re.findall(r"\w+", t.lower().replace("ı", "i")) if len(w) > 2 and w not in lex.STOP_WORDS] for t in texts]
    assert many(spark, texts, T.tokens(F.col("t"))) == want


def model_chunks(text, most, overlap, least):
    """Passages by definition: pieces are paragraphs, or packed sentences of long ones; a full passage's end opens the next."""
    pieces = []
    for p in (x.strip() for x in re.split(r"\n\s*\n+", text)):
        if p and len(p) <= most:
            pieces.append(p)
        elif p:
            line = []
            for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", p)):
                if s and line and len(" ".join([*line, s])) > most:
                    pieces.append(" ".join(line))
                    line = []
                line += [s] if s else []
            pieces += [" ".join(line)] if line else []
    done, current = [], None
    for p in pieces:
        if current is not None and len(current) + 2 + len(p) > most:
            done.append(current)
            current = (current[-overlap:] + "\n\n" + p).strip() if len(current) > overlap else p
        else:
            current = p if current is None else f"{current}\n\n{p}"
    return [c for c in [*done, *([current] if current else [])] if len(c) >= least]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["ab. ", "cd ef! ", "long long word", "\n\n", "\n \n", " ", "x?", "é. "]), max_size=30).map("".join), min_size=30, max_size=50))
def test_chunks_model(spark, texts):
    assert many(spark, texts, chunking.chunks(F.col("t"), 30, 6, 5)) == [model_chunks(t, 30, 6, 5) for t in texts]


def test_chunk_cases(spark):
    sample = "\n\n".join(["A" * 300, "B" * 800, "C" * 400, "D" * 600])
    got = many(spark, [sample, "A" * 100 + "\n\n" + "B" * 1150, "s" * 3000, ""], chunking.chunks(F.col("t"), 1000, 150, 200))
    assert [len(c) for c in got[0]] == [300, 952, 552, 752]
    assert [len(c) for c in got[2]] == [3000] and got[3] == []
    assert one(spark, chunking.chunks(F.col("t")), t="A" * 100 + "\n\n" + "B" * 1150) == ["B" * 1150]
    rows = chunking.chunk_records(spark.createDataFrame([(1, sample), (2, None), (3, "short")], "k int, text string"), most=1000).collect()
    assert [(r.k, r.chunk_idx, r.n_chunks) for r in rows] == [(1, i, 4) for i in range(4)]


def test_bad_queries(spark):
    texts = ["y a r g i t a y", "madde 12", "beraat", "E. 123 karar", "2015/12", "Türk Milleti Adına", "ceza mahkemesi", "kira tahliye davası"]
    assert many(spark, texts, B.bad_query(F.col("t"))) == [True] * 7 + [False]


def test_extraction(spark):
    text = "T.C. 3. Hukuk Dairesi\nKONU : Kira alacağı \nx 6098 sayılı Türk Borçlar Kanunu m. 12 ve madde 3, madde 3"
    assert one(spark, T.chamber(F.col("t"), F.lit("ygty1")), t=text) == "3. Hukuk Dairesi"
    assert one(spark, T.chamber(F.col("t"), F.lit("ygty1")), t="x") == "Yargıtay (Hukuk Daireleri)"
    assert one(spark, T.chamber(F.col("t"), F.lit(None).cast("string")), t="x") == "Bilinmeyen"
    assert one(spark, T.subject(F.col("t")), t=text) == "Kira alacağı"
    assert one(spark, T.statutes(F.col("t")), t=text) == ["6098 sayılı Türk Borçlar Kanunu m. 12", "madde 3"]
    assert one(spark, T.title(F.lit("K"), F.lit(None).cast("string"), F.lit("5")), t="") == "K - E. None, K. 5"
    assert one(spark, T.clean_markdown(F.col("t")), t=" **a** *b*\n\n\n\nc \t d ") == "a b\n\nc d"
    html = "<html><head><title> T </title><style>p{}</style><script>var a='</p>';</script></head><body><!-- no --><p>a &amp; b</p><ul><li>S. 12</li><li>no</li></ul></body></html>"
    assert one(spark, T.clean_html(F.col("t")), t=html) == "T\na & b\nS. 12\nno"
    assert one(spark, T.html_items(F.col("t")), t=html) == ["S. 12"] and one(spark, T.html_title(F.col("t")), t=html) == "T"
    assert one(spark, T.from_last(F.col("t"), ["ZZ", "KARAR:"], 9), t="KARAR: 1 KARAR: 23456") == "KARAR: 23"
    assert one(spark, T.after(F.col("t"), "M"), t="aMbMc") == "bMc"


def test_snippets_and_norms(spark):
    long = "x" * 150 + " kira " + "y" * 900
    assert one(spark, T.snippet(F.col("t"), F.array(F.lit("kira")), 500), t=long) == "..." + long[51:551] + "..."
    assert one(spark, T.snippet(F.col("t"), F.array(F.lit("none")), 5), t="abcdefg") == "abcde..."
    assert one(spark, T.marks_to_html(T.escape_html(T.marked_snippet(F.lit("Kira bedeli"), F.col("t")))), t="a < kira b") == "a &lt; <mark>kira</mark> b"
    assert one(spark, T.norm_query(F.col("t")), t="  İÇTİHAT  Kâğıdı ı") == "içtihat kağidi i"
    assert one(spark, T.norm_keyword(F.col("t")), t="A,b (c)-d") == "a b c d"
    assert one(spark, T.summary(F.col("t"), 2, 3), t="Ab. Abcd. Abcde! Abcdef?") == "Abcd. Abcde!"
    assert one(spark, T.citations(F.col("t")), t="[Karar 1] [Karar 7] [Karar 1]") == [1, 7]
    stars = spark.createDataFrame([(p,) for p in (0.0005, 0.005, 0.03, 0.2, None)], "p double").select(T.stars(F.col("p")).alias("s")).collect()
    assert [r.s for r in stars] == ["***", "**", "*", "ns", ""]


def test_table_function(spark):
    from corvane.functions import udtf

    udtf.register(spark)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").createOrReplaceTempView("docs_for_udtf")
    got = spark.sql("SELECT d.doc_id, c.chunk_idx, c.n_chunks, c.text FROM docs_for_udtf d, LATERAL chunk(d.text) c").collect()
    native = chunking.chunk_records(spark.table("docs_for_udtf").select("doc_id", "text")).select("doc_id", "chunk_idx", "n_chunks", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, native))
