"""Answers from ranked results: abstention, confidence, cards, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import lexicon as lex
from corvane.functions import text as T

from .fusion import first_of_signature


def _top(results: DataFrame, score: str) -> DataFrame:
    return results.groupBy("qid").agg(F.count("*").alias("_n"), F.min_by(score, "pos").alias("_top"))


def abstain_fused(queries: DataFrame, results: DataFrame, least: float = 0.020, min_docs: int = 1) -> DataFrame:
    """(qid, abstain, reason) by the best fused score. A threshold of 0.02 asks for a result of both lists."""
    n, top = F.coalesce("_n", F.lit(0)), F.coalesce("_top", F.lit(0.0))
    reason = F.when(n < min_docs, lex.TOO_FEW).when(top < least, lex.TOO_WEAK)
    joined = queries.select("qid").join(_top(results, "score"), "qid", "left")
    return joined.select("qid", reason.isNotNull().alias("abstain"), reason.alias("reason"))


def abstain_cosine(queries: DataFrame, results: DataFrame, least: float = 0.30) -> DataFrame:
    """(qid, abstain) by the first result's similarity, which is 0 if only the lexical search found it."""
    joined = queries.select("qid").join(_top(results, "dense_score"), "qid", "left")
    return joined.select("qid", (F.col("_n").isNull() | (F.coalesce("_top", F.lit(0.0)) < least)).alias("abstain"))


def confidence(score: Column, least: float = 0.30) -> Column:
    """Struct (level, color, dots) by how far a similarity is above the threshold of abstention."""
    out = None
    for above, level, color, dots in reversed(lex.LEVELS):
        band = F.struct(F.lit(level).alias("level"), F.lit(color).alias("color"), F.lit(dots).alias("dots"))
        out = band if above is None else F.when(score >= F.lit(least) + F.lit(above), band).otherwise(out)
    return out


def most_common(rows: DataFrame, value: str, n: int, by: str = "qid") -> DataFrame:
    """(by, value, count, place) of the ``n`` most frequent values; ties keep the order of their first place (``pos``)."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("count"), F.min("pos").alias("_first"))
    order = Window.partitionBy(by).orderBy(F.col("count").desc(), "_first", value)
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("_first")


def verdict_counts(results: DataFrame, n: int = 3, patterns: dict[str, str] = lex.VERDICTS) -> DataFrame:
    """(qid, name, count, place) of the kinds of verdict that results' texts speak of; ties keep the first result's order."""
    kinds = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("pattern"), F.lit(i).alias("i")) for i, (k, p) in enumerate(patterns.items())])
    rows = results.select("qid", "pos", F.lower(F.coalesce("text", F.lit(""))).alias("_t"), F.explode(kinds).alias("k")).filter(F.regexp_like("_t", F.col("k.pattern")))
    return most_common(rows.select("qid", (F.col("pos") * 100 + F.col("k.i")).alias("pos"), F.col("k.name").alias("name")), "name", n)


def statute_counts(results: DataFrame, n: int = 2) -> DataFrame:
    rows = results.select("qid", "pos", F.posexplode("kanunlar").alias("i", "name"))
    return most_common(rows.select("qid", (F.col("pos") * 100 + F.col("i")).alias("pos"), "name"), "name", n)


def result_summary(results: DataFrame) -> DataFrame:
    """(qid, n_results, board, board_count, n_boards, verdicts, statutes) over the results (qid, pos, kurul, text, kanunlar) of each query."""
    rows = results.withColumn("kurul", F.coalesce("kurul", F.lit("?")))
    whole = rows.groupBy("qid").agg(F.count("*").alias("n_results"), F.countDistinct("kurul").alias("n_boards"))
    board = most_common(rows, "kurul", 1).select("qid", F.col("kurul").alias("board"), F.col("count").alias("board_count"))
    listed = lambda df, sep, text: df.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("x")))), lambda p: p.x), sep).alias("_x"))
    verdicts = listed(verdict_counts(rows), " · ", F.concat("name", F.lit(" ("), F.col("count").cast("string"), F.lit(")"))).withColumnRenamed("_x", "verdicts")
    statutes = listed(statute_counts(rows), "; ", F.col("name")).withColumnRenamed("_x", "statutes")
    out = whole.join(board, "qid").join(verdicts, "qid", "left").join(statutes, "qid", "left")
    return out.select("qid", "n_results", "board", "board_count", "n_boards", F.coalesce("verdicts", F.lit("")).alias("verdicts"), F.coalesce("statutes", F.lit("")).alias("statutes"))


def full_text(chunks: DataFrame, key: str = "karar_id") -> DataFrame:
    """(key, full_text): a document's distinct passages in order of first place, two line breaks between them."""
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x.text))
    return chunks.groupBy(key).agg(F.array_join(parts, "\n\n").alias("full_text"))


def summary_html(summary: DataFrame) -> DataFrame:
    """(qid, html): the summary as a line for each of its parts."""
    bold = lambda c: F.concat(F.lit("<b>"), c.cast("string"), F.lit("</b>"))
    board = F.when(F.col("board_count") > 1, F.concat(F.lit("çoğunlukla "), bold(F.col("board")))).otherwise(bold(F.concat(F.col("n_boards").cast("string"), F.lit(" farklı daireden"))))
    line = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"<b>{title}:</b> "), F.col(c)))
    first = F.concat(bold(F.col("n_results")), F.lit(" emsal "), board, F.lit(" geldi."))
    return summary.select("qid", F.concat_ws("<br>", first, line("Hüküm dağılımı", "verdicts"), line("Sık atıf", "statutes")).alias("html"))


def cards(queries: DataFrame, results: DataFrame, texts: DataFrame, least: float = 0.30) -> DataFrame:
    """One row for each card: qid, pos, kurul, reference, level, dots, snippet (html), chips, full_text (html).

    ``queries`` (qid, query), ``results`` (qid, pos, karar_id, kurul, esas_no, karar_no, tarih, text, kanunlar,
    dense_score) and ``texts`` (karar_id, full_text). Queries that abstain have no cards; of results with one opening
    the first is shown.
    """
    answered = abstain_cosine(queries, results, least).filter("NOT abstain").select("qid")
    shown = first_of_signature(results.join(answered, "qid", "left_semi"), T.near_key(F.col("text")), "pos")
    rows = shown.join(queries.select("qid", "query"), "qid").join(texts, "karar_id", "left")
    level = confidence(F.coalesce("dense_score", F.lit(0.0)), least)
    named = lambda c, other: T.fallback(F.col(c), F.lit(other))
    reference = F.concat(F.lit("Esas "), named("esas_no", "?"), F.lit(" · Karar "), named("karar_no", "?"), F.lit(" · "), named("tarih", "—"))
    return rows.select(
        "qid",
        "pos",
        named("kurul", "Bilinmeyen Daire").alias("kurul"),
        reference.alias("reference"),
        level.level.alias("level"),
        level.dots.alias("dots"),
        T.marks_to_html(T.escape_html(T.marked_snippet(F.col("query"), F.col("text")))).alias("snippet"),
        F.slice(F.coalesce("kanunlar", F.array().cast("array<string>")), 1, 3).alias("chips"),
        F.replace(T.escape_html(F.coalesce("full_text", F.lit(""))), F.lit("\n"), F.lit("<br>")).alias("full_text"),
    )


def respond(queries: DataFrame, results: DataFrame, texts: DataFrame, least: float = 0.30) -> DataFrame:
    """One row for each query: qid, state, summary (html), and its cards in order as an array of structs, numbered from 1.

    The inputs are those of ``cards``. The state is ``empty`` for a query without words, ``abstained`` for one without results or whose first result is
    less similar than ``least``, else ``answered``; only these have a summary and cards, both of the results without near-identical openings. Of queries
    with one qid, each has its row and the cards of all.
    """
    asked = queries.select("qid", T.strip(F.coalesce("query", F.lit(""))).alias("query"))
    said = asked.filter("query <> ''")
    weak = abstain_cosine(said.select("qid").distinct(), results, least)
    shown = first_of_signature(results.join(weak.filter("NOT abstain").select("qid"), "qid", "left_semi"), T.near_key(F.coalesce("text", F.lit(""))), "pos")
    made = cards(said, shown, texts, least)
    fields = [c for c in made.columns if c not in ("qid", "pos")]
    # a query has as many cards as it has results, so the array is short
    listed = made.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_c"))
    listed = listed.select("qid", F.transform("_c", lambda c, i: F.struct((i + 1).alias("place"), *[c[f].alias(f) for f in fields])).alias("cards"))
    rows = asked.join(weak, "qid", "left").join(summary_html(result_summary(shown)).withColumnRenamed("html", "summary"), "qid", "left").join(listed, "qid", "left")
    state = F.when(F.col("query") == "", "empty").when(F.col("abstain"), "abstained").otherwise("answered")
    answered = lambda c: F.when(state == "answered", F.col(c)).alias(c)
    return rows.select("qid", state.alias("state"), answered("summary"), answered("cards"))


def markdown_answer(queries: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """(qid, answer): a card for each of the first ``most`` results with its snippet, or an apology without results."""
    named = lambda c, other: T.fallback(F.col(c), F.lit(other))
    rows = results.filter(F.col("pos") <= most).join(queries.select("qid", "query"), "qid")
    laws = F.when(F.size(F.coalesce("kanunlar", F.array().cast("array<string>"))) > 0, F.array_join(F.slice("kanunlar", 1, 3), "; ")).otherwise("—")
    quote = T.strip(T.squeeze(T.snippet(F.col("text"), T.tokens(F.col("query")), 500)))
    card = F.format_string(
        "---\n**[%d] %s — E. %s, K. %s (%s)**  \nİlgili mevzuat: %s  \nSkor: %.3f  \n\n> %s\n",
        F.col("pos"), named("kurul", "Bilinmeyen Kurul"), named("esas_no", "?"), named("karar_no", "?"), named("tarih", "?"), laws, F.col("score"), quote,
    )
    body = rows.select("qid", "pos", card.alias("card")).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "card"))).alias("_c"))
    head = F.concat(F.lit("### Sorgu\n> "), F.col("query"), F.lit("\n\n**Bulunan "), F.size("_c").cast("string"), F.lit(" ilgili Yargıtay kararı:**\n\n"))
    whole = F.concat(head, F.array_join(F.transform("_c", lambda x: x.card), "\n"), F.lit(lex.ANSWER_NOTE))
    return queries.select("qid", "query").join(body, "qid", "left").select("qid", F.when(F.col("_c").isNull(), F.lit(lex.NO_ANSWER)).otherwise(whole).alias("answer"))
