"""Grounded generation: context, prompts, abstention, support of claims, citations. Models are plug-ins.

A language model and an entailment scorer are Columns made from Columns; the defaults need no weights: the model
answers with the context's first telling sentences and cites the first document, the scorer gives the share of a claim's
words that the premise has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as lex
from corvane.functions import text as T

from .answers import abstain_fused

# The prompts.
GROUNDED_PROMPT = """Sen bir Türk hukuku uzmanı asistanısın. SADECE aşağıda verilen Yargıtay/Danıştay kararlarına dayanarak cevap ver.

KURALLAR:
- Yalnızca verilen kararlardaki bilgileri kullan. Kendi bilgini EKLEME.
- Her iddiada hangi karara dayandığını [Karar N] şeklinde belirt.
- Verilen kararlar soruyu cevaplamak için YETERSİZSE, sadece şunu yaz: "CEVAP_YOK"
- Uydurma karar, madde veya bilgi ÜRETME.

VERİLEN KARARLAR:
{context}

SORU: {question}

CEVAP:"""
PLAIN_PROMPT = """Sen bir Türk hukuku uzmanı asistanısın. Aşağıdaki hukuki soruyu cevapla.

SORU: {question}

CEVAP:"""

Model = Callable[[Column, Column], Column]


def context(results: DataFrame, most: int = 5, size: int = 800) -> DataFrame:
    """(qid, context, n_docs): numbered heads and the opening of the first ``most`` results (qid, pos, kurul, esas_no, karar_no, text)."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("?"))
    part = F.concat(
        F.lit("[Karar "), F.col("pos").cast("string"), F.lit("] ("), unknown("kurul"), F.lit(" E."), unknown("esas_no"), F.lit("/K."), unknown("karar_no"), F.lit(")\n"),
        T.strip(T.squeeze(F.substring(F.coalesce("text", F.lit("")), 1, size))),
    )
    rows = results.groupBy("qid").agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", part.alias("x"))))).alias("_c"))
    return rows.select("qid", F.array_join(F.transform("_c", lambda c: c.x), "\n\n").alias("context"), "n_docs")


def prompt(question: Column, context: Column | None = None) -> Column:
    """The grounded prompt with a context, the plain one without."""
    text = F.replace(F.lit(GROUNDED_PROMPT if context is not None else PLAIN_PROMPT), F.lit("{question}"), question)
    return F.replace(text, F.lit("{context}"), context) if context is not None else text


def extractive_model(prompt: Column, context: Column) -> Column:
    """A stand-in for a language model: the context's first sentences of its first document, with its citation; else the abstention word."""
    body = F.regexp_replace(F.element_at(F.split(F.coalesce(context, F.lit("")), "\n\n"), 1), r"(?s)^\[Karar \d+\] \([^\n]*\)\n", "")
    said = T.summary(body)
    return F.when(said == "", F.lit(lex.ABSTAIN_TOKEN)).otherwise(F.concat(said, F.lit(" [Karar 1]")))


def overlap_entailment(premise: Column, claim: Column) -> Column:
    """A stand-in for an entailment model: the share of the claim's distinct words that occur in the premise."""
    words = F.array_distinct(T.tokens(claim))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, T.tokens(premise))) / F.size(words)).otherwise(0.0)


def generate(queries: DataFrame, results: DataFrame, model: Model = extractive_model, grounded: bool = True, check: bool = True) -> DataFrame:
    """(qid, answer, abstained, reason, prompt) for (qid, query). A grounded query with weak results isn't sent to the model."""
    rows = queries.select("qid", "query").join(context(results), "qid", "left")
    if grounded and check:
        rows = rows.join(abstain_fused(queries, results), "qid", "left")
    else:
        rows = rows.withColumns({"abstain": F.lit(False), "reason": F.lit(None).cast("string")})
    asked = prompt(F.col("query"), F.coalesce("context", F.lit("")) if grounded else None)
    answer = F.when(F.col("abstain"), F.lit(lex.ABSTAIN_TOKEN)).otherwise(T.strip(model(asked, F.col("context") if grounded else F.lit(None).cast("string"))))
    rows = rows.withColumn("answer", answer)
    return rows.select("qid", "answer", F.contains("answer", F.lit(lex.ABSTAIN_TOKEN)).alias("abstained"), "reason", F.when(~F.col("abstain"), asked).alias("prompt"))


def faithfulness(answers: DataFrame, scorer: Model = overlap_entailment, least: float = 0.5) -> DataFrame:
    """(qid, faithfulness, n_claims, supported, unsupported_claims) of (qid, answer, context); null without claims."""
    found = T.claims(F.coalesce("answer", F.lit("")))
    rows = answers.select("qid", F.coalesce("context", F.lit("")).alias("context"), found.alias("_claims"))
    each = rows.select("qid", "context", F.posexplode("_claims").alias("i", "claim")).withColumn("ok", scorer(F.col("context"), F.col("claim")) >= least)
    per = each.groupBy("qid").agg(F.sum(F.col("ok").cast("int")).alias("_s"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("i", "claim")))).alias("_u"))
    n, s = F.size("_claims"), F.coalesce("_s", F.lit(0))
    missing = F.coalesce(F.transform("_u", lambda x: x.claim), F.array().cast("array<string>"))
    return rows.select("qid", "_claims").join(per, "qid", "left").select("qid", F.when(n > 0, F.round(s / n, 6)).alias("faithfulness"), n.alias("n_claims"), s.cast("long").alias("supported"), missing.alias("unsupported_claims"))


def citation_stats(answer: Column, n_docs: Column) -> Column:
    """Struct (n_citations, valid_citations, citation_validity): distinct cited numbers, those of real documents, and their share."""
    cited = T.citations(F.coalesce(answer, F.lit("")))
    valid = F.filter(cited, lambda c: (c >= 1) & (c <= n_docs))
    share = F.when(F.size(cited) > 0, F.round(F.size(valid) / F.size(cited), 6))
    return F.struct(F.size(cited).alias("n_citations"), F.size(valid).alias("valid_citations"), share.alias("citation_validity"))


def citation_relevance(answers: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, citation_relevance): the share of valid citations whose document is judged relevant; null without valid ones."""
    cited = answers.select("qid", F.explode(T.citations(F.coalesce("answer", F.lit("")))).alias("pos")).join(results.select("qid", F.col("pos").cast("int").alias("pos"), "did"), ["qid", "pos"])
    judged = cited.join(qrels.filter("rel > 0").select("qid", "did", F.lit(1).alias("_r")), ["qid", "did"], "left")
    per = judged.groupBy("qid").agg(F.round(F.avg(F.coalesce("_r", F.lit(0))), 6).alias("citation_relevance"))
    return answers.select("qid").join(per, "qid", "left")


def safety_comparison(queries: DataFrame, results: DataFrame, model: Model = extractive_model, scorer: Model = overlap_entailment) -> DataFrame:
    """One row a query: grounded and plain answers with their faithfulness and citations; grounded faithfulness is null where it abstained."""
    contexts = context(results)
    out = queries.select("qid", "query")
    for name, grounded in (("grounded", True), ("plain", False)):
        made = generate(queries, results, model, grounded, grounded).join(contexts, "qid", "left")
        score = faithfulness(made, scorer).select("qid", "faithfulness")
        cite = citation_stats(F.col("answer"), F.coalesce("n_docs", F.lit(0)))
        made = made.join(score, "qid").select(
            "qid",
            F.col("answer").alias(f"{name}_answer"),
            F.col("abstained").alias(f"{name}_abstained"),
            F.when(~F.col("abstained") | F.lit(not grounded), F.col("faithfulness")).alias(f"{name}_faithfulness"),
            cite.valid_citations.alias(f"{name}_valid_citations"),
        )
        out = out.join(made, "qid")
    return out
