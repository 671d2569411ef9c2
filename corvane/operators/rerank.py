"""Reranking of candidates by a scorer of (query, text).

A scorer is a function of two Columns. ``model_scorer`` makes one from a loader of a Python model: each executor process
loads the model once and scores Arrow batches. The default needs no model: the share of the query's words in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

from .lexical import top


def overlap_scorer(query: Column, text: Column) -> Column:
    words = F.array_distinct(T.tokens(query))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, T.tokens(text))) / F.size(words)).otherwise(0.0)


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.tolist(), texts.tolist()), dtype="float64")

    return score


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, fetch_k: int = 20, top_k: int = 5, size: int = 1500) -> DataFrame:
    """(qid, did, score, rank): the best ``top_k`` of the first ``fetch_k`` candidates (qid, did, rank, query, text), texts cut to ``size``."""
    few = candidates.filter(F.col("rank") <= fetch_k)
    scored = few.select("qid", "did", F.col("rank").alias("_was"), F.round(scorer(F.col("query"), F.substring("text", 1, size)), 6).alias("score"))
    return top(scored, top_k, "_was", "did").drop("_was")
