"""Python models as Column functions: encoders, scorers of pairs (rerankers, entailment) and language models.

A loader takes nothing and returns the model as a function of lists. It travels to the executors, where each Python worker process calls it
once, however many tasks and batches it serves; rows come as Arrow batches. What is made here fits wherever the library takes such a
Column function: ``index.build(encode=…)``, ``rerank.rerank(scorer=…)``, ``grounding.generate(model=…)``, ``grounding.safety_comparison(…)``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

_loaded: dict[str, Callable] = {}


def _once(load: Callable[[], Callable]) -> Callable[[], Callable]:
    """``load``, but at most once in each process; loaders with the same code and values are one."""
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def loaded() -> Callable:
        from corvane.functions import models  # the worker's own module, not what travelled with the function

        if key not in models._loaded:
            models._loaded[key] = load()
        return models._loaded[key]

    return loaded


def _texts(column: pd.Series) -> list[str]:
    return ["" if t is None else t for t in column]


def encoder(load: Callable[[], Callable[[list[str]], list]], prefix: str = "") -> Callable[[Column], Column]:
    """A Column of vectors from one of texts. The model gives a vector for each text; null texts count as empty."""
    get = _once(load)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = get()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model([prefix + t for t in _texts(texts)])], dtype=object)

    return encode


def scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A Column of numbers from two of texts: a query and a text for a reranker, a premise and a claim for entailment."""
    get = _once(load)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = get()
        for left, right in batches:
            yield pd.Series(model(_texts(left), _texts(right)), dtype="float64")

    return score


def generator(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column, Column], Column]:
    """A Column of answers from prompts. The second Column, the context, is for models without a prompt and isn't sent."""
    get = _once(load)

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = get()
        for prompts in batches:
            yield pd.Series(model(_texts(prompts)), dtype=object)

    return lambda prompt, context: answer(prompt)
