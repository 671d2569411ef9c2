"""Batches for in-batch negatives, the gradient of their loss, and training that finds what word overlap can't."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import contrastive, dense
from corvane.plans import index


@pytest.mark.parametrize("hot", [0, 60])
def test_no_positive_twice_in_a_batch(spark, hot):
    """Also with a positive that has a third of all rows, null and repeated ones; each row has one batch and batches are about even."""
    rows = [(f"q{i}", f"p{i % 40}") for i in range(120)] + [(f"h{i}", "hot") for i in range(hot)] + [("n", None), ("r", "p1"), ("r", "p1"), (None, "p2")]
    got = contrastive.in_batches(spark.createDataFrame(rows, "q string, p string"), "q", "p", size=16).collect()
    assert Counter((r.q, r.p) for r in got) == Counter(rows)
    assert max(Counter((r.batch, r.p) for r in got).values()) == 1
    sizes = Counter(r.batch for r in got)
    assert set(sizes) <= set(range(max(-(-len(rows) // 16), hot, 5)))
    if not hot:
        assert min(sizes.values()) >= 4 and len(sizes) == -(-len(rows) // 16)
    assert contrastive.in_batches(spark.createDataFrame([], "q string, p string"), "q", "p").count() == 0


def test_gradient_by_differences():
    """Every place of the matrix against a central difference; a row without features has no part in it."""
    rng = np.random.default_rng(0)
    a, p, w = rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), rng.normal(size=(4, 3))
    a[2] = 0
    _, gradient = contrastive.loss_and_gradient(a, p, w, 3.0)
    for i in range(4):
        for j in range(3):
            step = np.zeros_like(w)
            step[i, j] = 1e-6
            slope = (contrastive.loss_and_gradient(a, p, w + step, 3.0)[0] - contrastive.loss_and_gradient(a, p, w - step, 3.0)[0]) / 2e-6
            assert abs(slope - gradient[i, j]) < 1e-6
    assert contrastive.loss_and_gradient(a[:1], p[:1], w)[0] == 0  # alone in a batch there is nothing to tell apart


def test_training_finds_synonyms(spark):
    """Queries use other words than their passages, by a fixed dictionary. On queries that weren't trained on, hit@10 rises from chance to most."""
    rng = random.Random(6)
    words = [(f"ask{i:02d}", f"say{i:02d}") for i in range(60)]
    pairs = []
    for i in range(600):
        drawn = rng.sample(words, 4)
        pairs.append((i, " ".join(q for q, _ in drawn), " ".join(s for _, s in drawn)))
    made = spark.createDataFrame(pairs, "did long, query string, passage string")
    made = made.select("did", index.hashed_encoder(F.col("query"), 128).alias("a"), index.hashed_encoder(F.col("passage"), 128).alias("p")).cache()
    batched = contrastive.in_batches(made.filter("did < 500"), "did", "did", 50)
    matrix, losses = contrastive.train(batched, "a", "p", steps=25, rate=0.05)
    assert losses[-1] < losses[0] / 2

    def hits(w):
        vectors = made.select("did", contrastive.projected(F.col("a"), w).alias("a"), contrastive.projected(F.col("p"), w).alias("p"))
        vectors = vectors.select("did", dense.normalize(F.col("a")).alias("a"), dense.normalize(F.col("p")).alias("p"))
        return dense.search(vectors, "did", "p", vectors.filter("did >= 500"), "did", "a", 10).filter("qid = did").count()

    before, after = hits(np.eye(128)), hits(matrix)
    assert after > 70 > 20 > before, (before, after)


def test_training_without_rows(spark):
    empty = spark.createDataFrame([], "a array<double>, p array<double>, batch long")
    assert contrastive.train(empty, "a", "p")[1] == []
