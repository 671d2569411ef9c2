"""Connected components by pointing at minima and contracting, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, label) for every vertex of ``links`` (a, b): the smallest vertex that it reaches.

    Each round points a vertex at the least of itself and its neighbours, follows these pointers to their ends, and
    contracts the links to the ends they lead to; links within one end fall away, so rounds shrink fast. Each step is
    written to the shared folder and dropped when the next is; minima are combined before the shuffle, so a hub costs one row in each task.
    """
    edges = scratch.table(f"{name}-edges", links.filter("a <> b").select("a", "b").distinct())
    labels = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.table(f"{name}-{turn}-0", both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        jump = 0
        while True:
            jump += 1
            top = up.select(F.col("v").alias("p"), F.col("p").alias("top"))
            new = scratch.table(f"{name}-{turn}-{jump}", up.join(top, "p").select("v", F.col("top").alias("p"), (F.col("top") != F.col("p")).alias("moved")))
            up = new.select("v", "p")
            scratch.drop(f"{name}-{turn}-{jump - 1}")
            if new.filter("moved").isEmpty():
                break
        ends = up.select(F.col("v").alias("label"), "p")
        labels = up.select("v", F.col("p").alias("label")) if labels is None else labels.join(ends, "label", "left").select("v", F.coalesce("p", "label").alias("label"))
        labels = scratch.table(f"{name}-{turn}-labels", labels)
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("v").alias(end), F.col("p").alias(f"_{end}")), end)
        edges = scratch.table(f"{name}-{turn}-edges", edges.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        scratch.drop(f"{name}-{turn}-{jump}", f"{name}-{turn - 1}-edges" if turn > 1 else f"{name}-edges", *[f"{name}-{turn - 1}-labels"] * (turn > 1))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("label")) if labels is None else labels


def extend_components(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, label) after further ``links``; only the components that these join are worked on again."""
    if labels is None:
        return scratch.table(name, connected(links, scratch, f"{name}-own"))
    named = links
    for end in ("a", "b"):
        of = labels.select(F.col("v").alias(end), F.col("label").alias(f"_{end}"))
        named = named.join(of, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    merged = connected(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")), scratch, f"{name}-merged")
    to = merged.select(F.col("v").alias("label"), F.col("label").alias("_to"))
    old = labels.join(to, "label", "left").select("v", F.coalesce("_to", "label").alias("label"))
    return scratch.table(name, old.unionByName(merged.join(labels.select("v"), "v", "left_anti")))
