"""Passages as a table function for SQL: ``SELECT d.id, c.* FROM d, LATERAL chunk(d.text) c``.

The native ``chunking.chunks`` is the fast way; this twin follows the same rules in Python, for SQL users.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def passages(text: str, most: int = 1200, overlap: int = 150, least: int = 200) -> list[str]:
    def packed(paragraph: str):
        line: list[str] = []
        for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", paragraph))):
            if line and len(" ".join((*line, s))) > most:
                yield " ".join(line)
                line = []
            line.append(s)
        if line:
            yield " ".join(line)

    pieces = [q for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n+", text))) for q in ([p] if len(p) <= most else packed(p))]
    done: list[str] = []
    for p in pieces:
        joined = f"{done[-1]}\n\n{p}" if done else p
        if done and len(joined) <= most:
            done[-1] = joined
        else:
            done.append(f"{done[-1][-overlap:]}\n\n{p}".strip() if done and overlap and len(done[-1]) > overlap else p)
    return [c for c in done if len(c) >= least]


@udtf(returnType="chunk_idx int, n_chunks int, text string")
class Chunk:
    def eval(self, text: str):
        made = passages(text or "")
        for i, c in enumerate(made):
            yield i, len(made), c


def register(spark: SparkSession, name: str = "chunk") -> None:
    spark.udtf.register(name, Chunk)
