"""Embedding whitening: the leading singular vectors of the centred rows, by Spark MLlib's ``computeSVD``.

Entries are fixed-point integers, so sums, deviations and the total variance are exact, whatever the order of rows. The rows less
their mean are a distributed matrix whose singular values s give the eigenvalues s * s / n of the covariance with divisor n. MLlib
adds up the Gramian of the centred rows over the partitions (a triangle of width * width numbers each) and decomposes it on the
driver; the number of rows never matters there. A second pass projects the rows, and what it wrote is measured against the identity.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, extend

#: Singular values below this share of the largest are noise of the Gramian's sums, not components.
NOISE = 1e-7
#: Values of 38 digits, the widest that Spark sums exactly.
WIDE = "decimal(38,0)"


def fixed_point(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry c, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift)


def whole(vector: Column) -> Column:
    """Whether a vector is there and has at least one entry, and all of them are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


@dataclass(frozen=True)
class Whitening:
    """What is learnt from the fit list: row count, sums a dimension, unit eigenvectors as rows, their eigenvalues, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray

    def exact_deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S) squared for each row of integers, exactly."""
        sums = np.array(self.sums, np.int64)
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(x.shape[1], 1) < 2**63:
            d = self.n * x - sums
            return (d * d).sum(1).tolist()
        high = most < 2**62  # differences fit; squares are added as two halves of 31 bits each
        if high and int(np.abs(d := self.n * x - sums).max(initial=0)) < 2**31:
            square = d * d
            return [(int(a) << 31) + int(b) for a, b in zip((square >> 31).sum(1), (square & (2**31 - 1)).sum(1), strict=True)]
        wide = x.astype(object) * self.n - np.array(self.sums, object)
        return (wide * wide).sum(1).tolist()

    def project(self, x: np.ndarray) -> np.ndarray:
        """The rows less the mean on each component, over the root of its eigenvalue."""
        centred = (self.n * x - np.array(self.sums, np.int64)) / self.n
        return centred @ self.components.T / np.sqrt(self.eigenvalues)


def fit(rows: DataFrame, x: str = "_x", components: int = 8) -> Whitening | None:
    """Components of integer vectors of one width, by falling eigenvalue; None without rows. At most as many as the rank."""
    sums = sorted(rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect())
    if not sums:
        return None
    n, total = sums[0].n, [r.s for r in sums]
    if any(r.n != n for r in sums):
        raise ValueError("vectors of several widths have no common covariance")
    mean = F.array(*[F.lit(s) for s in total])
    centred = F.zip_with(F.col(x), mean, lambda v, s: (v * n - s).cast("double") / n)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v"), n, len(total))
    if not rows.select(F.exists(F.zip_with(x, mean, lambda v, s: v * n - s), lambda d: d != 0).alias("d")).filter("d").take(1):
        return Whitening(n, total, np.zeros((0, len(total))), np.zeros(0))
    svd = matrix.computeSVD(len(total), computeU=False, rCond=NOISE)  # all of them: the dense solver then, not the iterative one
    values = np.array(svd.s.toArray()) ** 2 / n
    vectors = svd.V.toArray().T[: len(values)]
    strongest = np.abs(vectors).argmax(1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), strongest])[:, None]
    return Whitening(n, total, vectors[:components], values[:components])


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row for each kept vector and component: id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error.

    Rows whose vector is null, is empty or holds a null or non-finite entry are left out of the fit and of the result. All others must
    have one width, else ValueError. An entry c counts as floor(scale * c) + shift; past 2**62 / n Spark's and numpy's sums would
    overflow, and such entries make the query fail rather than give a wrong number. Repeated rows and null ids count and are returned
    as often as they occur. There are at most as many components as the vectors' rank: none, so no rows, where all vectors are equal
    or none is left. Equal eigenvalues have no order of their own; any basis of theirs is right. A component's sign makes its
    largest entry positive. Columns other than the two named are not read, so they may have any name.
    """
    kept = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(whole(F.col("_v"))).select("_id", fixed_point(F.col("_v"), scale, shift).alias("_x"))
    found = fit(kept, "_x", components)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if found is None or not len(found.eigenvalues):
        none = kept.limit(0).select("_id", F.lit(0), F.lit(0).cast("long"), F.lit(None).cast(WIDE), *[F.lit(0.0)] * 3)
        return none.toDF(*names)

    def start():
        def make(batch):
            column = batch.column("_x")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(found.sums)), np.int64)
            z = found.project(x)
            offsets = np.arange(0, z.size + 1, z.shape[1])
            return [[Decimal(d) for d in found.exact_deviation(x)], pa.ListArray.from_arrays(offsets.astype(np.int32), z.ravel())]

        return make

    done = Scratch(rows.sparkSession, "whitening").table("projected", extend(kept, f"d {WIDE}, z array<double>", start, drop=("_x",)))
    k, n = len(found.eigenvalues), found.n
    z = [F.col("z")[i] for i in range(k)]
    first = done.agg(F.sum("d").alias("d"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    variance = float(first.d / n / n / n)  # decimals of 28 digits: the sum of (n * x - S)^2 is n^2 * n times the trace
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = done.agg(*[F.avg((z[i] - first[f"m{i}"]) * (z[j] - first[f"m{j}"])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    error = max(abs(products[f"p{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*[F.lit(float(e) / variance) for e in found.eigenvalues])
    long = done.select("_id", F.posexplode("z").alias("_c", "w"), "d")
    return long.select("_id", F.col("_c") + 1, F.lit(n).cast("long"), "d", "w", F.element_at(share, F.col("_c") + 1), F.lit(float(error))).toDF(*names)
