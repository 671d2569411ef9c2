"""Bootstrap intervals, paired tests and summaries of per-query metrics.

The resampling is relational: draw i of resample b takes the row numbered md5(b|i) modulo n, so any engine
repeats it. Resamples are split over the cluster; each draw is a lookup in the numbered values, which are as
many as there are queries. A numpy twin gives what one seeded generator gives in a loop, its resamples split over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import stars
from corvane.scratch import Scratch


def numbered(values: DataFrame, value: str, key: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(i, v), numbered from 0 in the order of the key, and how many.

    Values are dealt by ranges of the key and numbered within each range; a range's offset is the size of those before it, a number
    for each partition. So no task gathers all values.
    """
    dealt = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).repartitionByRange("k").withColumn("part", F.spark_partition_id())
    dealt = scratch.table("dealt", dealt)
    sizes = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, n = [], 0
    for part, size in sizes:
        offsets.append((part, n))
        n += size
    at = F.row_number().over(Window.partitionBy("part").orderBy("k")) - 1
    # a row for each partition
    before = F.broadcast(values.sparkSession.createDataFrame(offsets, "part int, before long"))
    return dealt.withColumn("at", at).join(before, "part").select((F.col("at") + F.col("before")).alias("i"), "v"), n


def draw(b: Column, i: Column, n: int) -> Column:
    """The row that draw ``i`` of resample ``b`` takes."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", b, i)), 1, 8), 16, 10).cast("long") % n


def resampled_means(values: DataFrame, value: str, resamples: int, key: str = "qid") -> DataFrame:
    """(b, m): the mean of each resample. Sums are of whole millionths, so their order doesn't matter."""
    rows, n = numbered(values, value, key, Scratch(values.sparkSession, "resample"))
    rows = rows.withColumn("u", F.round(F.col("v") * 1_000_000).cast("long"))
    spark = values.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "b").select("b", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("k"))
    drawn = draws.select("b", draw(F.col("b"), F.col("k"), max(n, 1)).alias("i")).groupBy("b", "i").agg(F.count("*").alias("w"))
    return drawn.join(rows.select("i", "u"), "i").groupBy("b").agg((F.sum(F.col("u") * F.col("w")) / F.lit(1_000_000.0 * max(n, 1))).alias("m"))


def bootstrap_ci(values: DataFrame, value: str, resamples: int = 10_000, ci: float = 0.95, key: str = "qid") -> DataFrame:
    """One row (mean, lo, hi): percentiles of resampled means, linearly interpolated; zeros without values."""
    low, high = (1 - ci) / 2, (1 + ci) / 2
    means = resampled_means(values, value, resamples, key)
    bounds = means.agg(F.percentile("m", F.lit(low)).alias("lo"), F.percentile("m", F.lit(high)).alias("hi"))
    whole = values.agg(F.avg(F.col(value).cast("double")).alias("mean"))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    return whole.crossJoin(F.broadcast(bounds)).select(zero("mean"), zero("lo"), zero("hi"))


def differences(a: DataFrame, b: DataFrame, value: str, key: str = "qid") -> DataFrame:
    """(key, d) of queries that both systems have; other queries are an error of the caller."""
    return a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key).select(key, (F.col("_a") - F.col("_b")).cast("double").alias("d"))


def paired_bootstrap(a: DataFrame, b: DataFrame, value: str, resamples: int = 10_000, key: str = "qid") -> DataFrame:
    """One row (diff_mean, p_value, ci_lo, ci_hi): p is twice the share of resamples whose mean has the other sign, at most 1."""
    d = Scratch(a.sparkSession, "paired").table("differences", differences(a, b, value, key))
    means = resampled_means(d, "d", resamples, key)
    seen = d.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("diff_mean"))
    parts = means.agg(
        F.sum((F.col("m") <= 0).cast("int")).alias("_low"),
        F.sum((F.col("m") >= 0).cast("int")).alias("_high"),
        F.count("*").alias("_n"),
        F.percentile("m", F.lit(0.025)).alias("ci_lo"),
        F.percentile("m", F.lit(0.975)).alias("ci_hi"),
    )
    flips = F.when(F.col("diff_mean") >= 0, F.col("_low")).otherwise(F.col("_high"))
    p = F.when(F.col("_n") > 0, F.least(F.lit(1.0), 2.0 * flips / F.col("_n"))).otherwise(1.0)
    out = seen.crossJoin(F.broadcast(parts)).withColumn("p_value", p)
    return out.select(*[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in ("diff_mean", "p_value", "ci_lo", "ci_hi")])


#: 64-bit outputs of the generator that one task of the first pass looks at.
OUTPUTS = 1 << 20


def _words(seed: int, first: int, count: int) -> np.ndarray:
    """The 32-bit words of the generator's outputs from ``first`` on, in the order in which bounded draws take them."""
    bits = np.random.PCG64(seed).advance(first)
    raw = bits.random_raw(count)
    return np.stack([raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], 1).ravel()


def _accepted(seed: int, n: int, first: int, count: int) -> np.ndarray:
    """Which of the words give a draw below ``n``; the others are drawn again. A word w is taken if w * n mod 2**32 is at least 2**32 mod n."""
    return (_words(seed, first, count) * np.uint64(n) & np.uint64(0xFFFFFFFF)) >= np.uint64(2**32 % n)


def generator_at(seed: int, word: int) -> np.random.Generator:
    """The seeded generator after ``word`` words have been drawn."""
    bits = np.random.PCG64(seed).advance(word // 2)
    if word % 2:  # the upper half of the next output is still to come
        high = int(bits.random_raw()) >> 32
        state = bits.state
        bits.state = state | {"has_uint32": 1, "uinteger": high}
    return np.random.Generator(bits)


def _first_words(spark, sizes: list[int], resamples: int, seed: int, tasks: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each number of values: (first resample, one behind the last, word of the first draw), a task each.

    A draw takes a word, or more when one is turned down, so where a resample begins depends on the words before. Tasks count the
    words taken in ``OUTPUTS`` outputs each; the counts, a number for each task, tell in which stretch a resample begins.
    """
    bounds = sorted({resamples * t // tasks for t in range(tasks + 1)})
    ranges = list(zip(bounds, bounds[1:]))
    out = {n: [(a, b, a * n) for a, b in ranges] for n in sizes if n < 2 or 2**32 % n == 0}
    todo = [n for n in sizes if n not in out]
    if not todo:
        return out
    stretches = [(n, i) for n in todo for i in range(int(resamples * n / (2 * (1 - (2**32 % n) / 2**32)) * 1.001) // OUTPUTS + 2)]

    def count(frames):
        for f in frames:
            f["taken"] = [int(_accepted(seed, n, i * OUTPUTS, OUTPUTS).sum()) for n, i in zip(f["n"], f["i"], strict=True)]
            yield f

    counted = spark.createDataFrame(stretches, "n long, i long").repartition(len(stretches), "n", "i").mapInPandas(count, "n long, i long, taken long").collect()
    for n in todo:
        before, rows = 0, iter(sorted((r.i, r.taken) for r in counted if r.n == n))
        i, taken = next(rows)
        out[n] = []
        for a, b in ranges:
            while before + taken <= a * n:
                before, (i, taken) = before + taken, next(rows)
            # the words before it that are turned down right at its beginning may as well be its own
            place = np.flatnonzero(_accepted(seed, n, i * OUTPUTS, OUTPUTS))[a * n - before]
            out[n].append((a, b, 2 * i * OUTPUTS + int(place)))
    return out


def bootstrap_ci_numpy(values: DataFrame, value: str, by: str, resamples: int = 10_000, ci: float = 0.95, seed: int = 42, key: str = "qid", tasks: int = 32) -> DataFrame:
    """(by, mean, lo, hi) with numpy's seeded generator, bit for bit what one loop over all resamples gives for the values in the order of ``key``.

    The resamples of a group are split over ``tasks`` tasks; each begins with the generator in the state that the loop would have reached. A
    group's values, one for each query, travel to its tasks as one array; groups without values have no row.
    """
    spark = values.sparkSession
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("double").alias("v")))), lambda p: p.v)
    groups = Scratch(spark, "bootstrap").table("groups", values.groupBy(by).agg(ordered.alias("v")).withColumn("n", F.size("v").cast("long")))
    sizes = [r.n for r in groups.select("n").distinct().collect()]
    plan = [(n, a, b, w) for n, rows in _first_words(spark, sizes, resamples, seed, tasks).items() for a, b, w in rows]

    def run(frames):
        for f in frames:
            for row in f.itertuples(index=False):
                v, rng = np.asarray(row.v, float), generator_at(seed, row.word)
                means = [rng.choice(v, size=len(v), replace=True).mean() for _ in range(row.begin, row.end)]
                yield pd.DataFrame({by: [getattr(row, by)], "begin": [row.begin], "mean": [v.mean()], "means": [means]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        means = np.concatenate([np.asarray(m) for m in group.sort_values("begin")["means"]])
        lo, hi = np.percentile(means, [(1 - ci) / 2 * 100, (1 + ci) / 2 * 100])
        return pd.DataFrame({by: [group[by].iloc[0]], "mean": [group["mean"].iloc[0]], "lo": [lo], "hi": [hi]})

    kind = dict(values.dtypes)[by]
    dealt = groups.join(F.broadcast(spark.createDataFrame(plan, "n long, begin long, end long, word long")), "n").repartition(max(tasks, 1), by, "begin")
    parts = dealt.select(by, "v", "begin", "end", "word").mapInPandas(run, f"{by} {kind}, begin long, mean double, means array<double>")
    return parts.groupBy(by).applyInPandas(finish, f"{by} {kind}, mean double, lo double, hi double")


def _student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's distribution, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    flipped = x > (a + 1) / (a + b + 2)
    if flipped:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    value = front * (f - 1)
    return 1 - value if flipped else value


def paired_t(a: DataFrame, b: DataFrame, value: str, key: str = "qid") -> DataFrame:
    """One row (t, df, p_value): the paired t-test; nulls where the differences don't vary."""
    stats = differences(a, b, value, key).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("*").alias("n"))
    out = stats.select(F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))

    def p(frames):
        for f in frames:
            f["p_value"] = [None if pd.isna(t) else _student_tail(float(t), float(d)) for t, d in zip(f["t"], f["df"], strict=True)]
            yield f

    return out.mapInPandas(p, "t double, df long, p_value double").select(F.round("t", 6).alias("t"), "df", F.round("p_value", 6).alias("p_value"))


def multi_seed(rows: DataFrame, seed: str, metrics: list[str]) -> DataFrame:
    """(metric, mean, std): over the seeds' means, the standard deviation being the population's."""
    per = rows.groupBy(seed).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    long = per.unpivot([seed], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


def comparison(name_a: str, a: DataFrame, name_b: str, b: DataFrame, metric: str, resamples: int = 10_000) -> DataFrame:
    """One row (report): both systems' means and intervals, and their difference with its significance."""
    one = lambda d, p: bootstrap_ci(d, metric, resamples).select(*[F.col(c).alias(f"{p}_{c}") for c in ("mean", "lo", "hi")])
    row = one(a, "a").crossJoin(F.broadcast(one(b, "b"))).crossJoin(F.broadcast(paired_bootstrap(a, b, metric, resamples)))
    text = F.format_string(
        f"{metric}:\n  {name_a:<28} %.3f  [%.3f, %.3f]\n  {name_b:<28} %.3f  [%.3f, %.3f]\n  Δ = %+.3f  (p=%.4f %s)",
        "a_mean", "a_lo", "a_hi", "b_mean", "b_lo", "b_hi", "diff_mean", "p_value", stars(F.col("p_value")),
    )
    return row.select(text.alias("report"))


def significance_grid(systems: dict[str, DataFrame], pairs: list[tuple[str, str]], metrics: list[str], resamples: int = 10_000) -> DataFrame:
    """(a, b, metric, diff_mean, p_value, stars) for each pair of systems and each metric."""
    out = None
    for a, b in pairs:
        for metric in metrics:
            row = paired_bootstrap(systems[a], systems[b], metric, resamples).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(metric).alias("metric"), "diff_mean", "p_value", stars(F.col("p_value")).alias("stars"))
            out = row if out is None else out.unionByName(row)
    return out
