"""URL filtering by rules and by trust propagated over the graph of hosts.

Rules decide the pages they fit. For the others, two personalised PageRanks run over host edges: trust
walks along links from hosts whose pages are mostly allowed by rules, distrust walks against the links from
hosts whose pages are mostly blocked (a host that links to bad hosts is suspect). Links within a host don't
count. A host is blocked if its distrust is at least ``threshold`` times what an even share would be, and above
its trust.

Links become host edges before the first shuffle of the graph, so a page's links and a popular host cost one
row for each task. Each round is written to the shared folder; rounds go on until the scores rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)\shref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


#: Tables of hosts of up to so many rows (some ten megabytes) are broadcast.
SMALL, SALTS = 100_000, 16


def with_host_table(pages: DataFrame, table: DataFrame) -> DataFrame:
    """The pages with the columns of ``table`` (host, …), one row a host; null where there is none.

    A table measured small is broadcast. Beyond that, a host's pages are dealt over ``SALTS`` tasks, and pages without a host stay
    out of the join, so neither a popular host nor the empty one meets in one task.
    """
    if table.count() <= SMALL:
        return pages.join(F.broadcast(table), "host", "left")
    named = pages.filter("host <> ''").withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in pages.dtypes if t in ("string", "bigint", "int")]), F.lit(SALTS)))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return named.join(copies, ["host", "_salt"], "left").drop("_salt").unionByName(pages.filter("host = ''"), allowMissingColumns=True)


def apply_rules(pages: DataFrame, rules: list[tuple[str, str]], scratch: Scratch) -> DataFrame:
    """Adds rule and ruled (its verdict) to pages with host and path: of the rules that fit, the longest.

    A rule (like "net/") fits its host and all subdomains where the path begins with the rule's. Rules meet
    hosts, not pages, on the hosts' parent domains; up to a hundred thousand rules are broadcast.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules], "_domain string, _path string, _rule string, _ruled string")
    table = F.broadcast(table) if len(rules) <= 100_000 else table
    hosts = pages.filter("host <> ''").select("host").distinct()
    found = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("_domain")).join(table, "_domain")
    found = found.groupBy("host").agg(F.collect_set(F.struct(F.length("_rule").alias("size"), F.col("_rule").alias("rule"), F.col("_path").alias("path"), F.col("_ruled").alias("ruled"))).alias("_rules"))
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r.path)))
    return with_host_table(pages, scratch.table("rules", found)).withColumn("_best", best).select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.ruled").alias("ruled"))


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """(a, b, n): how many links lead from host a to another host b."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_HREF), 1), lambda u: host_of(F.concat(F.lit(":"), F.regexp_replace(u, "^[a-zA-Z]+:", "")))))
    edges = pages.filter("host <> ''").select(F.col("host").alias("a"), F.explode(links).alias("b"))
    return edges.filter("a <> b AND b <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind of ``seeds`` (kind, host, weight).

    ``edges`` (kind, a, b, w) have weights that sum to 1 from each a. Each kind's weights sum to 1; score that has
    no edge to follow is lost, so scores sum to at most 1. Rounds stop when no kind's scores move by ``tolerance`` in sum; as a round
    moves at most ``damping`` (below 1) of what the last one moved, they do.
    """
    base = seeds.select("kind", F.col("host"), (F.col("weight") * (1 - damping)).alias("base"))
    ranks = scratch.table("rank-0", base.withColumnRenamed("base", "score"))
    if edges.isEmpty():
        return ranks
    k = 0
    while True:
        k += 1
        known = F.broadcast(ranks) if ranks.count() <= SMALL else ranks
        moved = edges.join(known.withColumnRenamed("host", "a"), ["kind", "a"]).groupBy("kind", F.col("b").alias("host")).agg((F.sum(F.col("score") * F.col("w")) * damping).alias("base"))
        new = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("base").alias("score"))
        old = ranks.withColumnRenamed("score", "was")
        new = scratch.table(f"rank-{k}", new.join(old, ["kind", "host"], "left").withColumn("was", F.coalesce("was", F.lit(0.0))))
        change = new.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("d")).agg(F.max("d")).first()[0] or 0.0
        ranks = new.drop("was")
        scratch.drop(f"rank-{k - 1}")
        if change < tolerance:
            break
    return ranks


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, threshold: float = 0.1, damping: float = 0.85
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict (allow or block), trust, distrust.

    A null url or one without "://" has an empty host and path, no rule and the verdict allow; so has a
    host that no propagation reaches. Hosts of which at least ``share`` of the pages are allowed (blocked) by
    rules are seeds of trust (distrust). trust and distrust are the host's scores times the number of hosts.
    Null markup has no links. Repeated rows are pages of their own; an empty table gives an empty result. Other columns are not
    read. A url without a path (``http://a.net``) has the empty path, which doesn't begin with a rule's ``/``, so no rule fits it.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    base = pages.select(pages[id_col].alias("_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), pages[html_col].alias("_html"))
    judged = scratch.table("judged", apply_rules(base.drop("_html"), rules, scratch))
    hosts = judged.filter("host <> ''").groupBy("host").agg(F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("int")).alias("allowed"), F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("int")).alias("blocked"))
    kinds = F.filter(F.array(F.when(F.col("allowed") >= share, "trust"), F.when(F.col("blocked") >= share, "distrust")), lambda k: k.isNotNull())
    seeds = scratch.table("seeds", hosts.select("host", F.explode(kinds).alias("kind")))
    sizes = {r.kind: r.n for r in seeds.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # two rows at most
    weight = F.create_map(*[F.lit(x) for k, n in (sizes or {"": 1}).items() for x in (k, 1.0 / n)])
    links = scratch.table("edges", host_edges(base, "_html"))
    along = links.selectExpr("'trust' AS kind", "a", "b", "n").union(links.selectExpr("'distrust' AS kind", "b AS a", "a AS b", "n"))
    out = along.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    walk = scratch.table("walk", along.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")))
    ranks = propagate(walk, seeds.withColumn("weight", F.element_at(weight, F.col("kind"))), scratch, damping)
    count = hosts.select("host").union(links.select("b")).distinct().count()
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))) * count, F.lit(0.0))
    scores = ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    found = with_host_table(judged, scratch.table("scores", scores)).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    return found.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
