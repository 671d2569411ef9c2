"""URL verdicts against plain rules and dense linear algebra."""

import re
from collections import Counter

import numpy as np

from corvane.llm import url_filter as u

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = []
    for r, v in RULES:
        h, _, p = r.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r, v))
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    """Verdicts with the propagation solved as a linear system."""
    pages = [(i, *split(url), html) for i, url, html in rows]
    names = sorted({h for _, h, _, _ in pages if h})
    edges = Counter()
    for _, host, _, html in pages:
        for b in {lower(re.match(r"[^/?#]*", x)[0]) for x in re.findall(r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^"'\s>]+)""", html or "")} - {""}:
            if host and b != host:
                edges[host, b] += 1
                names = sorted({*names, b})
    at, n = {h: k for k, h in enumerate(names)}, len(names)
    walk = np.zeros((n, n))
    for (a, b), c in edges.items():
        walk[at[a], at[b]] = c
    score = {}
    for kind, word, w in (("trust", "allow", walk), ("distrust", "block", walk.T)):
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        seed = np.zeros(n)
        for h in names:
            own = [ruled(h, p)[1] == word for _, g, p, _ in pages if g == h]
            seed[at[h]] = bool(own) and sum(own) >= 0.5 * len(own)
        seed /= max(seed.sum(), 1)
        score[kind] = n * 0.15 * np.linalg.solve(np.eye(n) - 0.85 * w.T, seed)
    out = Counter()
    for i, h, p, _ in pages:
        r, v = ruled(h, p)
        t, d = (score["trust"][at[h]], score["distrust"][at[h]]) if h else (0, 0)
        out[i, h, p, r, v or ("block" if d >= 0.1 and d > t else "allow")] += 1
    return out


def test_graph_and_odd_rows(spark):
    link = lambda *hs: "".join(f'<a class=x href="{h}">x</a>' for h in hs)
    rows = [
        (1, "http://Bad.NET/x", link("http://farm.com/1", "/own")),
        (2, "http://farm.com/p?q#f", link("https://bad.net/a", "//BAD.net:80/", "http://bad.net")),
        (3, "https://farm2.com", link("http://bad.net/z", "http://farm.com")),
        (4, "http://good.org/fr/1", link("http://friend.com")),
        (5, "http://friend.com/en", link("http://good.org/fr/")),
        (6, "http://www.example.net/en/a", None),
        (7, "http://www.example.net/de/a", ""),
        (8, "http://x.example.com/de/", link("http://y.example.com")),
        (9, "http://x.example.com/fr/", link("http://bad.net")),
        (10, None, link("http://bad.net")),
        (11, "no scheme", None),
        (12, "a://b://c/d", None),
        (13, "http://notexample.net.org/fr/", None),
        (14, "://net?x=/", None),
        (15, "http://net/", None),
        (16, "http://lone.com/" + "a" * 50_000, "<p>" * 50_000),
        (1, "http://Bad.NET/x", link("http://farm.com/1", "/own")),
        (None, "http://farm.com/p", None),
        (17, "", None),
    ]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, rule string, score int")
    got = Counter(tuple(r)[:5] for r in u.judge(df, RULES).collect())
    want = brute(rows)
    assert got == want
    verdicts = {k[0]: k[4] for k in want}
    assert verdicts[2] == "block" and verdicts[5] == "allow"
    assert u.judge(df.limit(0), RULES).count() == 0


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert Counter(tuple(r)[:5] for r in u.judge(pages, RULES).collect()) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])
