"""The recurrent network's gradients and passes, its held-out accuracy, and odd rows."""

import zlib

import numpy as np

from corvane.llm import toxicity as t


def plain(net, words):
    """The logit of one window, word by word."""
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, net.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = [np.concatenate([p["word"][net.ids.get(w, 0)], p["char"][t.trigrams(w, net.buckets)].mean(0)]) for w in words]
    sides = []
    for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
        s, out = np.zeros(h), {}
        for i in order:
            a, u = x[i] @ p["in"][d] + p["bias"][d, 0], s @ p["turn"][d]
            z, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :]) + z * s
            out[i] = s
        sides.append([out[i] for i in range(len(x))])
    both = np.concatenate([np.array(sides[0]), np.array(sides[1])], 1)
    heed = np.exp(np.tanh(both @ p["look"]) @ p["ask"])
    return (heed / heed.sum()) @ both @ p["out"] + p["rest"][0]


def test_forward_and_gradients():
    net = t.Net(["aa", "bb"], hidden=3, embed=4, buckets=64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, cuts = ["aa", "bb", "zz", "é"], [[0, 1, 2, 3, 0], [2, 1], [3]]
    lengths = np.array([len(c) for c in cuts])
    index = np.array([c + [0] * (5 - len(c)) for c in cuts])
    taken, came = net.inputs(words)
    logits, kept = net.forward(taken.astype(np.float32), index, lengths, keep=True)
    assert np.allclose(logits, [plain(net, [words[i] for i in c]) for c in cuts], atol=1e-4)
    slope = np.array([1.0, -2.0, 0.5])
    got = net.backward(slope, kept, came, taken.shape)
    loss = lambda: sum(s * plain(net, [words[i] for i in c]) for s, c in zip(slope, cuts, strict=True))
    draw = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(6):
            at = tuple(draw.integers(0, n) for n in value.shape)
            if name == "char":
                at = (t.trigrams("zz", 64)[0], at[1])
            old = value[at]
            value[at] = old + 1e-4
            up = loss()
            value[at] = old - 1e-4
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-4 - got[name][at]) < 2e-3 * max(1, abs(got[name][at])), (name, at)


def test_windows_cover_texts():
    for n in (0, 1, 47, 48, 49, 71, 72, 73, 500):
        cuts = t.windows(n)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(b[0] <= a[0] + t.STRIDE for a, b in zip(cuts, cuts[1:], strict=False))


def test_held_out_accuracy_and_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = t.train(*t.sample(docs, labels, "doc_id", "text", "toxic", 1500, 12_000_000))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = t.score_documents(docs, net=net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(truth[r.doc_id], r) for r in got if r.held_out and r.doc_id in truth]
    toxic, clean = [[r.predicted for y, r in held if y == v] for v in (1, 0)]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03
    some = [r.text for r in docs.limit(60).collect()]
    small, large = t.Scorer(net, table_words=10, windows_a_batch=3)(some), t.Scorer(net)(some)
    assert np.allclose(small, large, atol=1e-4)
    best = [max(1 / (1 + np.exp(-plain(net, w[s:e]))) for s, e in t.windows(len(w))) for w in map(t.words_of, some[:5])]
    assert np.allclose(large[:5], best, atol=1e-3)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a"), (4, "a"), (None, "fine words"), (5, "bad " * 60_000), (6, "good day"), (6, "other")]
    df = spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, y) for i, y in [(4, 1), (5, 0), (5, None), (99, 1), (None, 1), (6, 7)]], "doc_id long, toxic int")
    got = t.score_documents(df, labels, steps=3).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.doc_id: r.held_out for r in got}[None]
    assert t.score_documents(df.limit(0), labels, steps=3).count() == 0
    assert t.score_documents(df, labels.limit(0), steps=3).filter("predicted = 1").count() == 0
