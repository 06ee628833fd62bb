import bisect
import itertools
import math
import random
import zlib

import numpy as np
from tests.llm.helpers import docs
from twinseek.llm import gam, registry


def made(n=700, seed=2):
    r = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(r.randrange(5, 120))]
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [x for w in words[:9] for x in [w] * 12]
        out.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 0 if bad else 1, 0))
    return out, labels


def test_held_out_accuracy(spark, tmp_path):
    data, labels = made()
    odd = [(9000, None, None, None, None), (9001, "", None, None, None), (9002, "\U0001f600" * 50000, None, None, None), (9002, "twice", None, None, None), (None, "no id", None, None, None)]
    docs(spark, data + odd).withColumnRenamed("n_chars", "x").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(3, 1, 0), (None, 1, 0), (9001, None, 0), (123456, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.op10_gam(spark, str(tmp_path)).collect()
    assert len(got) == len(data) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {d: y for d, y, _ in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_do_not_matter(spark):
    data, labels = made(200)
    df = docs(spark, data)
    keep = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, gam.classify(df, frame(x)).collect())) for x in (keep, keep[::-1]))
    assert a == b


def test_look_ups_match_the_trees():
    r = np.random.default_rng(0)
    x = r.random((500, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    bins = model.bins(x)
    by_hand = [model.base + sum(t[b] for t, b in zip(model.tables, row)) + sum(t[row[i], row[j]] for (i, j), t in zip(model.pairs, model.pair_tables)) for row in bins]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.array(by_hand))))


def test_one_label_or_none(spark):
    df = docs(spark, made(20)[0])
    assert len({r.score for r in gam.classify(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}) == 1
    assert gam.classify(docs(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def slow_cut(g, h):
    best, at, gl, hl = None, 0, 0.0, 0.0
    gs, hs = sum(g), sum(h)
    for k in range(len(g) - 1):
        gl, hl = gl + g[k], hl + h[k]
        gain = gl**2 / (hl + gam.RIDGE) + (gs - gl) ** 2 / (hs - hl + gam.RIDGE) - gs**2 / (hs + gam.RIDGE)
        if best is None or gain > best + 1e-12:
            best, at = gain, k + 1
    return (best, at) if best is not None else (0.0, 0)


def slow_tree(g, h, depth):
    gain, at = slow_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return [-sum(g) / (sum(h) + gam.RIDGE)] * len(g)
    return slow_tree(g[:at], h[:at], depth - 1) + slow_tree(g[at:], h[at:], depth - 1)


def slow_quantiles(values):
    v, out = sorted(values), set()
    for k in range(1, gam.BINS):
        at = k / gam.BINS * (len(v) - 1)
        lo = int(at)
        out.add(v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo))
    return sorted(out)


def slow_train(x, y):
    """The same boosting, row by row and bin by bin in plain Python; the score of a row."""
    n, width = len(x), len(gam.FEATURES)
    edges = [slow_quantiles([r[k] for r in x]) for k in range(width)]
    bins = [[bisect.bisect_right(e, v) for e, v in zip(edges, r)] for r in x]
    rate = (sum(y) + 1) / (n + 2)
    raw = [math.log(rate / (1 - rate))] * n
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def slopes():
        p = [1 / (1 + math.exp(-z)) for z in raw]
        return [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

    for _ in range(gam.ROUNDS):
        for k, t in enumerate(tables):
            g, h = slopes()
            gb, hb = [0.0] * len(t), [0.0] * len(t)
            for b, a, c in zip(bins, g, h):
                gb[b[k]] += a
                hb[b[k]] += c
            step = [gam.RATE * v for v in slow_tree(gb, hb, 2)]
            tables[k] = [a + b for a, b in zip(t, step)]
            raw = [z + step[b[k]] for z, b in zip(raw, bins)]

    def grid(i, j):
        g, h = slopes()
        gg = [[0.0] * len(tables[j]) for _ in tables[i]]
        hh = [[0.0] * len(tables[j]) for _ in tables[i]]
        for b, a, c in zip(bins, g, h):
            gg[b[i]][b[j]] += a
            hh[b[i]][b[j]] += c
        _, at = slow_cut([sum(r) for r in gg], [sum(r) for r in hh])
        out = [[0.0] * len(tables[j]) for _ in tables[i]]
        for rows_ in (range(at), range(at, len(gg))):
            if rows_:
                values = slow_tree([sum(gg[r][c] for r in rows_) for c in range(len(tables[j]))], [sum(hh[r][c] for r in rows_) for c in range(len(tables[j]))], 1)
                for r in rows_:
                    out[r] = values
        return gg, hh, out

    def worth(pair):
        gg, hh, v = grid(*pair)
        return sum(g * z + 0.5 * h * z * z for gr, hr, vr in zip(gg, hh, v) for g, h, z in zip(gr, hr, vr))

    pairs = sorted(itertools.combinations(range(width), 2), key=worth)[: gam.PAIRS]
    for _ in range(gam.PAIR_ROUNDS):
        for i, j in pairs:
            step = grid(i, j)[2]
            raw = [z + gam.RATE * step[b[i]][b[j]] for z, b in zip(raw, bins)]
    return pairs, [1 / (1 + math.exp(-z)) for z in raw]


def test_training_matches_plain_python(monkeypatch):
    for name, value in (("ROUNDS", 6), ("PAIR_ROUNDS", 4), ("PAIRS", 3), ("BINS", 8)):
        monkeypatch.setattr(gam, name, value)
    r = random.Random(11)
    x = [[r.gauss(k % 3, 1 + k / 5) for k in range(len(gam.FEATURES))] for _ in range(90)]
    y = [float(a[0] + a[1] * a[2] + 0.3 * r.gauss(0, 1) > 1.5) for a in x]
    pairs, want = slow_train(x, y)
    model = gam.train(np.array(x), np.array(y))
    assert model.pairs == pairs and max(abs(a - b) for a, b in zip(model.score(np.array(x)), want)) < 1e-9
