import random

import numpy as np
from tests.llm.helpers import docs
from twinseek.llm import suffix_dedup as sd


def brute(data):
    texts = [(d, (t or "").encode()) for d, t, *_ in data]
    first = {}
    for d, t in texts:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            first[w] = min(first.get(w, sd.LAST), sd.LAST if d is None else d)
    out = []
    for d, t in texts:
        me, gone = sd.LAST if d is None else d, [False] * len(t)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < me:
                gone[i : i + 50] = [True] * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((d, len(t), kept, spans))
    return sorted(out, key=str)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "é", "ünder", "thing", "x1", "longerword"]) + r.choice(["", "", "a", "st", str(r.randrange(99))])
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(30) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [text(r.randrange(0, 60))]
        if i % 2:
            p = r.choice(passages)
            a = r.randrange(20)
            parts += [p if i % 4 == 1 else p[a : a + 49 + r.randrange(4)], text(r.randrange(20))]
        if i % 7 == 3:
            parts = [out[r.randrange(len(out))][1][r.randrange(5) :], text(3)]
        out.append((i, " ".join(parts), "en", None, None))
    return out


def check(spark, data):
    got = sd.remove_repeats(docs(spark, data).withColumnRenamed("n_chars", "kept")).collect()
    mine = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.starts)) for r in got), key=str)
    assert mine == brute(data)
    for r in got:
        assert all(a < b for a, b in zip(r.starts, r.ends)) and sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_bytes - len(r.kept)


def test_matches_brute_force(spark):
    odd = [(100, None, None, None, None), (101, "", None, None, None), (102, "short", None, None, None), (103, "ab" * 400, None, None, None), (104, "ba" * 300 + "z", None, None, None)]
    odd += [(105, "z" * 49, None, None, None), (106, "z" * 50, None, None, None), (107, "z" * 51, None, None, None), (106, "z" * 300, None, None, None), (None, "z" * 60 + " null id " * 20, None, None, None), (None, " null id " * 30, None, None, None)]
    check(spark, made(1) + odd)


def test_popular_names_go_by_window(spark, monkeypatch):
    monkeypatch.setattr(sd, "FEW", 3)
    monkeypatch.setattr(sd, "POPULAR", 4)
    check(spark, made(2) + [(200 + i, "a popular passage that very many documents share, word by word, " + str(i) * 3, "en", None, None) for i in range(9)])


def test_a_passage_of_a_thousand_documents(spark, monkeypatch):
    """Many chunks, and a name with over POPULAR different runs: the passage stands between different words everywhere."""
    monkeypatch.setattr(sd, "CHUNK", 4000)
    r = random.Random(4)
    data = [(i if i % 3 else 5, f"{r.random()} the passage that so many documents have in common, {r.random()} {i}", "en", None, None) for i in range(1000)]
    seen, names = [], sd.Chunk.names
    monkeypatch.setattr(sd.Chunk, "names", lambda self: seen.append(names(self)) or seen[-1])
    chunk = sd.Chunk(np.arange(1000), [d[1].encode() for d in data])
    assert (chunk.names()[1] == 3).any()
    check(spark, data)


def test_hash_collisions_are_found(spark):
    chunk = sd.Chunk(np.array([1, 2, 3]), [b"a" * 50, b"b" * 50, b"a" * 50])
    same = np.zeros(3, sd.U)  # as if all runs had one hash
    got = sd.Pieces(chunk, chunk.start, chunk.count, chunk.doc, same, same, 4)
    assert got.cls[0] == got.cls[2] != got.cls[1] and got.least[got.cls].tolist() == [1, 2, 1]


def test_greatest_id(spark):
    top = (1 << 63) - 1
    check(spark, [(top, "x" * 80, None, None, None), (None, "x" * 90, None, None, None), (-top - 1, "y" * 70, None, None, None), (top, "y" * 60, None, None, None)])


def test_block_edges(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 300)
    check(spark, made(3, 40))


def test_empty_table(spark):
    assert sd.remove_repeats(docs(spark, [])).collect() == []


def test_suffix_sort():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    at = r.choice(3900, 900, replace=False)
    group = np.sort(r.integers(0, 9, 900))
    order, equal = sd.sort_suffixes(sd.Hashes(data), data, at, group)
    key = [(group[i], data[at[i] : at[i] + 50].tobytes()) for i in order]
    assert key == sorted(key) and [bool(e) for e in equal] == [False, *(a == b for a, b in zip(key, key[1:]))]
