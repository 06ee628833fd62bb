import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import docs, rows
from twinseek.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(data):
    fps = [(d, slow_fingerprint(t)) for d, t, *_ in data]
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if comp[j] > comp[i] and bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                    comp[j] = comp[i]
                    changed = True
    least = {}
    for (d, _), c in zip(fps, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, f, least.get(c)) for (d, f), c in zip(fps, comp)), key=str)


def test_matches_brute_force(spark):
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "DÉLTA", "eps", "zeta", "eta", "theta"]
    texts = [None, "", " \t\n", "one", "one two", "One\xa0two three", "x " * 30000]
    for _ in range(60):
        base = [r.choice(words) + str(r.randrange(40)) for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(r.randrange(3)):
            base[r.randrange(len(base))] = "changed"
            texts.append("  ".join(base))
    texts += texts[7:12] * 5
    data = rows(texts) + [(3, "repeated id", None, None, None), (3, "repeated id", None, None, None), (None, "no id", "en", "s", 1)]
    df = docs(spark, data).withColumnRenamed("n_chars", "fp")
    got = simhash.near_duplicates(df).collect()
    mask = (1 << 64) - 1
    assert sorted(((x.doc_id, x.fp & mask, x.component_id) for x in got), key=str) == brute(data)


def test_links_of_a_long_chain(spark):
    fps = [(1 << i) - 1 for i in range(40)]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    scratch = simhash.Scratch(spark)
    got = simhash.components(simhash.ball_links(nodes), scratch).collect()
    assert {x.root for x in got} == {0} and len(got) == 39


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def slow_similar(data):
    sets = []
    for _, t, *_ in data:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    comp, changed = list(range(len(data))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if comp[j] > comp[i] and like(a, b):
                    comp[j], changed = comp[i], True
    return sorted((d[0], min(e[0] for e, k in zip(data, comp) if k == c)) for d, c in zip(data, comp))


def edited(seed=5):
    """Texts, near copies of them with one to twelve words changed, and one group of many near copies."""
    r = random.Random(seed)
    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for k in range(40):
        base = [r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(r.choice([60, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(40 if k == 0 else r.randrange(3)):
            copy = list(base)
            for _ in range(r.randrange(1, 13)):
                copy[r.randrange(len(copy))] = "changed" + str(r.randrange(99))
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return rows(texts + texts[:5])


def test_similar_documents_match_brute_force(spark):
    data = edited()
    got = simhash.similar_documents(docs(spark, data), 5, 0.8).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == slow_similar(data)
    assert simhash.similar_documents(docs(spark, []), 5, 0.8).collect() == []


def test_edited_copies_are_found_by_balls(spark, monkeypatch):
    """Without any MinHash band the fingerprints' balls must link what lies within their radius."""
    monkeypatch.setattr(simhash, "bands", lambda shingles: [])
    words = [f"w{i * 7919 % 1000}" for i in range(300)]
    copies = [words, [*words[:100], "x", *words[101:]], [w if i % 50 != 20 else f"y{i}" for i, w in enumerate(words)]]
    other = [w if i % 10 else "o" for i, w in enumerate(words)]
    data = rows([" ".join(w) for w in [*copies, other]])
    fps = [simhash.set_fingerprint(simhash.shingle_set(t.encode(), 5)) for _, t, *_ in data]
    assert all(2 < bin(fps[0] ^ f).count("1") <= simhash.WIDE_RADIUS or f == fps[0] for f in fps[:3])
    got = simhash.similar_documents(docs(spark, data), 5, 0.8).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_wide_links_match_brute_force(spark):
    """Pairs of every distance around the radius, a crowd that shares its variants, and equal fingerprints of different texts."""
    r = random.Random(9)
    flip = lambda f, k: f ^ sum(1 << b for b in r.sample(range(64), k))
    sims = [0, (1 << 64) - 1, 1 << 63]
    for k in range(300):
        sims.append(r.getrandbits(64))
        sims.append(flip(sims[-1], k % 16))
    crowd = r.getrandbits(64)
    sims += [flip(crowd, r.randrange(9)) for _ in range(300)] + [crowd] * 3
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = [(k, r.choice([100, 100, 100, 60]), signed(f)) for k, f in enumerate(sims)] + [(9999, 0, 0)]
    like = lambda a, b: bin((a[2] ^ b[2]) & ((1 << 64) - 1)).count("1") <= radius and min(a[1], b[1]) >= 0.8 * max(a[1], b[1])

    def classes(pairs):
        of = {f: f for f, *_ in nodes}
        for a, b in pairs:
            if of[a] != of[b]:
                gone, stay = of[a], of[b]
                of = {f: stay if g == gone else g for f, g in of.items()}
        least = {}
        for f in sorted(of):
            least.setdefault(of[f], f)
        return {f: least[g] for f, g in of.items()}

    for radius in (simhash.WIDE_RADIUS, 7):
        want = classes((a[0], b[0]) for k, a in enumerate(nodes[:-1]) for b in nodes[:k] if like(a, b))
        table = spark.createDataFrame(nodes, "fp long, n long, sim long")
        found = [tuple(x) for x in simhash.wide_links(table, radius, 0.8).collect()]
        assert classes(found) == want and all(like(nodes[a], nodes[b]) for a, b in found)
    assert simhash.wide_links(table.where("false"), 11, 0.8).collect() == []


def test_keys_are_never_parted():
    import pyarrow as pa

    r = random.Random(2)
    keys = sorted(r.choice([1, 2, 3, 3, 3, 3, 9, *range(20, 40)]) for _ in range(200))
    for size in (1, 3, 50, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(range(i, min(200, i + size)))], ["key", "row"]) for i in range(0, 200, size)]
        got = [(k.tolist(), v.tolist()) for k, v in simhash._whole_keys(iter(batches))]
        assert sum((v for _, v in got), []) == list(range(200)) and sum((k for k, _ in got), []) == keys
        assert all(a[0][-1] < b[0][0] for a, b in zip(got, got[1:]))


def test_no_pair_of_a_large_bucket_is_lost(spark, monkeypatch):
    """One bucket for all texts, and predecessors that are mostly of other groups: the rest finds what they miss."""
    monkeypatch.setattr(simhash, "NEIGHBOURS", 1)
    two = lambda shingles: [7, int(len(shingles)) % 3] if len(shingles) else []
    monkeypatch.setattr(simhash, "bands", two)
    data = edited(11)
    want = slow_similar(data)
    found = lambda: sorted((x.doc_id, x.component_id) for x in simhash.similar_documents(docs(spark, data), 5, 0.8).collect())
    assert found() == want
    monkeypatch.setattr(simhash, "BLOCK_DOCS", 9)
    assert found() == want


def test_sets_are_linked_as_by_brute_force():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 400, 60)).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.where(r.random(len(b)) < 0.06, 1000 + k, b)) for k, b in enumerate(base * 9)]
    before, parts = r.integers(0, 12, (len(sets), 2)), r.integers(0, 2, len(sets))
    for parts_ in (None, parts):
        label = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if simhash.jaccard(sets[i], sets[j]) >= 0.8 and not (before[i] == before[j]).any() and (parts_ is None or parts_[i] != parts_[j]):
                    label[label == label[i]] = label[j]
        links, mine = simhash.link_sets(sets, np.arange(len(sets)), 0.8, before, parts_), np.arange(len(sets))
        for i, j in links:
            assert simhash.jaccard(sets[i], sets[j]) >= 0.8
            mine[mine == mine[i]] = mine[j]
        assert len(set(zip(label.tolist(), mine.tolist()))) == len(set(label.tolist())) == len(set(mine.tolist())) and len(links) > 10


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    data = [(None, long, "en", "z", 1), (9, long, "fr", "a", 2), (9, long, "de", "a", 3), (12, long + " end", "en", None, 4), (None, "alone", None, None, 5), (None, "alone", None, None, 6), (3, None, None, None, None), (4, "", None, None, None)]
    every = docs(spark, data).withColumns({"n": F.lit("n"), "band": F.lit(1), "o": F.map_from_arrays(F.array(F.lit("k")), F.array("n_chars"))})
    kept = simhash.first_of_groups(every, 5, 0.8)
    got = sorted(map(tuple, kept.select(data and ["doc_id", "text", "n_chars"]).collect()), key=str)
    again = sorted(map(tuple, simhash.first_of_groups(every.orderBy(F.col("n_chars").desc()), 5, 0.8).select("doc_id", "text", "n_chars").collect()), key=str)
    assert kept.columns == every.columns and got == again and [g[:2] for g in got] == [(3, None), (9, long), (None, "alone")]
    assert simhash.first_of_groups(every.where("false"), 5, 0.8).collect() == []
