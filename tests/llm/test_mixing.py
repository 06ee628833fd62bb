import random
from collections import defaultdict
from fractions import Fraction

from tests.llm.helpers import docs
from twinseek.llm import mixing, registry


def slow_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * w[s] / max(1, sum(w[x] for x in names if x not in full)) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in names}
        full |= over


def made(n=3000, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = 0 if i % 97 == 0 else r.choice([1, 5, 40, 300])
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{r.randrange(6)}"
        out.append((i, " ".join(["w"] * words) if words else [None, "", " \n"][i % 3], "en", source, None))
    out.append((n, "tiny source", None, "a-first", None))
    return out + [(5, "again", "en", "hot", 1)] * 3 + [(None, "no id here", "en", "hot", 1)]


def run(spark, data):
    got = mixing.mix(docs(spark, data).withColumnRenamed("n_chars", "part")).collect()
    out = []
    for r in got:
        out += [(r.doc_id, r.source, r.size, r.source_size, r.target, r.copies)] * r.copies_of_row
    return out


def test_targets_and_conservation(spark):
    data = made()
    got = run(spark, data)
    assert sorted((r[0] if r[0] is not None else -1 for r in got)) == sorted(d[0] if d[0] is not None else -1 for d in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in data:
        n = len((d[1] or "").split())
        sizes[d[3]] += n
    want = slow_targets(dict(sizes))
    for _, s, size, source_size, target, copies in got:
        assert source_size == sizes[s] and abs(target - want[s]) < 1e-6 and 0 <= copies <= 3
        taken[s] += size * copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2
    assert sorted(got, key=str) == sorted(run(spark, data[::-1]), key=str)


def test_expected_copies_are_kept():
    n, parts, masses = 4000, [0.3, 0.5, 0.9, 0.2, 0.7], [3.0, 10.0, 4.0, 7.0, 5.0]
    sums = [0.0] * 5
    for t in range(n):
        p = parts[:]
        held = mixing.pivot(p, masses, [hash((t, k)) & (1 << 63) - 1 for k in range(5)], 0)
        assert abs(sum(a * b for a, b in zip(p, masses)) - sum(a * b for a, b in zip(parts, masses))) < 1e-9
        assert sum(0 < x < 1 for x in p) <= 1 and (held is None) == all(x in (0, 1) for x in p)
        sums = [a + b for a, b in zip(sums, p)]
    assert all(abs(s / n - p) < 0.03 for s, p in zip(sums, parts))


def slow_settle(parts, masses, keys, level):
    """The root's rounding with exact numbers: pairs from the largest down, then the miss made up."""
    p, first = [Fraction(x) for x in parts], [Fraction(x) for x in parts]
    held = None
    for k in sorted(range(len(p)), key=lambda k: (-masses[k], keys[k])):
        if p[k].denominator == 1:
            continue
        if held is None:
            held = k
            continue
        up = min((1 - p[held]) * masses[held], p[k] * masses[k])
        down = min(p[held] * masses[held], (1 - p[k]) * masses[k])
        moved = up if Fraction(mixing.uniform(keys[held] ^ keys[k], level)) * (up + down) < down else -down
        p[held] += moved / masses[held]
        p[k] -= moved / masses[k]
        held = next((i for i in (held, k) if p[i].denominator != 1), None)
    if held is None:
        return p
    able, found = [k for k in range(len(p)) if first[k].denominator != 1], []
    for end in (round(p[held]), 1 - round(p[held])):
        q = [Fraction(end) if k == held else x for k, x in enumerate(p)]
        miss = sum((a - b) * m for a, b, m in zip(q, first, masses))
        for k in sorted(able, key=lambda k: (-masses[k], -k)):
            turned = masses[k] * (1 - 2 * q[k])
            if turned * miss < 0 and abs(turned) <= abs(miss):
                q[k], miss = 1 - q[k], miss + turned
        while True:
            ways = [(k,) for k in able] + [(i, j) for i in able for j in able if q[i] == 0 and q[j] == 1]
            rest, way = min((abs(miss + sum(masses[k] * (1 - 2 * q[k]) for k in w)), w) for w in ways)
            if rest >= abs(miss):
                break
            miss += sum(masses[k] * (1 - 2 * q[k]) for k in way)
            q = [1 - x if k in way else x for k, x in enumerate(q)]
        found.append((abs(miss), q))
    return min(found, key=lambda x: x[0])[1]


def test_the_roots_rounding_matches_exact_arithmetic():
    r = random.Random(8)
    for n in (1, 2, 3, 10, 60):
        parts = [r.choice([0.0, 0.25, 0.375, 0.75]) for _ in range(n)]
        masses, keys = [Fraction(x) for x in r.sample(range(1, 6000), n)], [r.getrandbits(60) for _ in range(n)]
        want, got = slow_settle(parts, masses, keys, 1), parts[:]
        masses = list(map(float, masses))
        assert all(mixing.settle(got, masses, keys, 1, True)) and got == [float(x) for x in want]


def test_a_long_document_left_to_the_end_is_made_up():
    """One unit outweighs the others; its fraction lasts to the root."""
    r, n = random.Random(3), 400
    masses, parts = [9000.0] + [float(r.randrange(1, 60)) for _ in range(n)], [0.45] * (n + 1)
    done = mixing.settle(parts, masses, [r.getrandbits(60) for _ in range(n + 1)], 0, True)
    assert all(done) and abs(sum(p * m for p, m in zip(parts, masses)) - 0.45 * sum(masses)) <= 1
    kept = [0.45] * (n + 1)
    done = mixing.settle(kept, masses, list(range(n + 1)), 0, False)
    assert 1 < done.count(False) <= mixing.CHANGE * 14 + 1 and all(kept[k] in (0, 1) for k in range(n + 1) if done[k])
    assert abs(sum(p * m for p, m in zip(kept, masses)) - 0.45 * sum(masses)) < 1e-6


def test_many_sources():
    sizes = {f"s{i}": (i * 7919) % 1000 for i in range(30000)}
    assert abs(sum(mixing.targets(sizes).values()) - sum(sizes.values())) < 1e-3


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 20)
    monkeypatch.setattr(mixing, "FAN", 4)
    data = made(1200)
    taken, want = defaultdict(int), {}
    for _, s, size, _, target, copies in run(spark, data):
        taken[s] += size * copies
        want[s] = target
    assert max(abs(taken[s] - want[s]) for s in want) <= 5


def test_empty_and_wordless(spark):
    assert run(spark, []) == []
    assert {r[4:] for r in run(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])} == {(0.0, 0)}


def test_query_keeps_every_row(spark, tmp_path):
    docs(spark, made(300)).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op4_pivotal_mix(spark, str(tmp_path))
    assert got.count() == 305 and got.where("taken > 3 * size").count() == 0
