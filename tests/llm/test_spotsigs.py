import hashlib
import random
import re

from pyspark.sql import functions as F
from tests.llm.helpers import docs, rows
from twinseek.llm import registry, spotsigs

STOP = set(spotsigs.ANCHORS.split())


def slow_spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if x not in STOP][:2] if w in STOP else []
        if rest:
            out.add((w, *rest, "")[:3])
    return out or set(words) or ({text} if text else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(spark, data, tmp_path):
    docs(spark, data).withColumnRenamed("n_chars", "block").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op3_spot_signatures(spark, str(tmp_path)).collect()
    order = sorted(((d[0], d[1] or "") for d in data), key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = slow_spots(t), slow_spots(edited), slow_spots(after)
        near = [jaccard(a, x) for x in (b, c)]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(round(x, 9) for x in near)))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)
    prints = {}
    for r in got:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)


def test_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 8)
    r = random.Random(3)
    vocabulary = [*list(STOP)[:12], "Thing", "alpha", "ünder", "x1", "42", "gamma", "delta"] + [f"w{i}" for i in range(60)]
    texts = [None, "", "###", "no anchors here", "the", "the the", "The end", "word " * 20000, "the cat " * 9000, "\U0001f600" * 9]
    texts += [" ".join(r.choice(vocabulary) + r.choice(["", "", ", ", ".\n"]) for _ in range(r.randrange(1, 150))) for _ in range(230)]
    data = rows(texts[:120]) + rows(texts[120:], first=90000) + [(7, "the same id twice", None, None, None), (7, "the same id twice", None, None, None), (None, "the null id row", None, None, None)]
    check(spark, data, tmp_path)


def test_one_document(spark, tmp_path):
    check(spark, [(5, "the only document of all", None, None, None)], tmp_path)


def test_empty_table(spark, tmp_path):
    check(spark, [], tmp_path)


def test_ids_anywhere(spark, tmp_path, monkeypatch):
    """Ids at both ends of long, far from all others, shared by many rows, or missing, and columns with clashing names."""
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 8)
    r = random.Random(6)
    text = lambda: " ".join(r.choice(["the", "of", "a1", "b2", "c3", "d4"]) for _ in range(12))
    ids = [-(1 << 63), (1 << 63) - 1, 1 << 50, *range(60), *[77] * 40, *[None] * 30]
    check(spark, [(i, text(), None, None, None) for i in ids], tmp_path)


def test_blocks_hold_about_as_many_rows_each(spark):
    data = [(i, "x", None, None, None) for i in [*range(5000), 1 << 50, -(1 << 60)]] + [(None, f"{i:05d}", None, None, None) for i in range(5000)]
    rows_ = docs(spark, data).select("doc_id", "text")
    n = [r["count"] for r in rows_.groupBy(spotsigs.blocks(rows_).alias("b")).count().collect()]
    assert max(n) <= 3 * spotsigs.BLOCK_ROWS and len(n) >= 20


def test_texts_are_shuffled_once(spark, tmp_path):
    docs(spark, rows([f"the text {i}" for i in range(900)])).write.parquet(f"{tmp_path}/documents.parquet")
    plan = registry.op3_spot_signatures(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and len(set(re.findall(r"Exchange hashpartitioning\(block#\d+, \d+\), REPARTITION", re.sub(r"#\d+", "#0", plan)))) == 1
    assert "WindowGroupLimit" not in plan and "isnotnull(block" not in plan


def test_partitions_keep_similar_sets_together(spark):
    df = spark.range(1, 400).select(spotsigs.length_partition(F.col("id"), 0.8).alias("p"), "id")
    p = {r.id: r.p for r in df.collect()}
    assert all(abs(p[a] - p[b]) <= 1 for a in p for b in range(a, min(400, int(a / 0.8) + 1)))


def test_similarity_join_matches_brute_force(spark):
    r = random.Random(9)
    base = [" ".join(f"the w{r.randrange(400)} x{r.randrange(400)}" for _ in range(40)) for _ in range(12)]
    texts = base + [b.replace("the w1", "the v1", k % 3 + 1) for k, b in enumerate(base * 3)] + base[:4] + ["", None, "the only one"]
    data = rows(texts) + [(None, base[0], None, None, None)]
    members, pairs = spotsigs.similar(docs(spark, data), 0.8)
    sets = {d: frozenset(slow_spots(t or "")) for d, t, *_ in data if d is not None}
    least = {}
    for d, s in sorted(sets.items()):
        least.setdefault(s, d)
    assert {x.doc_id: x.class_id for x in members.collect()} == {d: least[s] for d, s in sets.items()}
    classes = [(d, s) for s, d in least.items() if s]
    want = {(min(a, b), max(a, b)) for a, s in classes for b, t in classes if a != b and jaccard(s, t) >= 0.8}
    got = pairs.collect()
    assert want and {(x.a, x.b) for x in got} == want and all(abs(x.likeness - jaccard(sets[x.a], sets[x.b])) < 1e-9 for x in got)
