import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests.llm.helpers import docs
from tests.llm.test_mixing import slow_targets
from tests.llm.test_simhash import slow_fingerprint
from twinseek.llm import pii
from twinseek.llm import quality_rules as q


def made():
    r = random.Random(8)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma"]) + str(r.randrange(300)) for _ in range(n))
    out = []
    for i in range(60):
        t = words(r.randrange(40, 200)) + (f" mail a{i}@b.org now" if i % 5 == 0 else "")
        out.append((i, t, "en", f"s{i % 3}", len(t)))
    out += [(100 + i, out[i][1], "en", "s0", None) for i in range(8)] + [(5, out[5][1], "en", "s2", 1), (5, words(80), "en", "s2", 1), (200, None, None, None, None), (201, "", "en", None, 0), (202, "hash### " * 90, "en", "s1", 0), (None, words(70), "en", "s1", 0)]
    return out


def folder(spark, data, tmp_path):
    docs(spark, data).withColumns({"kept": F.lit("clash"), "spans": F.lit(1), "a.b": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_match_plain_python(spark, tmp_path):
    data = made()
    d = folder(spark, data, tmp_path)
    df, steps = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        then = stage(spark, df, d)
        if name != "packing":
            assert then.columns == df.columns and then.dtypes == df.dtypes
        then.write.parquet(f"{tmp_path}/{name}")
        steps[name] = (df, spark.read.parquet(f"{tmp_path}/{name}"))
        df = steps[name][1]
    rows = lambda x: sorted(((r.doc_id, r.text) for r in x.collect()), key=str)

    before, after = steps["quality_rules"]
    verdict = q.judge(before.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")).where("kept")
    kept = {i for i, _ in rows(after)}
    assert rows(after) == rows(verdict) and 202 not in kept and {i for i, t, *_ in data if i is not None and i < 60 and len(t.split()) >= 50} <= kept

    before, after = map(rows, steps["simhash_dedup"])
    have = [(i, t, slow_fingerprint(t)) for i, t in before]
    group = {k: k for k in range(len(have))}
    for _ in have:
        for a in group:
            for b in group:
                if bin(have[a][2] ^ have[b][2]).count("1") <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    members = defaultdict(set)
    for k, g in group.items():
        members[g].add(have[k][0])
    assert [i for i, _ in after] == sorted((min(m, key=lambda i: (i is None, i)) for m in members.values()), key=str)
    assert set(after) <= set(before) and sum(i is None for i, _ in after) == 1

    before, after = map(rows, steps["pii"])
    assert [i for i, _ in before] == [i for i, _ in after]
    for (_, a), (_, b) in zip(before, after):
        assert "@b.org" not in b and b.count("[EMAIL]") == a.count("@b.org") and (("@" in a) or a == b)
    assert pii.detect(steps["pii"][1]).where("size(base) > 0").count() == 0

    before, after = map(rows, steps["mixing"])
    source = {r.doc_id: r.source for r in steps["mixing"][0].collect()}
    sizes, taken, n = defaultdict(int), defaultdict(int), Counter(after)
    for i, t in before:
        sizes[source[i]] += len(t.split())
        assert n[(i, t)] <= 3
    for i, t in after:
        taken[source[i]] += len(t.split())
    want = slow_targets(dict(sizes))
    assert set(after) <= set(before) and all(abs(taken[s] - want[s]) <= 20 for s in sizes)

    before, after = steps["packing"]
    assert after.where("start = 0").count() == before.count()


def test_whole_run_and_empty_table(spark, tmp_path):
    d = folder(spark, made()[:20], tmp_path / "a")
    assert cp.run(spark, d).count() > 0
    assert cp.run(spark, folder(spark, [], tmp_path / "b")).count() == 0
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None


def test_no_other_columns(spark, tmp_path):
    d = folder(spark, made()[:20], tmp_path)
    spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/plain")
    df = spark.read.parquet(f"{tmp_path}/plain")
    for name, stage in cp.STAGES[1:4]:
        then = stage(spark, df, d)
        assert then.columns == df.columns
        then.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
    assert df.count() > 0


def test_edited_copies_are_near_duplicates(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(300)]
    copies = [words, [*words[:100], "x", *words[101:]], [w if i % 50 != 20 else f"y{i}" for i, w in enumerate(words)]]
    other = [w if i % 10 else "o" for i, w in enumerate(words)]  # of half the shingles
    data = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([*copies, other])]
    assert bin(slow_fingerprint(data[0][1]) ^ slow_fingerprint(data[2][1])).count("1") > 2
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs(spark, data), "").collect()) == [0, 3]
