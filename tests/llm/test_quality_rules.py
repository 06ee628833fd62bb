import random
import re
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.helpers import docs, rows
from twinseek.llm import quality_rules as q
from twinseek.llm import registry
from twinseek.llm.common import where_computed

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = SPLIT.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(6)
    vocabulary = ["the", "cat", "Sat", "mat", "x#", "|", "dog.", "é", "12", "ROW!!"]
    out = [None, "", " \n\t", "one", "one two", "a b c a b c", "x y z " * 5000, "l\nl\n l\nl\n\n\n", "nbsp\xa0one\x85two\x1ctwo", "\U0001f600 # # #"]
    return out + [" ".join(r.choice(vocabulary) + r.choice(["", "", "\n"]) for _ in range(r.randrange(1, 200))) for _ in range(80)]


def test_counts_and_ratio_match_brute_force(spark):
    data = rows(texts()) + [(4, "same id", None, None, None), (None, "no id", None, None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (41, None, None), (999, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, data).withColumnRenamed("n_chars", "bucket").withColumns({"kept": F.lit("clash"), "llr": F.lit("clash"), "good": F.lit(1), "quality": F.lit(9)})
    got = q.judge(df, labels).collect()
    assert len(got) == len(data)
    # The hashes are taken from Spark; what is counted and summed is plain Python.
    words = sorted({w for _, t, *_ in data for w in SPLIT.findall(t or "")})
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    both = lambda t: [(one.get(a, 0), one[b]) for w in [SPLIT.findall(t or "")] for a, b in zip([None, *w], w)]
    two = spark.createDataFrame(sorted({p for _, t, *_ in data for p in both(t)}), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"))
    two = {(r.a, r.b): r.h for r in two.collect()}
    grams = lambda t: [h % q.BUCKETS for h in [*(one[w] for w in SPLIT.findall(t or "")), *(two[p] for p in both(t))]]
    raw, good = Counter(), Counter()
    trusted = {i for i in range(40) if i % 2} | {1, 999}
    for d, t, *_ in data:
        raw.update(grams(t))
        if d in trusted:
            good.update(grams(t))
    import math

    def llr(t):
        n, m = sum(raw.values()), sum(good.values())
        share = {b: raw[b] / n for b in grams(t)}
        return sum(math.log((good[b] + q.PRIOR * share[b]) / (m + q.PRIOR)) - math.log(share[b]) for b in grams(t)) / len(grams(t)) if grams(t) else 0.0

    want = []
    for d, t, *_ in data:
        c = slow_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((d, *c, failed, not failed and llr(t) >= q.THRESHOLD, round(llr(t), 3)))
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.llr, 3)) for r in got]
    key = lambda r: str(r[:-1])
    for a, b in zip(sorted(mine, key=key), sorted(want, key=key)):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 0.002
    assert where_computed(q.judge(df, labels), F.col("kept")).count() == sum(r[-2] for r in want)


def test_vocabulary_decides(spark):
    """Documents of the same shapes differ in their words alone."""
    r = random.Random(2)
    say = lambda stem: " ".join(stem + r.choice("abcdefghijklmnopqrst") + r.choice("uvwxyz") for _ in range(400))
    df = docs(spark, [(i, say("lorem" if i % 4 else "junko"), None, None, None) for i in range(400)])
    labels = df.where("doc_id % 4 > 0 and doc_id % 3 = 0").selectExpr("doc_id", "1 as quality")
    got = q.judge(df, labels).collect()
    assert all(x.kept == bool(x.doc_id % 4) and not x.base_failed for x in got)


def test_nothing_to_trust_and_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.op6_ngram_ratio(spark, str(tmp_path)).collect() == []
    data = docs(spark, rows(["w%d " % i * 1 + " ".join(f"x{i}y{k}" for k in range(60)) for i in range(4)]))
    assert {(r.kept, r.llr) for r in q.judge(data, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()} == {(True, 0.0)}
