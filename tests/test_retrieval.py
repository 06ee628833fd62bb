import math
import random

import pytest
from pyspark.sql import functions as F

from twinseek.functions import text as T
from twinseek.operators import canonical, evalset, fusion, graph, introspect, lexical, matching, metrics, vector
from twinseek.plans.engine import Engine, Side


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def fruit(spark):
    return lexical.build(frame(spark, [("d1", "red apple red"), ("d2", "green apple"), ("d3", "blue sky")], "doc_id string, text string"))


def test_bm25_by_hand(spark, fruit):
    q = frame(spark, [("q", "red apple")], "qid string, text string")
    got = {r.doc_id: (round(r.score, 6), r["rank"]) for r in lexical.search(fruit, q).collect()}
    assert got == {"d1": (0.679915, 1), "d2": (0.200918, 2), "d3": (0.0, 3)}
    assert {r.doc_id for r in lexical.search(fruit, q, pad_zero=False).collect()} == {"d1", "d2"}
    twice = lexical.search(fruit, frame(spark, [("q", "red red")], "qid string, text string"), 1).first()
    assert abs(twice.score - 2 * 0.980829 * 0.523364) < 2e-6


def test_index_of_few_or_many_terms(spark, fruit, monkeypatch):
    docs = frame(spark, [("d1", "red apple red"), ("d2", "green apple"), ("d3", "blue sky")], "doc_id string, text string")
    q = frame(spark, [("q", "red apple")], "qid string, text string")
    rows = lambda i: sorted(map(tuple, lexical.search(i, q).collect()))
    want = rows(fruit)
    assert rows(lexical.build(docs, q)) == want
    monkeypatch.setattr(lexical, "MOST_TERMS", 1)
    assert rows(lexical.build(docs, q)) == want


def test_index_survives_saving(spark, fruit, tmp_path):
    fruit.save(str(tmp_path))
    q = frame(spark, [("q", "apple sky")], "qid string, text string")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in lexical.search(i, q).collect()) for i in (fruit, lexical.load(spark, str(tmp_path))))
    assert a == b


def test_cosine_blocks_match_the_expression(spark, monkeypatch):
    r = random.Random(1)
    rows = [(f"v{i:03d}", [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [("null", None), ("zero", [0.0] * 8), ("twin", None)]
    rows[-1] = ("twin", rows[0][1])
    df = frame(spark, rows, "doc_id string, vec array<float>")
    q = df.where("doc_id < 'v010' and vec is not null").select(F.col("doc_id").alias("qid"), "vec")
    monkeypatch.setattr(vector, "BLOCK_VALUES", 24)
    got = {(x.qid, x.doc_id): (round(x.score, 9), x["rank"]) for x in vector.search(df, q, 5).collect()}
    every = q.join(df.where("vec is not null").withColumnRenamed("vec", "w")).select("qid", "doc_id", F.round(vector.cosine(F.col("vec"), F.col("w")), 9).alias("s")).collect()
    for name in {x.qid for x in every}:
        best = sorted(((-x.s, x.doc_id) for x in every if x.qid == name))[:5]
        assert [got[(name, d)] for _, d in best] == [(pytest.approx(-s, abs=1e-8), i + 1) for i, (s, d) in enumerate(best)]


EDGES = [("person_1", "python", "core", 5), ("person_1", "python", "secondary", 2), ("person_1", "sql", "soft", 4), ("person_2", "sql", "core", 1), ("person_3", "python", "other", None)]


def test_graph_scores_by_hand(spark):
    edges = frame(spark, EDGES, "person_id string, skill_id string, category string, proficiency int")
    ask = lambda *s: frame(spark, [("q", i, x) for i, x in enumerate(s)], "qid string, pos int, skill_id string")
    got = [(r.doc_id, r.score, r.overlap) for r in graph.persons(ask("python", "sql"), edges).orderBy("rank").collect()]
    assert got == [("person_1", 20.0, 2), ("person_2", 3.0, 1), ("person_3", 1.0, 1)]
    assert graph.persons(ask("python", "python"), edges).first()[2:4] == (36.0, 1)
    jobs = frame(spark, [("job_1", "python", "must_have"), ("job_1", "sql", "good_to_have"), ("job_2", "sql", "must_have")], "job_id string, skill_id string, priority string")
    assert [(r.doc_id, r.score, r.overlap) for r in graph.jobs(ask("python", "sql"), jobs).orderBy("rank").collect()] == [("job_1", 4.0, 2), ("job_2", 3.0, 1)]
    assert graph.persons(ask("python", "sql"), edges, min_overlap=2).count() == 1


def test_best_matches_are_those_of_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    some = lambda n: sorted(r.sample(range(12), n))
    left = [(i, some(r.randint(0, 6))) for i in range(60)] + [(60, [99])]
    right = [(f"j{i}", some(r.randint(0, 4))) for i in range(150)] + [("j150", [77])]
    want = set()
    for i, a in left:
        all_ = sorted((-round(len({*a} & {*b}) / len({*a} | {*b}), 9), j) for j, b in right if {*a} & {*b})
        want |= {(i, j, -s) for s, j in all_[:3]}
    frames = frame(spark, left, "id long, items array<long>"), frame(spark, right, "id string, items array<long>")
    for block, tile in ((1 << 20, 1 << 10), (40, 7)):
        monkeypatch.setattr(matching, "BLOCK_SETS", block)
        monkeypatch.setattr(matching, "TILE_SETS", tile)
        assert {(x.left, x.right, round(x.score, 9)) for x in matching.best(*frames, 3).collect()} == want


def test_equal_queries_are_answered_once(spark):
    """Rows that meet grow with different queries, not with queries."""
    edges = frame(spark, [(f"job_{i}", s, "must_have") for i in range(50) for s in ("a", "b")], "job_id string, skill_id string, priority string")
    asked = frame(spark, [(f"q{i}", 0, "a") for i in range(40)] + [("z", 0, "a"), ("z", 1, "a"), ("y", 0, "b")], "qid string, pos int, skill_id string")
    made = []

    def overlap(asked, *more, f=graph.overlap):
        made.append((out := f(asked, *more)).count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(graph, "overlap", overlap)
        got = {(r.qid, r.doc_id, r.score, r.overlap, r["rank"]) for r in graph.jobs(asked, edges, 2).collect()}
    assert made == [150]
    assert got == {(q, f"job_{i}", s, 1, i + 1) for q, s in [(f"q{i}", 3.0) for i in range(40)] + [("z", 6.0), ("y", 3.0)] for i in (0, 1)}


def run(spark, docs):
    return frame(spark, [("q", d, 1.0 / (i + 1), i + 1) for i, d in enumerate(docs)], "qid string, doc_id string, score double, rank int")


def test_fusion_order_and_splice(spark):
    order = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    bm25, dense = run(spark, "abc"), run(spark, "bd")
    three = fusion.rrf({"bm25": bm25, "dense": dense, "kg": run(spark, "d")})
    assert order(three) == ["b", "d", "a", "c"] and order(fusion.rrf({"bm25": bm25, "dense": dense})) == ["b", "a", "d", "c"]
    swapped = fusion.rrf({"kg": run(spark, "d"), "dense": dense, "bm25": bm25})
    assert {r.doc_id: round(r.fused, 12) for r in swapped.collect()} == {r.doc_id: round(r.fused, 12) for r in three.collect()}
    texts = frame(spark, [(d, d) for d in "abcd"], "doc_id string, text string")
    q = frame(spark, [("q", "x")], "qid string, text string")
    score = lambda query, text: F.when(text == "b", 0.1).otherwise(0.9)
    assert order(fusion.rerank(three, q, texts, 2, score)) == ["d", "b", "a", "c"]
    padded = {r.doc_id: r.rerank for r in fusion.rerank(three, q, texts, 2, score, pad=True).collect()}
    assert padded["a"] == -3.0 and padded["c"] == -4.0
    assert fusion.single(bm25, "bm25").first().dense_score is None


def test_metrics_by_hand(spark):
    qrels = frame(spark, [("q1", "x", 2), ("q1", "y", 1), ("q2", "z", 1)], "qid string, doc_id string, rel int")
    docs = ["y", "o1", "x", *(f"o{i}" for i in range(2, 9))]
    got = {r.qid: r for r in metrics.per_query(run(spark, docs).withColumn("qid", F.lit("q1")), qrels).collect()}
    a = got["q1"]
    assert (a.recall_10, a.mrr_10, round(a.ap, 6), round(a.ndcg_10, 6)) == (1.0, 1.0, 0.833333, 0.760188)
    assert tuple(got["q2"])[1:] == (0.0,) * 5
    assert a.recall_10 <= a.recall_100


def test_published_arithmetic():
    assert round((0.604 * 100 + 0.201 * 19) / 119, 4) == 0.5397


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_leader_clusters_match_the_sequential_rule(spark, least):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], (i * 37) % 101) for i in range(101)]
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v, _ in rows}
    leaders, want = [], {}
    for i, _, _ in sorted(rows, key=lambda x: x[2]):
        sims = [(sum(a * b for a, b in zip(unit[i], unit[k])), -n, k) for n, k in enumerate(leaders)]
        best = max(sims, default=None)
        if best and best[0] >= least:
            want[i] = best[2]
        else:
            leaders.append(i)
            want[i] = i
    got = canonical.cluster(frame(spark, rows, "id long, vec array<double>, ord long"), least).collect()
    assert {x.id: x.centroid for x in got} == want


def test_leader_clusters_keep_no_pairs(spark, monkeypatch):
    """Tables between rounds have a row for each vector at most, however many vectors are alike; rounds settle the rest."""
    rows = [(i, [1.0, 0.01 * (i % 3)] if i < 900 else [math.cos(i), math.sin(i)], i) for i in range(1000)]
    df = frame(spark, rows, "id long, vec array<float>, ord long")
    want = sorted(map(tuple, canonical.cluster(df, 0.99).collect()))
    kept, durable = [], canonical.durable
    monkeypatch.setattr(canonical, "durable", lambda x: (y := durable(x), kept.append(y.count()))[0])
    monkeypatch.setattr(canonical, "BLOCK_VALUES", 100, raising=False)
    monkeypatch.setattr(canonical, "TILE_VALUES", 40, raising=False)
    got = sorted(map(tuple, canonical.cluster(df, 0.99).collect()))
    assert max(kept) <= len(rows) and [(i, c) for i, c, _ in got] == [(i, c) for i, c, _ in want]
    assert [i for i, _, _ in got] == list(range(1000)) and {c for i, c, _ in got if i < 900} == {0}


def test_canonical_layers(spark):
    skills = frame(spark, [("py",), ("Amazon Web Services",), ("rust lang",), (" ",)], "raw_name string")
    aliases = frame(spark, [("py", "Python")], "alias string, canonical_name string")
    labels = frame(spark, [("web services amazon", "u1"), ("cooking", "u2")], "title string, uri string")
    got = {r.raw_name: (r.canonical_name, r.source, r.confidence) for r in canonical.one(skills, aliases, labels).collect()}
    assert got == {"py": ("Python", "alias", 1.0), "Amazon Web Services": ("web services amazon", "ontology", 1.0), "rust lang": ("Rust Lang", "raw", 0.5), " ": (" ", "raw", 0.0)}


def test_relevance_thresholds(spark):
    edges = frame(spark, [(p, s) for p, skills in {"p1": "abc", "p2": "ab", "p3": "a", "p4": "abcdefg"}.items() for s in skills], "person_id string, skill_name string")
    q = frame(spark, [("q", "p1", ["a", "b", "c"]), ("r", "p3", ["a"])], "qid string, anchor_id string, query_skills array<string>")
    got = {(r.qid, r.doc_id): r.rel for r in evalset.judge(q, edges, "person_id").collect()}
    assert got == {("q", "p1"): 2, ("q", "p2"): 1, ("r", "p3"): 2, ("r", "p2"): 1}


def test_column_assignment():
    scores = [("a", "id", 0.8), ("b", "id", 0.8), ("a", "name", 0.9), ("b", "name", 0.5), ("c", "city", 0.1)]
    assert introspect.assign(scores, ["id", "name", "city"]) == [("id", "a", 0.8, "high"), ("name", "b", 0.5, "medium"), ("city", None, 0.1, "absent")]


def test_unique_and_upsert(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert graph.unique(df, "k").first()[:2] == ("a", 2)
    assert {tuple(r) for r in graph.upsert(df, ["k"], [F.col("v").desc()]).collect()} == {("a", 2), ("b", 3)}


def test_engine(spark):
    texts = frame(spark, [(f"person_{i}", "person", f"Person {i}", t) for i, t in enumerate(["python sql data", "java spring", "python ml", "sql reports"])], "doc_id string, kind string, title string, text string").withColumn("snippet", T.snippet(F.col("text")))
    names = lambda who: frame(spark, [(f"{who}_0", "python", "core", 5, "must_have"), (f"{who}_2", "python", "soft", 2, "good_to_have")], f"{'person' if who == 'person' else 'job'}_id string, skill_id string, category string, proficiency int, priority string")
    side = lambda who: Side(lexical.build(texts.select("doc_id", "text")), texts.select("doc_id", vector.hash_encode(F.col("text")).alias("vec")), names(who), texts)
    people = frame(spark, [("person_0", "Ann")], "id string, name string")
    skills = frame(spark, [("person_0", "SQL", 2), ("person_0", "Python", 5)], "person_id string, skill_name string, proficiency int")
    engine = Engine(side("person"), side("job"), frame(spark, [("python", "python")], "legacy_id string, canonical_id string"), people, skills)
    for mode in ("bm25", "dense", "rrf", "rrf3", "rrf3_rerank"):
        got = engine.search("python", "candidates", mode, 3, ["Python"])
        assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["entity"]["doc_id"] in ("person_0", "person_2")
        assert (got[0]["stage_scores"]["kg"] is not None) == (mode in ("rrf3", "rrf3_rerank")) and (got[0]["stage_scores"]["rerank"] is not None) == (mode == "rrf3_rerank")
        assert got[0]["entity"]["matched_skills"] == ["Python"]
    assert engine.profile("person_0")["skills"][0]["skill_name"] == "Python" and engine.profile("nobody") is None
    assert [e["type"] for e in engine.search_events("find python", mode="bm25")] == ["intent", "stage_start", "stage_done", "results", "done"]
    stages = [(e["type"], e.get("stage")) for e in engine.search_events("find python", side="candidates", query_skills=["Python"])]
    assert stages == [("intent", None), ("stage_start", "all"), *(("stage_done", s) for s in ("encode", "bm25", "dense", "kg", "rrf", "rerank")), ("results", None), ("done", None)]
    assert [e["results"] for e in engine.search_events("find python", side="candidates") if e["type"] == "results"][0] == engine.search("find python", "candidates")
    with pytest.raises(ValueError):
        engine.search_many(frame(spark, [("q", "x")], "qid string, text string"), "candidates")
    with pytest.raises(ValueError):
        engine.search_many(frame(spark, [("q", "x" * 1001)], "qid string, text string"), "candidates")
    assert [e["type"] for e in engine.search_events("x")][-1] == "error" and engine.health()["candidates"] == 4
    with pytest.raises(ValueError):
        engine.search("python", mode="none")
    asked = frame(spark, [("q1", "python", None, ["Python"]), ("q2", "spring", "paraphrase", [])], "qid string, text string, stratum string, query_skills array<string>")
    rels = frame(spark, [("q1", "person_0", 2), ("q2", "person_1", 1)], "qid string, doc_id string, rel int")
    summary = engine.eval_summary(asked, rels, "candidates", ("bm25", "rrf3")).collect()
    assert len(summary) == 6 and all(r.recall_100 == 1.0 for r in summary) and sum(r.is_best for r in summary) == 3


def test_a_classifier_decides_unless_it_fails_or_the_caller_says(spark):
    none = frame(spark, [("python", "python")], "legacy_id string, canonical_id string")
    asked = frame(spark, [("a", "an opening", None, None), ("b", "an opening", "jobs", ["Go"]), ("c", "someone", None, None)], "qid string, text string, side string, query_skills array<string>")
    told = lambda classify: {r.qid: (r.side, r.query_skills) for r in Engine(None, None, none, classify=classify).intent(asked).collect()}
    assert told(None) == {"a": ("jobs", []), "b": ("jobs", ["Go"]), "c": ("candidates", [])}
    clever = lambda q: q.withColumn("side", F.when(F.col("qid") != "c", "candidates")).withColumn("query_skills", F.array(F.lit("Java")))
    assert told(clever) == {"a": ("candidates", ["Java"]), "b": ("jobs", ["Go"]), "c": ("candidates", ["Java"])}

    def broken(q):
        raise RuntimeError("no answer")

    assert told(broken) == told(None)


def test_documents_without_a_text_stay_in_the_reranked_head(spark):
    fused = frame(spark, [("q", "a", 0.3, 1), ("q", "b", 0.2, 2), ("q", "c", 0.1, 3)], "qid string, doc_id string, fused double, rank int")
    got = fusion.rerank(fused, frame(spark, [("q", "python java")], "qid string, text string"), frame(spark, [("b", "python java"), ("c", None)], "doc_id string, text string"), 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["b", "a", "c"] and got[1].rerank == got[2].rerank > 0


def test_passages_are_found_in_texts(spark):
    passage = "one two three four five six seven eight nine"
    texts = frame(spark, [(1, f"x{passage}y"), (2, passage[:-1]), (3, f"a b {passage}. {passage}"), (4, None), (5, ""), (6, "tiny bit")], "doc_id long, text string")
    items = frame(spark, [(1, passage), (2, "tiny"), (3, "nowhere to be found in any of these texts"), (4, None)], "item_id long, text string")
    assert sorted(map(tuple, evalset.holding(texts, items).collect())) == [(1, 1), (3, 1), (6, 2)]


def test_vectors_are_saved_once(spark, tmp_path):
    rows = frame(spark, [("a", [3.0, 4.0]), ("b", None)], "doc_id string, vec array<double>")
    vector.save(rows, f"{tmp_path}/v")
    vector.save(frame(spark, [("z", [1.0, 0.0])], "doc_id string, vec array<double>"), f"{tmp_path}/v")
    got = vector.load(spark, f"{tmp_path}/v", 2).collect()
    assert [(r.doc_id, [round(x, 5) for x in r.vec]) for r in got] == [("a", [0.6, 0.8])]
    with pytest.raises(ValueError):
        vector.load(spark, f"{tmp_path}/v", 3)


def test_canonicalisation_in_one_run(spark):
    skills = frame(spark, [("py", "py", 9), ("ml", "machine learning", 5), ("tf", "tensor flow", 4), ("tff", "tensorflow", 3), ("go", "golang", 2), ("b", " ", 1)], "legacy_id string, raw_name string, occurrences long")
    aliases = frame(spark, [("py", "Python")], "alias string, canonical_name string")
    labels = frame(spark, [("Machine Learning", "uri:1")], "title string, uri string")
    vec = lambda c: F.when(c.startswith("tensor"), F.array(F.lit(1.0), F.lit(0.0))).when(c == "golang", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(-1.0), F.lit(0.0)))
    run = canonical.run(skills, aliases, labels, vec)
    got = {r.raw_name: (r.canonical_id, r.canonical_name, r.source, r.uri, r.confidence) for r in run.collect()}
    assert got == {
        "py": ("python", "Python", "alias", None, 1.0), "machine learning": ("machine-learning", "Machine Learning", "ontology", "uri:1", 1.0), "tensor flow": ("tensor-flow", "tensor flow", "raw", None, 0.5),
        "tensorflow": ("tensor-flow", "tensor flow", "embedding", None, 0.92), "golang": ("golang", "golang", "raw", None, 0.5), " ": ("unknown", " ", "raw", None, 0.5),
    }
    assert tuple(canonical.stats(run).first()) == (6, 5, 1.2, 1)


def test_paraphrases_are_written_once(spark):
    queries = frame(spark, [("a", "t", "x", "find java", ["Java"]), ("b", "t", "y", "find go", None), ("c", "t", "z", "find c", None), ("a_p", "t", "x", "old", None)], "qid string, task string, anchor_id string, text string, query_skills array<string>")
    cache = frame(spark, [("b", "b_p", "t", "y", "find go", "someone for go", "brief", None), ("gone", "gone_p", "t", "y", "q", "r", "brief", None)], "source_qid string, paraphrased_qid string, task string, anchor_id string, original_text string, paraphrased_text string, style string, query_skills array<string>")
    write = lambda df: df.withColumn("paraphrased_text", F.when(F.col("source_qid") == "c", " ").otherwise(F.concat(F.lit(" "), F.upper("text"), F.lit("/"), "style")))
    got = {r.paraphrased_qid: r.paraphrased_text for r in evalset.paraphrases(queries, cache, write, ("brief",)).collect()}
    assert got == {"b_p": "someone for go", "a_p": "FIND JAVA/brief"}
