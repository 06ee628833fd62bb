"""Queries of the retrieval channels, fusion, reranking and result building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, graph, lexical, vector
from . import views as V
from .base import query


@query(f"with {V.BM25} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf, round(avgdl, 6) as avgdl, n from dfs, corpus")
def bm25_stats(spark, d):
    index = lexical.build(V.texts(spark, d))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.terms.select("term", "df", F.round(idf, 6).alias("idf"), F.round(F.lit(index.avgdl), 6).alias("avgdl"), F.lit(index.n).cast("long").alias("n"))


def bm25(spark, d):
    queries = V.text_queries(spark, d)
    return lexical.search(lexical.build(V.texts(spark, d), queries), queries)


def dense(spark, d):
    return vector.search(V.vectors(spark, d).select("doc_id", "vec"), V.vector_queries(spark, d).select("qid", "vec"))


def canonical_ids(spark, d):
    return V.skills(spark, d).select(F.col("skill_id").alias("legacy_id"), F.concat(F.lit("c-"), "skill_id").alias("canonical_id")).distinct()


def asked_ids(spark, d):
    return graph.query_skill_ids(V.skill_queries(spark, d), canonical_ids(spark, d), T.service_slug)


def kg(spark, d, min_overlap=1):
    edges = V.has_skill(spark, d).withColumn("skill_id", F.concat(F.lit("c-"), "skill_id"))
    return graph.persons(asked_ids(spark, d), edges, 100, min_overlap, "person", "person_")


def kg_docs(spark, d):
    """The graph channel under the documents' numbering, for fusion."""
    return kg(spark, d).withColumn("doc_id", F.concat(F.lit("doc_"), F.substring("doc_id", 8, 20)))


V_KG_DOCS = f"{V.KG}, kg_docs as (select qid, concat('doc_', substr(doc_id, 8)) as doc_id, score, rank from kg)"


@query(f"with {V.BM25} select qid, doc_id, round(score, 6) as score, rank from bm25")
def bm25_topk(spark, d):
    return bm25(spark, d).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {V.DENSE} select qid, doc_id, round(score, 6) as score, rank from dense")
def dense_topk(spark, d):
    return dense(spark, d).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(embedding[1]::double / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-12), 6) as first from embeddings")
def vector_norms(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(vector.normalised(F.col("embedding")), 1), 6).alias("first"))


@query(
    f"with t as (select concat('doc_', doc_id) as doc_id, unnest({V.TOKENS.format('text')}) as tok from documents), h as (select doc_id, ('0x' || substr(md5(tok), 1, 8))::bigint % 64 as dim, count(*) as n from t group by all) "
    "select doc_id, cast(count(*) as bigint) as dims, cast(sum(n) as double) as total, cast(max(n) as double) as top from h group by 1"
)
def hash_encode(spark, d):
    v = V.texts(spark, d).select("doc_id", vector.hash_encode(F.col("text")).alias("v"))
    row = F.struct(F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("dims"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("v").alias("top"))
    return v.select("doc_id", F.inline(F.filter(F.array(row), lambda r: r["dims"] > 0)))  # a filter on dims would encode each text once more


@query(f"with {V.SKILLS}, {V.SKILL_QUERIES}, {V.CANON} select qid, cast(pos as integer) as pos, skill_id from asked_ids")
def query_canon(spark, d):
    return asked_ids(spark, d)


@query(f"with {V.KG} select qid, doc_id, round(score, 6) as score, overlap, rank from kg")
def kg_person_topk(spark, d):
    return kg(spark, d).select("qid", "doc_id", F.round("score", 6).alias("score"), "overlap", "rank")


@query(
    f"with {V.SKILLS}, {V.REQUIRES}, {V.SKILL_QUERIES}, {V.CANON}, s as (select qid, job_id as doc_id, sum(case priority when 'must_have' then 3.0 when 'good_to_have' then 1.0 else 1.0 end::double) as score, count(distinct a.skill_id) as overlap from asked_ids a join requires_skill r on a.skill_id = concat('c-', r.skill_id) group by all) "
    "select qid, doc_id, round(score, 6) as score, overlap, cast(row_number() over (partition by qid order by score desc, overlap desc, doc_id) as integer) as rank from s qualify rank <= 100"
)
def kg_job_topk(spark, d):
    edges = V.requires_skill(spark, d).withColumn("skill_id", F.concat(F.lit("c-"), "skill_id"))
    return graph.jobs(asked_ids(spark, d), edges, key="job", named="job_").select("qid", "doc_id", F.round("score", 6).alias("score"), "overlap", "rank")


@query(f"with {V.KG.replace('from kg_scores qualify', 'from kg_scores where overlap >= 2 qualify')} select qid, doc_id, round(score, 6) as score, overlap, rank from kg")
def kg_min_overlap(spark, d):
    return kg(spark, d, 2).select("qid", "doc_id", F.round("score", 6).alias("score"), "overlap", "rank")


def rrf_sql(channels: dict[str, str], keep: int | None = None) -> str:
    """Fusion of channel tables for DuckDB."""
    union = " union all ".join(f"select qid, doc_id, '{c}' as channel, score, rank from {t}" for c, t in channels.items())
    piv = ", ".join(f"max(score) filter (channel = '{c}') as {c}_score, max(rank) filter (channel = '{c}') as {c}_rank" for c in fusion.CHANNELS)
    order = "round(fused, 12) desc, " + ", ".join(f"{c}_rank asc nulls last" for c in fusion.CHANNELS)
    cut = f" qualify rank <= {keep}" if keep else ""
    return (
        f"u as (select qid, doc_id, sum(1.0::double / (60 + rank)) as fused, {piv} from ({union}) group by all), "
        f"fused as (select *, count(*) over (partition by qid) as n_candidates, cast(row_number() over (partition by qid order by {order}) as integer) as rank from u{cut})"
    )


def runs(spark, d):
    return {"bm25": bm25(spark, d), "dense": dense(spark, d), "kg": kg_docs(spark, d)}


TWO = {"bm25": "bm25", "dense": "dense"}
THREE = TWO | {"kg": "kg_docs"}
ALL = f"{V.BM25}, {V.DENSE}, {V_KG_DOCS}"


@query(f"with {V.BM25}, {V.DENSE}, {rrf_sql(TWO, 100)} select qid, doc_id, round(fused, 6) as fused, rank from fused")
def rrf2(spark, d):
    return fusion.rrf({"bm25": bm25(spark, d), "dense": dense(spark, d)}, 100).select("qid", "doc_id", F.round("fused", 6).alias("fused"), "rank")


@query(f"with {ALL}, {rrf_sql(THREE)} select qid, doc_id, round(fused, 6) as fused, rank from fused")
def rrf3(spark, d):
    return fusion.rrf(runs(spark, d)).select("qid", "doc_id", F.round("fused", 6).alias("fused"), "rank")


@query(f"with {ALL}, {rrf_sql(THREE)} select qid, doc_id, round(bm25_score, 6) as bm25_score, round(dense_score, 6) as dense_score, round(kg_score, 6) as kg_score, round(fused, 6) as rrf, round(fused, 6) as score, n_candidates from fused where rank <= 20")
def stage_scores(spark, d):
    f = fusion.rrf(runs(spark, d)).where("rank <= 20")
    r = lambda c, n=None: F.round(c, 6).alias(n or c)
    return f.select("qid", "doc_id", r("bm25_score"), r("dense_score"), r("kg_score"), r("fused", "rrf"), r("fused", "score"), "n_candidates")


@query(f"with {V.BM25} select qid, doc_id, round(score, 6) as rrf, rank, count(*) over (partition by qid) as n_candidates from bm25")
def mode_bm25(spark, d):
    return fusion.fuse("bm25", {"bm25": bm25(spark, d)}).select("qid", "doc_id", F.round("fused", 6).alias("rrf"), "rank", "n_candidates")


@query(f"with {V.DENSE} select qid, doc_id, round(score, 6) as rrf, rank, count(*) over (partition by qid) as n_candidates from dense")
def mode_dense(spark, d):
    return fusion.fuse("dense", {"dense": dense(spark, d)}).select("qid", "doc_id", F.round("fused", 6).alias("rrf"), "rank", "n_candidates")


def rerank_sql(head: int, pad: bool) -> str:
    q, t = V.TOKENS.format("q.text"), V.TOKENS.format("d.text")
    share = f"(case when len(list_distinct({q})) = 0 then 0.0 else coalesce(len(list_intersect(list_distinct({q}), {t})), 0)::double / len(list_distinct({q})) end)"
    rest = "-f.rank::double" if pad else "null"
    return (
        f"scored as (select f.qid, f.doc_id, f.rank as old, f.fused, case when f.rank <= {head} then round(1 / (1 + exp(-(6 * {share} - 3))), 9) else {rest} end as rerank from fused f join text_queries q using (qid) left join documents d on f.doc_id = concat('doc_', d.doc_id)), "
        f"reranked as (select qid, doc_id, fused, rerank, old, cast(row_number() over (partition by qid order by old <= {head} desc, case when old <= {head} then rerank end desc, old) as integer) as rank from scored)"
    )


def spliced(spark, d, head, pad, mode="rrf"):
    found = fusion.fuse(mode, runs(spark, d) if mode != "rrf" else {"bm25": bm25(spark, d), "dense": dense(spark, d)}, 100)
    return fusion.rerank(found, V.text_queries(spark, d), V.texts(spark, d), head, pad=pad)


@query(f"with {V.BM25}, {V.DENSE}, {rrf_sql(TWO, 100)}, {rerank_sql(25, False)} select qid, doc_id, round(rerank, 6) as rerank, rank from reranked")
def rerank_splice(spark, d):
    return spliced(spark, d, 25, False).select("qid", "doc_id", F.round("rerank", 6).alias("rerank"), "rank")


@query(f"with {V.BM25}, {V.DENSE}, {rrf_sql(TWO, 100)}, {rerank_sql(50, True)} select qid, doc_id, round(rerank, 6) as rerank, rank from reranked")
def rerank_pad(spark, d):
    return spliced(spark, d, 50, True).select("qid", "doc_id", F.round("rerank", 6).alias("rerank"), "rank")


@query(
    f"with {V.BM25}, {V.DENSE}, {rrf_sql(TWO, 100)}, {rerank_sql(25, False)} select r.qid, r.doc_id, r.rank, round(coalesce(r.rerank, r.fused), 6) as score, coalesce('document', 'person') as kind, case when length(s) > 60 then concat(rtrim(substr(s, 1, 59)), '…') else s end as snippet "
    "from reranked r join (select concat('doc_', doc_id) as doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') as s from documents) m using (doc_id) where r.rank <= 10"
)
def final_results(spark, d):
    meta = V.texts(spark, d).select("doc_id", F.lit("document").alias("kind"), T.snippet(F.col("text"), 60).alias("snippet"))
    return fusion.results(spliced(spark, d, 25, False), meta, 10).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"), "kind", "snippet")


@query(
    f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select c_custkey, c_name as name, array_to_string(list(concat(skill_name, ':', category, ':', proficiency) order by proficiency desc, skill_name, category), '|') as skills from customer left join has_skill on person_id = concat('person_', c_custkey) where c_custkey in (7, 11, 900) group by all"
)
def profile_detail(spark, d):
    people = V.table(spark, d, "customer").where(F.col("c_custkey").isin(7, 11, 900)).select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("person_"), "c_custkey").alias("person_id"))
    item = F.struct((-F.col("proficiency")).alias("p"), "skill_name", "category")
    edges = V.has_skill(spark, d, people.select(F.col("c_custkey").alias("person")))
    rows = people.join(edges, "person_id", "left").groupBy("c_custkey", "name").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return rows.select("c_custkey", "name", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["skill_name"], x["category"], (-x["p"]).cast("string"))), "|").alias("skills"))


@query(
    f"with {V.SKILLS}, {V.REQUIRES}, {V.JOBS} select id, designation, industry, city, country, array_to_string(list(concat(priority, ':', skill_name) order by priority, skill_name), '|') as skills from jobs left join requires_skill on id = job_id where id in ('job_1', 'job_77', 'job_4000') group by all"
)
def job_detail(spark, d):
    j = V.jobs(spark, d).where(F.col("id").isin("job_1", "job_77", "job_4000"))
    edges = V.requires_skill(spark, d, j.select(F.substring("id", 5, 20).cast("long").alias("job")))
    rows = j.join(edges, F.col("id") == F.col("job_id"), "left")
    listed = F.array_sort(F.collect_list(F.struct("priority", "skill_name")))
    return rows.groupBy("id", "designation", "industry", "city", "country").agg(listed.alias("l")).select("id", "designation", "industry", "city", "country", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["priority"], x["skill_name"])), "|").alias("skills"))


_STAGES = ("encode", "bm25", "dense", "kg", "rrf", "rerank")


@query(
    "with s as (select user_id as qid, " + ", ".join(f"round(sum(value) filter (event_type = '{e}'), 3) as {s}" for s, e in zip(_STAGES, ("view", "click", "error", "signup", "purchase", "none"))) + " from events group by 1), "
    "e as (" + " union all ".join(f"select qid, 'stage_done' as type, '{s}' as stage, {s} as elapsed_ms, {i + 2} as o from s where {s} > 0" for i, s in enumerate(_STAGES)) + " union all select qid, 'intent', null, null, 0 from s union all select qid, 'stage_start', 'all', null, 1 from s union all select qid, 'results', null, null, 90 from s union all select qid, 'done', null, null, 91 from s) "
    "select qid, cast(row_number() over (partition by qid order by o) as integer) as seq, type, stage, elapsed_ms from e"
)
def stage_events(spark, d):
    return events(spark, d)


def events(spark, d):
    """The event sequence of every user's stages."""
    kinds = dict(zip(_STAGES, ("view", "click", "error", "signup", "purchase", "none")))
    s = V.table(spark, d, "events").groupBy(F.col("user_id").alias("qid")).agg(*(F.round(F.sum(F.when(F.col("event_type") == e, F.col("value"))), 3).alias(x) for x, e in kinds.items()))
    item = lambda kind, stage, ms, o: F.struct(F.lit(kind).alias("type"), F.lit(stage).cast("string").alias("stage"), ms.alias("elapsed_ms"), F.lit(o).alias("o"))
    null = F.lit(None).cast("double")
    seq = F.array(item("intent", None, null, 0), item("stage_start", "all", null, 1), *(item("stage_done", x, F.col(x), i + 2) for i, x in enumerate(_STAGES)), item("results", None, null, 90), item("done", None, null, 91))
    rows = s.select("qid", F.inline(F.filter(seq, lambda x: (x["type"] != "stage_done") | (x["elapsed_ms"] > 0))))
    return rows.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("o")).alias("seq"), "type", "stage", "elapsed_ms")


@query(
    "with s as (select user_id as qid, round(sum(value), 3) as ms from events group by 1) select qid, concat('event: stage_done', chr(10), 'data: {\"type\":\"stage_done\",\"stage\":\"s', qid, '\"}', chr(10), chr(10)) as frame, concat('s', qid) as parsed_stage from s"
)
def sse_frames(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("qid")).distinct()
    data = F.to_json(F.struct(F.lit("stage_done").alias("type"), F.concat(F.lit("s"), "qid").alias("stage"), F.lit(None).cast("double").alias("elapsed_ms")))
    frame = F.concat(F.lit("event: "), F.lit("stage_done"), F.lit("\ndata: "), data, F.lit("\n\n"))
    parsed = F.from_json(F.regexp_extract(F.get(F.split(frame, "\n\n"), F.lit(0)), r"(?m)^data: (.*)$", 1), "type string, stage string")["stage"]
    return e.select("qid", frame.alias("frame"), parsed.alias("parsed_stage"))
