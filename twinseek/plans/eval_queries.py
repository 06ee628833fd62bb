"""Queries of evaluation sets, metrics, ablation, clustering, and the extensions beyond parity (x_...)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import canonical, evalset, fusion, matching, metrics
from ..session import durable
from . import search_queries as S
from . import views as V
from .base import query, table

IDEAL = "ideal as (select qid, sum((rel >= 1)::int) as n_rel, sum(case when i <= 10 then rel / log2(i + 1.0) else 0 end) as idcg from (select *, row_number() over (partition by qid order by rel desc, doc_id) as i from judgements) group by 1)"


def panel_sql(run: str) -> str:
    return (
        f"{IDEAL}, hits as (select r.qid, r.rank, j.rel, row_number() over (partition by r.qid order by r.rank) as nth from {run} r join judgements j using (qid, doc_id) where rel >= 1), "
        "got as (select qid, count(*) filter (rank <= 10) as h10, count(*) filter (rank <= 100) as h100, min(rank) as first, sum(nth / rank) as ap, sum(case when rank <= 10 then rel / log2(rank + 1.0) else 0 end) as dcg from hits group by 1), "
        "panel as (select qid, coalesce(h10 / n_rel, 0)::double as recall_10, coalesce(h100 / n_rel, 0)::double as recall_100, coalesce(case when first <= 10 then 1.0::double / first end, 0)::double as mrr_10, coalesce(ap / n_rel, 0)::double as ap, coalesce(dcg / idcg, 0)::double as ndcg_10 from ideal left join got using (qid))"
    )


MEANS = ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics.PANEL)
ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in metrics.PANEL)


def tasks(spark, d):
    i = F.substring("qid", 3, 9).cast("int")
    return V.text_queries(spark, d).select("qid", F.when(i % 2 == 0, "candidate_search").otherwise("job_search").alias("task"), F.when(i % 4 == 0, "paraphrase").alias("stratum"))


@query(f"with {V.BM25}, {V.JUDGEMENTS}, {panel_sql('bm25')} select qid, {ROUNDED} from panel")
def metric_panel(spark, d):
    return metrics.per_query(S.bm25(spark, d), V.judgements(spark, d)).select("qid", *(F.round(m, 6).alias(m) for m in metrics.PANEL))


@query(
    f"with {V.BM25}, {V.JUDGEMENTS}, {panel_sql('bm25')}, t as (select *, case when substr(qid, 3)::int % 2 = 0 then 'candidate_search' else 'job_search' end as task, case when substr(qid, 3)::int % 4 = 0 then 'paraphrase' else 'original' end as stratum from panel) "
    f"select 'overall' as cut, 'all' as value, count(*) as n, {MEANS} from t union all select 'task', task, count(*), {MEANS} from t group by task union all select 'stratum', stratum, count(*), {MEANS} from t group by stratum"
)
def metric_cuts(spark, d):
    return metrics.cuts(metrics.per_query(S.bm25(spark, d), V.judgements(spark, d)), tasks(spark, d))


_RUNS = f"{S.ALL}, fused2 as (select * from (with {S.rrf_sql(S.TWO, 100)} select * from fused)), fused3 as (select * from (with {S.rrf_sql(S.THREE)} select * from fused)), reranked3 as (select * from (with fused as (select * from fused3), {S.rerank_sql(25, False)} select * from reranked))"
_CONFIGS = {"bm25": "bm25", "dense": "dense", "kg_only": "kg_docs", "rrf": "fused2", "rrf3": "fused3", "rrf3_rerank": "reranked3"}
_ABLATION = f"{_RUNS}, {V.JUDGEMENTS}, ablation as (" + " union all ".join(f"select '{c}' as config, * from (with {panel_sql(t)} select * from panel)" for c, t in _CONFIGS.items()) + ")"


def configs(spark, d):
    """Runs of all configurations by name; they share the channel runs."""
    runs = {c: durable(run) for c, run in S.runs(spark, d).items()}
    three = durable(fusion.rrf(runs))
    return {
        "bm25": runs["bm25"], "dense": runs["dense"], "kg_only": runs["kg"], "rrf": fusion.rrf({c: runs[c] for c in ("bm25", "dense")}, 100), "rrf3": three,
        "rrf3_rerank": fusion.rerank(three, V.text_queries(spark, d), V.texts(spark, d)),
    }


def scored(spark, d):
    """(config, qid, metrics) of every configuration, in one plan."""
    out = None
    for name, run in configs(spark, d).items():
        one = run.select(F.lit(name).alias("config"), "qid", "doc_id", "rank")
        out = one if out is None else out.union(one)
    # One panel for all: a configuration's query is a query of its own.
    key = F.concat_ws("/", "config", "qid")
    qrels = V.judgements(spark, d).join(F.broadcast(out.sparkSession.createDataFrame([(c,) for c in _CONFIGS], "config string"))).select(key.alias("qid"), "doc_id", "rel")
    panel = metrics.per_query(out.select(key.alias("qid"), "doc_id", "rank"), qrels)
    return panel.withColumns({"config": F.substring_index("qid", "/", 1), "qid": F.substring_index("qid", "/", -1)})


@query(f"with {_ABLATION} select config, count(*) as n, {MEANS} from ablation group by 1")
def ablation(spark, d):
    return scored(spark, d).groupBy("config").agg(F.count("*").alias("n"), *metrics.means(None))


_SUMMARY = f"{_ABLATION}, s as (select config, 'overall' as stratum, * exclude (config, qid) from ablation union all select config, case when substr(qid, 3)::int % 4 = 0 then 'paraphrase' else 'original' end, * exclude (config, qid) from ablation), rows_ as (select config, stratum, {MEANS} from s group by 1, 2)"


@query(f"with {_SUMMARY} select *, row_number() over (partition by stratum order by ndcg_10 desc nulls last, config) = 1 as is_best, ndcg_10 >= 0.55 as meets_target from rows_")
def eval_summary(spark, d):
    s = scored(spark, d).join(tasks(spark, d).select("qid", "stratum"), "qid").withColumn("strata", F.array(F.lit("overall"), F.coalesce("stratum", F.lit("original"))))
    rows = s.select("config", F.explode("strata").alias("stratum"), *metrics.PANEL).groupBy("config", "stratum").agg(*metrics.means(None))
    return metrics.best_per(rows, "stratum", "ndcg_10", "config").withColumn("meets_target", F.col("ndcg_10") >= 0.55)


@query("select *, row_number() over (partition by o_orderpriority order by o_totalprice desc nulls last, o_orderkey) = 1 as is_best from (select o_orderkey, o_orderpriority, o_totalprice from orders)")
def best_per_stratum(spark, d):
    return metrics.best_per(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "o_orderkey")


@query(f"with {V.JUDGEMENTS}, n as (select qid, count(*) as n from judgements group by 1) select case when substr(qid, 3)::int % 2 = 0 then 'candidate_search' else 'job_search' end as task, count(*) as queries, cast(sum(n) as bigint) as pairs, round(avg(n), 2) as mean_relevant from n group by 1")
def eval_stats(spark, d):
    n = V.judgements(spark, d).groupBy("qid").agg(F.count("*").alias("n")).join(tasks(spark, d), "qid")
    return n.groupBy("task").agg(F.count("*").alias("queries"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 2).alias("mean_relevant"))


@query("select concat('cand_', printf('%03d', row_number() over (order by md5(concat('42#', c_custkey)), c_custkey::varchar) - 1)) as qid, c_custkey::varchar as id from customer order by md5(concat('42#', c_custkey)), c_custkey::varchar limit 50")
def seeded_sample(spark, d):
    return evalset.seeded(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id")), "id", 50, 42, "cand").select("qid", "id")


_HARD = "hard as (select person_id, skill_name, max(proficiency) as value from has_skill where category <> 'soft' group by all)"
_CAND = (
    f"{V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL}, {_HARD}, tops as (select person_id, list(skill_name order by value desc, skill_name)[1:3] as names, list_min(list(value order by value desc, skill_name)[1:3]) as least, count(*) as n from hard group by 1 having count(*) >= 3), "
    "cands as (select *, concat('cand_', printf('%03d', row_number() over (order by md5(concat('42#', person_id)), person_id) - 1)) as qid from tops order by md5(concat('42#', person_id)), person_id limit 50)"
)


def judge_sql(queries: str, edges: str, entity: str, least: int) -> str:
    return (
        f"asked_s as (select distinct qid, unnest(names) as skill_name from {queries}), sets as (select distinct {entity} as doc_id, skill_name from {edges}), nq as (select qid, count(*) as n_q from asked_s group by 1), nd as (select doc_id, count(*) as n_d from sets group by 1), "
        "shared as (select qid, doc_id, count(*) as overlap from asked_s join sets using (skill_name) group by all), "
        f"near as (select qid, doc_id from shared join nq using (qid) join nd using (doc_id) where overlap >= least({least}, n_q) and overlap / (n_q + n_d - overlap) >= 0.05)"
    )


@query(f"with {_CAND} select qid, 'candidate_search' as task, concat(array_to_string(names, ', '), ' engineer at ', (['Beginner','Advanced Beginner','Competent','Proficient','Expert'])[least], ' or higher') as text, person_id as anchor_id, array_to_string(names, '|') as skills, least as min_proficiency_ordinal, n as anchor_skill_count from cands")
def evalset_candidate(spark, d):
    q = evalset.candidate_queries(V.has_skill(spark, d))
    return q.select("qid", "task", "text", "anchor_id", F.array_join("query_skills", "|").alias("skills"), "min_proficiency_ordinal", "anchor_skill_count")


_JUDGED = f"with {_CAND}, {judge_sql('cands', 'has_skill', 'person_id', 2)}, all_ as (select qid, doc_id, 1 as rel from near union all select qid, person_id, 2 from cands) select qid, doc_id, max(rel) as rel from all_ group by 1, 2"


@query(_JUDGED.replace("0.05", "0.5"))
def evalset_candidate_judged(spark, d):
    return candidate_judgements(spark, d, 0.5)


@query(f"with {_CAND}, {judge_sql('cands', 'has_skill', 'person_id', 2)}, all_ as (select qid, doc_id, 1 as rel from near union all select qid, person_id, 2 from cands) select qid, doc_id, max(rel) as rel from all_ group by 1, 2")
def evalset_candidate_qrels(spark, d):
    return candidate_judgements(spark, d, 0.05)


def candidate_judgements(spark, d, threshold):
    """Edges and queries are written once; both are read more than once."""
    edges = durable(V.has_skill(spark, d).select("person_id", "skill_name", "category", "proficiency"))
    return evalset.judge(durable(evalset.candidate_queries(edges)), edges, "person_id", 2, threshold)


_JOBQ = (
    f"{V.SKILLS}, {V.REQUIRES}, {V.JOBS}, per_skill as (select job_id, skill_name, min(priority) as value from requires_skill group by all), jtops as (select job_id, list(skill_name order by value, skill_name)[1:3] as names, designation from per_skill join jobs on id = job_id where designation <> '' group by job_id, designation), "
    "jobqs as (select *, concat('job_', printf('%03d', row_number() over (order by md5(concat('42#', job_id)), job_id) - 1)) as qid from jtops order by md5(concat('42#', job_id)), job_id limit 50)"
)


@query(f"with {_JOBQ}, {judge_sql('jobqs', 'requires_skill', 'job_id', 1).replace('0.05', '0.5')}, all_ as (select qid, doc_id, 1 as rel from near union all select qid, job_id, 2 from jobqs), m as (select qid, doc_id, max(rel) as rel from all_ group by 1, 2) select m.qid, m.doc_id, m.rel from m join jobqs q using (qid) join jobs j on j.id = m.doc_id where m.rel = 2 or contains(lower(j.designation), lower(q.designation)) or contains(lower(q.designation), lower(j.designation))")
def evalset_job(spark, d):
    titles = V.jobs(spark, d).select(F.col("id").alias("job_id"), F.col("designation").alias("title"))
    edges = durable(V.requires_skill(spark, d).select("job_id", "skill_name", "priority"))
    return evalset.judge_jobs(durable(evalset.job_queries(edges, titles)), edges, titles)


@query(f"with {V.JUDGEMENTS}, {V.TEXT_QUERIES}, p as (select concat(qid, '_p') as qid, qid as source_qid, lower(text) as text from text_queries) select q.qid, q.text, null as source_qid, (select count(*) from judgements j where j.qid = q.qid) as n_rel from text_queries q union all select p.qid, p.text, p.source_qid, (select count(*) from judgements j where j.qid = p.source_qid) from p")
def evalset_rewrite(spark, d):
    q, rels = V.text_queries(spark, d), V.judgements(spark, d)
    p = q.select(F.concat("qid", F.lit("_p")).alias("qid"), F.col("qid").alias("source_qid"), F.lower("text").alias("text"))
    old = q.where("cast(substring(qid, 3) as int) = 3").select(F.concat("qid", F.lit("_p")).alias("qid"), F.lit("stale").alias("text"))
    every = evalset.rewrite(q.union(old), p)
    n = rels.unionByName(evalset.inherit(p, rels)).groupBy("qid").agg(F.count("*").alias("n_rel"))
    return every.join(n, "qid", "left").fillna(0, ["n_rel"]).select("qid", "text", "source_qid", "n_rel")


@query(f"with {V.BM25} select concat(qid, ' Q0 ', doc_id, ' ', rank, ' ', printf('%.6f', score), ' twinseek') as line from bm25 where rank <= 100")
def trec_run(spark, d):
    return S.bm25(spark, d).where("rank <= 100").select(F.concat_ws(" ", "qid", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit("twinseek")).alias("line"))


@query(f"with {V.JUDGEMENTS} select concat(qid, ' 0 ', doc_id, ' ', rel) as line, qid as parsed_qid, rel as parsed_rel from judgements")
def trec_qrels(spark, d):
    line = V.judgements(spark, d).select(F.concat_ws(" ", "qid", F.lit("0"), "doc_id", F.col("rel").cast("string")).alias("line"))
    parts = F.split("line", r"\s+")
    return line.select("line", parts[0].alias("parsed_qid"), parts[3].cast("int").alias("parsed_rel"))


_LEADERS = (
    "with recursive v as (select row_number() over (order by vec_id) as i, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), r as (select 0 as i, []::bigint[] as leaders, null::bigint as vec_id, null::bigint as centroid "
    "union all select r.i + 1, case when best is null then list_append(leaders, v.vec_id) else leaders end, v.vec_id, coalesce(best, v.vec_id) from r join v on v.i = r.i + 1 left join lateral (select arg_max(l.vec_id, (round(list_cosine_similarity(l.e, v.e), 9), -l.i)) as best from v l where list_contains(r.leaders, l.vec_id) and list_cosine_similarity(l.e, v.e) >= 0.4) on true) "
    "select vec_id as id, centroid from r where i > 0"
)


@query(_LEADERS)
def leader_cluster(spark, d):
    return clustered(spark, d, 0.4)


def clustered(spark, d, least):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("vec_id").alias("ord"))
    return canonical.cluster(rows, least).select("id", "centroid")


@query(_LEADERS.replace(">= 0.4", ">= 0.92"))
def leader_cluster_strict(spark, d):
    return clustered(spark, d, canonical.CLUSTER_LEAST)


@query(f"with {S.ALL}, {S.rrf_sql(S.THREE)} select qid, doc_id, round(fused * (0.7 + 0.075 * (1 + length(doc_id) % 5)), 6) as adjusted from fused where rank <= 25")
def x_prof_rerank(spark, d):
    return fusion.rrf(S.runs(spark, d)).where("rank <= 25").select("qid", "doc_id", F.round(F.col("fused") * (0.7 + 0.075 * (1 + F.length("doc_id") % 5)), 6).alias("adjusted"))


_SHARE = f"len(list_intersect(list_distinct({V.TOKENS.format('b.text')}), {V.TOKENS.format('t.text')}))::double / nullif(len(list_distinct({V.TOKENS.format('b.text')})), 0)"


@query(
    f"with {V.DENSE}, e as (select concat('doc_', vec_id) as doc_id, embedding::double[] as v, label from embeddings), r as (select qid, d.doc_id, score, d.rank, e.v, e.label = q.label as same from dense d join e using (doc_id) join e q on q.doc_id = concat('doc_', substr(qid, 3)) where d.doc_id <> q.doc_id), "
    "p as (select qid, arg_min(doc_id, rank) as positive, min(rank) as p_rank, arg_min(v, rank) as pv from r where same group by 1), n as (select r.qid, r.doc_id, positive, score, rank from r join p using (qid) where rank < p_rank and 1 - list_cosine_similarity(v, pv) > 0.1) "
    f"select n.qid, n.doc_id, positive, round(score, 6) as score from n join benchmark b on n.qid = concat('q_', b.item_id) left join documents t on n.doc_id = concat('doc_', t.doc_id) where 1 / (1 + exp(-(6 * coalesce({_SHARE}, 0) - 3))) <= 0.7"
)
def x_neg_mining(spark, d):
    """Hard negatives: vectors nearer to the query than its best match of the same label, apart from that match by more
    than 0.1, without those the pair scorer gives over 0.7."""
    from ..operators import vector

    e = V.vectors(spark, d)
    labels = e.select("doc_id", F.col("label").alias("_l"))
    own = labels.select(F.concat(F.lit("q_"), F.substring("doc_id", 5, 20)).alias("qid"), F.col("_l").alias("_ql"), F.col("doc_id").alias("_self"))
    r = S.dense(spark, d).join(labels, "doc_id").join(own, "qid").where("doc_id <> _self")
    best = r.where("_l = _ql").groupBy("qid").agg(F.min_by("doc_id", "rank").alias("positive"), F.min("rank").alias("_p"))
    near = r.join(best, "qid").where("rank < _p").select("qid", "doc_id", "positive", "score")
    pairs = near.join(e.select("doc_id", F.col("vec").alias("_v")), "doc_id").join(e.select(F.col("doc_id").alias("positive"), F.col("vec").alias("_pv")), "positive").where(1 - vector.cosine(F.col("_v"), F.col("_pv")) > 0.1)
    said = pairs.join(V.text_queries(spark, d).select("qid", F.col("text").alias("_q")), "qid").join(V.texts(spark, d).select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    return said.where(fusion.overlap_scorer(F.col("_q"), F.coalesce("_t", F.lit(""))) <= 0.7).select("qid", "doc_id", "positive", F.round("score", 6).alias("score"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as n, round(avg(value), 6) as mean from events group by all")
def x_tumbling(spark, d):
    from ..streaming import windows

    out = windows.tumbling(table(spark, d, "events"), "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("with e as (select ts, event_type, value, unnest([0, 1]) as k from events), w as (select time_bucket(interval 30 minute, ts) - k * interval 30 minute as start, event_type, value from e) select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from w group by all")
def x_sliding(spark, d):
    from ..streaming import windows

    return windows.sliding(table(spark, d, "events"), "1 hour", "30 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k")
def x_session(spark, d):
    from ..streaming import windows

    return windows.sessions(table(spark, d, "events"), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL}, {V.REQUIRES}, p as (select distinct person_id, skill_id from has_skill where proficiency >= 4), j as (select distinct job_id, skill_id from requires_skill), np as (select person_id, count(*) as a from p group by 1), nj as (select job_id, count(*) as b from j group by 1), "
    "s as (select person_id, job_id, count(*) as k from p join j using (skill_id) group by all) select person_id, job_id, round(k / (a + b - k), 6) as score from s join np using (person_id) join nj using (job_id) qualify row_number() over (partition by person_id order by round(k / (a + b - k), 9) desc, job_id) <= 5"
)
def x_matches(spark, d):
    items = F.array_sort(F.collect_set("same")).alias("items")
    p = V.has_skill(spark, d).where("proficiency >= 4").groupBy(F.col("person").alias("id")).agg(items)
    j = V.requires_skill(spark, d).groupBy("job").agg(items).select(F.concat(F.lit("job_"), "job").alias("id"), "items")
    return matching.best(p, j, 5).select(F.concat(F.lit("person_"), "left").alias("person_id"), F.col("right").alias("job_id"), F.round("score", 6).alias("score"))
