"""Queries of the filters, joins, aggregations, set operations and graph tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical, graph, introspect
from . import views as V
from .base import query, table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" union all ".join(f'select \'{n}\' as "table", count(*) as n from {n}' for n in NAMES))
def scan_parquet_counts(spark, d):
    return graph.counts({n: table(spark, d, n) for n in NAMES})


@query(
    " union all ".join(
        f"select '{c}' as name, '{t}' as dtype, round(100.0 * avg(case when {c} is null then 1.0 else 0.0 end), 4)::double as null_pct, count(distinct {c}) as n_distinct, min(case when trim({c}::varchar) <> '' then substr({c}::varchar, 1, 80) end) as sample from part"
        for c, t in (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"))
    )
)
def column_profile(spark, d):
    return introspect.profile(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query(
    "with f as (select event_id, props as v from events order by event_id limit 50) select round(avg(case when json_valid(v) and regexp_matches(trim(v), '^[\\[{]') then 1.0 else 0.0 end) filter (event_id < 25), 6)::double as json, "
    "round(avg(case when len(regexp_split_to_array(v, '[,;|]')) >= 3 then 1.0 else 0.0 end) filter (event_id < 25), 6)::double as delimited, round(avg(case when try_cast(v as double) is not null then 1.0 else 0.0 end) filter (event_id < 25), 6)::double as \"numeric\", "
    "round(avg(len(regexp_extract_all(v, '\\S+'))), 6)::double as tokens from f"
)
def value_shapes(spark, d):
    return introspect.shapes(table(spark, d, "events"), "props", "event_id")


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select person_id, count(*) as n from has_skill where category <> 'soft' group by 1 having count(*) >= 3")
def non_soft_filter(spark, d):
    return V.has_skill(spark, d).where("category <> 'soft'").groupBy("person_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 4242")
def point_lookup(spark, d):
    return spark.sql("select o_orderkey, o_orderstatus, o_totalprice from {orders} where o_orderkey = :key", {"key": 4242}, orders=table(spark, d, "orders"))


@query(
    "with q as (select item_id, case item_id % 3 when 0 then concat('Senior ', substr(text, 1, 9), ' Openings') when 1 then concat('find ', substr(text, 1, 9)) else 'reposition this' end as text from benchmark) "
    "select item_id, case when item_id % 5 = 0 then 'candidates' when regexp_matches(lower(text), 'role|position|opening|vacanc(y|ies)|job') then 'jobs' else 'candidates' end as side, trim(text) as free_text from q"
)
def side_heuristic(spark, d):
    i = F.col("item_id") % 3
    text = F.when(i == 0, F.concat(F.lit("Senior "), F.substring("text", 1, 9), F.lit(" Openings"))).when(i == 1, F.concat(F.lit("find "), F.substring("text", 1, 9))).otherwise("reposition this")
    asked = F.when(F.col("item_id") % 5 == 0, "candidates")
    return table(spark, d, "benchmark").select("item_id", F.coalesce(asked, F.when(T.wants_jobs(text), "jobs").otherwise("candidates")).alias("side"), F.trim(text).alias("free_text"))


@query("select coalesce(case when item_id % 4 = 0 then 'paraphrase' end, 'original') as stratum, count(*) as n from benchmark where not ends_with(concat('q', case when item_id % 10 = 9 then '_p' else '' end), '_p') group by 1")
def stratum_split(spark, d):
    qid = F.concat(F.lit("q"), F.when(F.col("item_id") % 10 == 9, "_p").otherwise(""))
    return table(spark, d, "benchmark").where(~qid.endswith("_p")).groupBy(F.coalesce(F.when(F.col("item_id") % 4 == 0, "paraphrase"), F.lit("original")).alias("stratum")).agg(F.count("*").alias("n"))


@query("select a.p_partkey, b.n_nationkey from (select p_partkey, case when p_partkey % 2 = 0 then 'NATION_1' else p_type end as a from part) a, (select n_nationkey, case when n_nationkey = 3 then '' else n_name end as b from nation) b where a <> '' and (contains(b, a) or contains(a, b))")
def contains_either(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "NATION_1").otherwise(F.col("p_type")).alias("a"))
    b = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 3, "").otherwise(F.col("n_name")).alias("b"))
    return a.join(b, T.contains_either(F.col("a"), F.col("b"))).select("p_partkey", "n_nationkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def anti_cache(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"with {V.JUDGEMENTS} select qid, doc_id, rel from judgements where qid in (select concat('q_', item_id) from benchmark where item_id % 2 = 0)")
def semi_task(spark, d):
    return V.judgements(spark, d).join(V.text_queries(spark, d).where("cast(substring(qid, 3) as int) % 2 = 0"), "qid", "left_semi").select("qid", "doc_id", "rel")


@query(f"with {V.SKILLS}, {V.REQUIRES}, {V.JOBS} select id, designation, count(skill_id) as n_skills from jobs join requires_skill on id = job_id where coalesce(designation, '') <> '' group by 1, 2 having count(skill_id) >= 1")
def jobs_join_skills(spark, d):
    j = V.jobs(spark, d).where("coalesce(designation, '') <> ''")
    return j.join(V.requires_skill(spark, d), F.col("id") == F.col("job_id")).groupBy("id", "designation").agg(F.count("skill_id").alias("n_skills")).where("n_skills >= 1")


_CANONICAL = "select distinct skill_id as legacy_id, concat('c-', skill_id) as canonical_id from skills where skill_id not like '%promo'"


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL}, canon as ({_CANONICAL}) select coalesce(canonical_id, 'unmapped') as canonical_id, count(*) as edges from has_skill left join canon on skill_id = legacy_id group by 1")
def canonical_lookup(spark, d):
    canon = V.skills(spark, d).select("skill_id").distinct().where("skill_id not like '%promo'").withColumn("canonical_id", F.concat(F.lit("c-"), "skill_id"))
    return V.has_skill(spark, d).join(canon, "skill_id", "left").groupBy(F.coalesce("canonical_id", F.lit("unmapped")).alias("canonical_id")).agg(F.count("*").alias("edges"))


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select category, count(*) as n from has_skill where person_id in (select concat('person_', c_custkey) from customer where c_acctbal > 0) and skill_id in (select skill_id from skills where skill_name not like '%SMALL') group by 1")
def edge_endpoints(spark, d):
    people = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("person_"), "c_custkey").alias("person_id"))
    nodes = V.skills(spark, d).where("skill_name not like '%SMALL'").select("skill_id").distinct()
    return graph.linked(V.has_skill(spark, d), people, "person_id", nodes, "skill_id").groupBy("category").agg(F.count("*").alias("n"))


@query("select d.doc_id, coalesce(case when l.toxic = 1 then 'flagged' end, 'person') as kind, coalesce(l.quality, 0) as quality from documents d left join labels l using (doc_id)")
def meta_left_join(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("kind"), "quality")  # noqa: E741
    return table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").fillna({"kind": "person", "quality": 0})


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.REQUIRES} select skill_id, min(skill_name) as skill_name, count(*) as occurrences from (select skill_id, skill_name from person_edges union all select skill_id, skill_name from requires_skill) group by 1")
def skill_catalog(spark, d):
    both = V.person_edges(spark, d).select("skill_id", "skill_name").union(V.requires_skill(spark, d).select("skill_id", "skill_name"))
    named = both.groupBy("skill_id", "skill_name").agg(F.count("*").alias("n"))  # a least text is found by sorting: only among counted names
    return named.groupBy("skill_id").agg(F.min("skill_name").alias("skill_name"), F.sum("n").alias("occurrences"))


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select person_id, array_to_string(list(skill_name order by proficiency desc, skill_name, category)[1:3], '|') as names, list_min(list(proficiency order by proficiency desc, skill_name, category)[1:3]) as least from has_skill where category <> 'soft' group by 1")
def ordered_list(spark, d):
    listed = F.array_sort(F.collect_list(F.struct((-F.col("proficiency")).alias("p"), "skill_name", "category")))
    top = V.has_skill(spark, d).where("category <> 'soft'").groupBy("person_id").agg(F.slice(listed, 1, 3).alias("l"))
    return top.select("person_id", F.array_join(F.transform("l", lambda x: x["skill_name"]), "|").alias("names"), (-F.array_max(F.transform("l", lambda x: x["p"]))).alias("least"))


@query(f"with {V.SKILLS}, {V.REQUIRES} select job_id, array_to_string(list_sort(list(distinct skill_id)), ',') as skills, count(distinct skill_id) as n from requires_skill group by 1")
def skill_sets(spark, d):
    s = V.requires_skill(spark, d).groupBy("job_id").agg(F.array_sort(F.collect_set("skill_id")).alias("s"))
    return s.select("job_id", F.array_join("s", ",").alias("skills"), F.size("s").cast("long").alias("n"))


def raw_skills(spark, d):
    """Part names as raw skills: (raw_name, occurrences)."""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("raw_name")).agg(F.count("*").alias("occurrences"))


_RAWS = "raws as (select p_name as raw_name, count(*) as occurrences from part group by 1)"
_ALIASES = "aliases as (select * from (values ('red widget', 'Widget Red'), ('blue bolt', 'Bolt'), ('hot gear', 'Gear'), ('small gear', 'Gear')) t(alias, canonical_name))"
ALIASES = [("red widget", "Widget Red"), ("blue bolt", "Bolt"), ("hot gear", "Gear"), ("small gear", "Gear")]
_LABELS = "labels_t as (select concat('the ', p_name) as title, concat('uri:', min(p_partkey)) as uri from part where p_size > 10 group by 1)"


def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, canonical_name string")


def ontology(spark, d):
    return table(spark, d, "part").where("p_size > 10").groupBy(F.concat(F.lit("the "), "p_name").alias("title")).agg(F.concat(F.lit("uri:"), F.min("p_partkey")).alias("uri"))


@query(f"with {_RAWS}, {_ALIASES} select raw_name, canonical_name, {V.SLUG.format('canonical_name')} as canonical_id, 'alias' as source, 1.0::double as confidence from raws join aliases on lower(trim(raw_name)) = alias")
def alias_canon(spark, d):
    return canonical.by_alias(raw_skills(spark, d).withColumn("raw_name", F.concat("raw_name")), aliases(spark)).select("raw_name", "canonical_name", "canonical_id", "source", "confidence")


_SET = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_SIM = f"(len(list_intersect({_SET.format('raw_name')}, {_SET.format('title')}))::double / len(list_distinct(list_concat({_SET.format('raw_name')}, {_SET.format('title')}))))"
_ONTO = f"onto as (select raw_name, title, uri, {_SIM} as s from raws, labels_t where {_SIM} >= 0.6 qualify row_number() over (partition by raw_name order by round(s, 9) desc, title) = 1)"


@query(f"with {_RAWS}, {_LABELS}, {_ONTO} select raw_name, title as canonical_name, uri, round(s, 6) as confidence from onto")
def token_set_match(spark, d):
    return canonical.by_ontology(raw_skills(spark, d), ontology(spark, d), 0.6).select("raw_name", "canonical_name", "uri", F.round("confidence", 6).alias("confidence"))


_TITLE = "array_to_string(list_transform(regexp_split_to_array(raw_name, '\\s+'), lambda w: case when w = lower(w) and regexp_matches(w, '[a-z]') then concat(upper(w[1]), w[2:]) else w end), ' ')"


@query(
    f"with {_RAWS}, {_ALIASES}, {_LABELS}, {_ONTO.replace('>= 0.6', '>= 0.7')} select r.raw_name, coalesce(a.canonical_name, o.title, {_TITLE.replace('raw_name', 'r.raw_name')}) as canonical_name, case when a.alias is not null then 'alias' when o.title is not null then 'ontology' else 'raw' end as source, "
    "round(case when a.alias is not null then 1.0 when o.title is not null then o.s else 0.5 end::double, 6) as confidence from raws r left join aliases a on r.raw_name = a.alias left join onto o on o.raw_name = r.raw_name"
)
def single_canon(spark, d):
    return canonical.one(raw_skills(spark, d).select("raw_name"), aliases(spark), ontology(spark, d)).withColumn("confidence", F.round("confidence", 6))


_LAYERS = f"{_RAWS}, {_ALIASES}, layered as (select raw_name, occurrences, canonical_name, {V.SLUG.format('canonical_name')} as canonical_id, 'alias' as source, null as uri, 1.0::double as confidence from raws join aliases on raw_name = alias union all select raw_name, occurrences, split_part(raw_name, ' ', 2), {V.SLUG.format(chr(34) + 'w' + chr(34))}, 'raw', 'u', 0.5 from (select *, split_part(raw_name, ' ', 2) as w from raws) r where raw_name not in (select alias from aliases))"


def layered(spark, d):
    first = canonical.by_alias(raw_skills(spark, d), aliases(spark))
    word = F.element_at(F.split("raw_name", " "), 2)
    second = raw_skills(spark, d).join(aliases(spark).select(F.col("alias").alias("raw_name")), "raw_name", "left_anti").withColumns({"canonical_name": word, "canonical_id": T.service_slug(word), "source": F.lit("raw"), "uri": F.lit("u"), "confidence": F.lit(0.5)})
    return canonical.layers(first, second)


@query(f"with {_LAYERS} select raw_name, occurrences, canonical_name, canonical_id, source, confidence from layered")
def layer_merge(spark, d):
    return layered(spark, d).select("raw_name", "occurrences", "canonical_name", "canonical_id", "source", "confidence")


@query(f"with {_LAYERS} select canonical_id, arg_min(canonical_name, (-occurrences, raw_name)) as canonical_name, array_to_string(list_sort(list(distinct source)), ',') as sources, min(uri) as uri, max(confidence) as confidence, count(*) as n_raw from layered group by 1")
def canonical_rollup(spark, d):
    return canonical.rollup(layered(spark, d))


@query(f"with {_LAYERS} select source, count(*) as n, round(count(distinct canonical_id) / count(*), 3) as ratio, count(*) filter (uri <> '') as with_uri from layered group by 1")
def source_counts(spark, d):
    return layered(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.countDistinct("canonical_id") / F.count("*"), 3).alias("ratio"), F.count(F.when(F.col("uri") != "", 1)).alias("with_uri"))


@query("select 'persons' as \"table\", count(*) as n from customer union all select 'jobs', count(*) from orders union all select 'roles', count(distinct c_mktsegment) from customer union all select 'locations', count(distinct (n_name, r_name)) from nation join region on n_regionkey = r_regionkey union all select 'designations', count(distinct o_orderpriority) from orders")
def graph_counts(spark, d):
    j = V.jobs(spark, d)
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return graph.counts({"persons": V.persons(spark, d), "jobs": j, "roles": table(spark, d, "customer").select("c_mktsegment").distinct(), "locations": places.select("n_name", "r_name").distinct(), "designations": j.select("designation").distinct()})


@query(
    f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL}, {V.REQUIRES}, {V.JOBS} select 'HAS_SKILL' as edge, category as kind, count(*) as n from has_skill group by all union all select 'REQUIRES_SKILL', priority, count(*) from requires_skill group by all "
    "union all select 'IN_INDUSTRY', industry, count(*) from jobs where industry is not null and industry <> '' group by all union all select 'AT_LOCATION', country, count(*) from jobs where city <> '' group by all union all select 'IS_DESIGNATION', designation, count(*) from jobs where designation <> '' group by all"
)
def graph_build(spark, d):
    j = V.jobs(spark, d)
    kinds = {
        "HAS_SKILL": V.has_skill(spark, d).select(F.col("category").alias("kind")), "REQUIRES_SKILL": V.requires_skill(spark, d).select(F.col("priority").alias("kind")), "IN_INDUSTRY": j.where("industry <> ''").select(F.col("industry").alias("kind")),
        "AT_LOCATION": j.where("city <> ''").select(F.col("country").alias("kind")), "IS_DESIGNATION": j.where("designation <> ''").select(F.col("designation").alias("kind")),
    }
    out = None
    for name, df in kinds.items():
        one = df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("edge"), "kind", "n")
        out = one if out is None else out.union(one)
    return out


@query(
    f"with {_RAWS}, {_ALIASES}, {_LABELS}, {_ONTO.replace('>= 0.6', '>= 0.7')}, all_ as (select r.raw_name, {V.SLUG.format('r.raw_name')} as legacy_id, occurrences, coalesce(a.canonical_name, o.title, r.raw_name) as canonical_name, case when a.alias is not null then 'alias' when o.title is not null then 'ontology' else 'raw' end as source, "
    "case when a.alias is null then o.uri end as uri, round(case when a.alias is not null then 1.0 when o.title is not null then o.s else 0.5 end::double, 6) as confidence from raws r left join aliases a on r.raw_name = a.alias left join onto o on o.raw_name = r.raw_name) "
    f"select *, {V.SLUG.format('canonical_name')} as canonical_id from all_"
)
def canonical_run(spark, d):
    skills = raw_skills(spark, d).withColumn("legacy_id", T.service_slug(F.col("raw_name")))
    return canonical.run(skills, aliases(spark), ontology(spark, d)).withColumn("confidence", F.round("confidence", 6))


def graph_tables(spark, d):
    """The graph of the star tables in the shape of the ETL's."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = c.select(F.concat(F.lit("person_"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1.0).alias("years_experience"), F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit(" "), F.col("n_name")).alias("potential_roles"), F.col("c_name").alias("canonical_text"))
    jobs = V.jobs(spark, d).select("id", F.lit("t").alias("title"), "designation", F.when(F.col("industry") == "BUILDING", " ").otherwise(F.col("industry")).alias("industry"), F.when(F.col("country") == "ASIA", None).otherwise(F.col("city")).alias("city"), F.when(F.col("country") == "ASIA", "").otherwise(F.col("country")).alias("country"), F.lit(0).alias("experience_lower"), F.lit(1).alias("experience_upper"), "source", F.lit("x").alias("canonical_text"))
    has = V.has_skill(spark, d).select("person_id", "skill_id", "category", F.lit("l").alias("proficiency_label"), "proficiency", F.lit("resume").alias("source"))
    need = V.requires_skill(spark, d).select("job_id", "skill_id", "priority", F.lit("c").alias("category"), F.lit("s").alias("source"))
    known = V.skills(spark, d).where("skill_id not like '%promo'").groupBy("skill_id", "skill_name").agg(F.count("*").alias("n"))
    canon = known.select(F.col("skill_id").alias("legacy_id"), F.concat(F.lit("c-"), "skill_id").alias("canonical_id"), F.col("skill_name").alias("canonical_name"), F.lit("raw").alias("source"), F.lit(None).cast("string").alias("uri"), F.lit(0.5).alias("confidence"))
    return graph.build(people, has, jobs, need, canon, T.service_slug)


_PLACED = "place as (select * from jobs where country <> 'ASIA'), known as (select distinct skill_id from skills where skill_id not like '%promo')"


@query(
    f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL}, {V.REQUIRES}, {V.JOBS}, {_PLACED}, roles as (select c_mktsegment as t from customer union all select n_name from customer join nation on c_nationkey = n_nationkey), "
    "t as (select 'node_skill' as \"table\", count(*) as n from known union all select 'node_person', count(*) from customer union all select 'node_job', count(*) from jobs union all select 'node_role', count(distinct t) from roles union all select 'edge_can_fill', count(*) from roles "
    "union all select 'node_designation', count(distinct designation) from jobs where trim(designation) <> '' union all select 'edge_is_designation', count(*) from jobs where trim(designation) <> '' union all select 'node_industry', count(distinct industry) from jobs where industry <> 'BUILDING' union all select 'edge_in_industry', count(*) from jobs where industry <> 'BUILDING' "
    "union all select 'node_location', count(distinct (city, country)) from place union all select 'edge_at_location', count(*) from place union all select 'edge_has_skill', count(*) from has_skill where skill_id in (select * from known) union all select 'edge_requires_skill', count(*) from requires_skill where skill_id in (select * from known)) select * from t"
)
def graph_table_counts(spark, d):
    return graph.counts(graph_tables(spark, d))


@query(
    f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select concat('c-', skill_id) as skill_id, category, count(*) as n, cast(sum(proficiency) as bigint) as total from has_skill where skill_id not like '%promo' group by all"
)
def graph_skill_edges(spark, d):
    return graph_tables(spark, d)["edge_has_skill"].groupBy("skill_id", "category").agg(F.count("*").alias("n"), F.sum("proficiency").alias("total"))


@query("select c_custkey, 'customer' as source, c_name as title, c_mktsegment as industry, null as priority from customer union all by name select o_orderkey as c_custkey, 'order' as source, o_orderpriority as priority from orders")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.lit("customer").alias("source"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("industry"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("c_custkey"), F.lit("order").alias("source"), F.col("o_orderpriority").alias("priority"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, s as (select person_id, list(distinct skill_id) as s from person_edges group by 1), p as (select s as anchor from s where person_id = 'person_1') select person_id, round(coalesce(len(list_intersect(s, anchor))::double / nullif(len(list_distinct(list_concat(s, anchor))), 0), 0), 6) as jaccard from s, p")
def jaccard(spark, d):
    s = V.person_edges(spark, d).groupBy("person_id").agg(F.collect_set("skill_id").alias("s"))
    anchor = F.broadcast(s.where("person_id = 'person_1'").select(F.col("s").alias("anchor")))
    return s.join(anchor).select("person_id", F.round(T.jaccard(F.col("s"), F.col("anchor")), 6).alias("jaccard"))


@query(f"with {V.SKILLS} select distinct skill_name, skill_id from skills")
def distinct_pairs(spark, d):
    return V.skills(spark, d).select("skill_name", "skill_id").distinct()


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1")
def merge_upsert(spark, d):
    rows = table(spark, d, "lineitem")
    return graph.upsert(rows, ["l_orderkey", "l_linenumber"], [F.col(c).desc() for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query("select concat('person_', c_custkey) as person_id, unnest([c_mktsegment, c_name]) as role, unnest([1, 3]) as rank from customer")
def role_rank(spark, d):
    p = table(spark, d, "customer").select(F.concat(F.lit("person_"), "c_custkey").alias("id"), F.array(F.col("c_mktsegment"), F.lit("  "), F.col("c_name")).alias("potential_roles"))
    return graph.role_ranks(p)


@query("select event_type, round(sum(value) * 1000 / greatest(count(*), 1), 6) as avg_ms, round(sum(value), 6) as total_ms from events group by 1")
def latency_avg(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return e.select("event_type", F.round(F.col("s") * 1000 / F.greatest("n", F.lit(1)), 6).alias("avg_ms"), F.round("s", 6).alias("total_ms"))


@query("select doc_id, lang, source, n_chars from documents order by n_chars desc, doc_id limit 25")
def ordered_limit(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(25)


@query(
    "select j.o_orderkey, p.c_custkey, count(distinct li.l_partkey) as shared from orders j join customer jc on j.o_custkey = jc.c_custkey join nation on jc.c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join lineitem li on li.l_orderkey = j.o_orderkey "
    "join lineitem lp on lp.l_partkey = li.l_partkey and lp.l_quantity >= 21 join orders po on lp.l_orderkey = po.o_orderkey join customer p on po.o_custkey = p.c_custkey where r_name = 'ASIA' group by 1, 2"
)
def graph_4way(spark, d):
    at = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("jc"))
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    need = o.join(at, F.col("o_custkey") == F.col("jc")).select("o_orderkey").join(li.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_partkey").distinct()
    have = li.where("l_quantity >= 21").join(o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey")), F.col("l_orderkey") == F.col("k")).select("c_custkey", "l_partkey").distinct()
    pairs = need.join(have, "l_partkey").select("o_orderkey", "c_custkey")
    return pairs.repartition("o_orderkey").groupBy("o_orderkey", "c_custkey").agg(F.count("*").alias("shared"))  # few pairs repeat: nothing is gained by counting before they are dealt


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select person_id, cast(sum(proficiency) as bigint) as total, rank from (select person_id, skill_id, proficiency, cast(row_number() over (partition by person_id order by proficiency desc, skill_name, category) as integer) as rank from has_skill) where rank <= 3 group by all")
def detail_order(spark, d):
    w = Window.partitionBy("person").orderBy(F.col("proficiency").desc(), "skill_name", "category")
    top = V.has_skill(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").groupBy("person", "rank").agg(F.sum("proficiency").alias("total"))
    return top.select(F.concat(F.lit("person_"), "person").alias("person_id"), "rank", "total")


_COLUMNS = {"id": "c_custkey", "full_name": "c_name", "yoe": "c_acctbal", "city": "n_name", "skills": "concat(c_mktsegment, ',', n_name, ',x')"}
_MEASURES = " union all ".join(
    f"select '{c}' as col, (select count(distinct {x}) / count(*) from people)::double as u, (select count({x}) / count(*) from people)::double as f, "
    f"(select avg(case when json_valid({x}::varchar) and regexp_matches(trim({x}::varchar), '^[\\[{{]') then 1.0 else 0.0 end) from head where i <= 25) as json, "
    f"(select avg(case when len(regexp_split_to_array({x}::varchar, '[,;|]')) >= 3 then 1.0 else 0.0 end) from head where i <= 25) as delim, "
    f"(select avg(case when try_cast({x}::varchar as double) is not null then 1.0 else 0.0 end) from head where i <= 25) as num, (select avg(len(regexp_extract_all({x}::varchar, '\\S+'))) from head) as tok"
    for c, x in _COLUMNS.items()
)
_FIELDS = ", ".join(f"('{f}', '{k}', '{'|'.join(ps)}')" for f, k, ps in introspect.FIELDS)


_SCORES = (
    f"with people as (select * from customer join nation on c_nationkey = n_nationkey), head as (select *, row_number() over (order by c_custkey) as i from people qualify i <= 50), m as ({_MEASURES}), fields as (select * from (values {_FIELDS}) t(field, kind, part)) "
    "select col as \"column\", field, round(0.6 * case when regexp_matches(col, part) then 1.0 else 0.0 end + 0.4 * case kind when 'primary_key' then 0.7 * u + 0.3 * f when 'numeric' then num when 'json_or_text' then greatest(json, 0.5 * delim, 0.5 * least(tok / 30, 1)) "
    "when 'list_or_csv' then greatest(0.8 * json, delim) when 'long_text' then least(tok / 50, 1) when 'short_text' then greatest(0, least(1 - abs(tok - 4) / 20, 1)) else case when tok between 1.5 and 5 then 1.0 else 0.4 end end, 6)::double as score from m, fields"
)


@query(_SCORES)
def column_field_scores(spark, d):
    return introspect.scores(renamed_people(spark, d), "id")


def renamed_people(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_acctbal").alias("yoe"), F.col("n_name").alias("city"), F.concat("c_mktsegment", F.lit(","), "n_name", F.lit(",x")).alias("skills"))


_ORDERED = ", ".join(f"({i}, '{f}')" for i, (f, *_) in enumerate(introspect.FIELDS, 1))


@query(
    f"with recursive sc as ({_SCORES}), cols as (select * from (values {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(_COLUMNS))}) t(pos, col)), f as (select * from (values {_ORDERED}) t(i, field)), "
    "best as (select f.i, f.field, list(struct_pack(s := sc.score, c := sc.column) order by sc.score desc, cols.pos) as l from f join sc on sc.field = f.field join cols on cols.col = sc.column group by all), "
    "r as (select 0 as i, []::varchar[] as used, null::varchar as field, null::varchar as col, null::double as s union all select b.i, case when pick.s >= 0.45 then list_append(used, pick.c) else used end, b.field, case when pick.s >= 0.45 then pick.c end, pick.s "
    "from (select r.*, b.i as bi, b.field as bf, list_filter(b.l, lambda x: not list_contains(r.used, x.c))[1] as pick from r join best b on b.i = r.i + 1) q join best b on b.i = q.bi) "
    "select field, col as \"column\", round(coalesce(s, 0), 6) as score, case when col is null then 'absent' when s >= 0.7 then 'high' else 'medium' end as confidence from r where i > 0"
)
def field_assignment(spark, d):
    place = {c: i for i, c in enumerate(_COLUMNS)}
    found = sorted(((r.column, r.field, r.score) for r in introspect.scores(renamed_people(spark, d), "id").collect()), key=lambda x: place[x[0]])
    return spark.createDataFrame(introspect.assign(found, [f for f, *_ in introspect.FIELDS]), "field string, column string, score double, confidence string")


@query(
    "select concat('doc_', d.doc_id) as doc_id, case when l.quality is null then 'person' else 'job' end as kind, case when length(s) > 220 then concat(rtrim(substr(s, 1, 219)), '…') else s end as snippet, coalesce(l.toxic, 0) as experience_lower "
    "from (select doc_id, lang, regexp_replace(regexp_replace(coalesce(nullif(case when doc_id % 2 = 0 then '' else lang end, ''), text), '\\s+', ' ', 'g'), '^ | $', '', 'g') as s from documents) d left join labels l using (doc_id)"
)
def entity_meta(spark, d):
    meta = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text = F.coalesce(F.nullif(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.lit("")), F.col("text"))
    return meta.select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.when(F.col("quality").isNull(), "person").otherwise("job").alias("kind"), T.snippet(text).alias("snippet"), F.coalesce("toxic", F.lit(0)).alias("experience_lower"))
