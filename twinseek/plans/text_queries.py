"""Queries of the parsing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import views as V
from .base import query, table


@query(f"select distinct concat(p_brand, ' ', p_type, ' / ', p_name) as raw, {V.SLUG.format('concat(p_brand, chr(32), p_type, chr(32), chr(47), chr(32), p_name)')} as slug from part")
def slug(spark, d):
    raw = F.concat_ws("", "p_brand", F.lit(" "), "p_type", F.lit(" / "), "p_name")
    return table(spark, d, "part").select(raw.alias("raw"), T.service_slug(raw).alias("slug")).distinct()


@query("with s as (select doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') as s from documents) select doc_id, case when length(s) > 220 then concat(rtrim(substr(s, 1, 219)), '…') else s end as snippet from s")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(
    "select p_partkey, nullif(trim(concat('  ', p_name, ' ')), '') as cleaned, array_to_string(list_filter(list_transform(string_split(concat(' ', p_name, ', ', p_type, ',, ', p_brand, ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts, "
    "nullif(trim(case when p_partkey % 3 = 0 then '   ' else p_type end), '') as maybe from part"
)
def clean_split(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit(" "), "p_name", F.lit(", "), "p_type", F.lit(",, "), "p_brand", F.lit(","))
    return p.select("p_partkey", T.clean(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("cleaned"), F.array_join(T.split_list(raw), "|").alias("parts"), T.clean(F.when(F.col("p_partkey") % 3 == 0, "   ").otherwise(F.col("p_type"))).alias("maybe"))


_LEVELS = "['Beginner','Advanced Beginner','Competent','Proficient','Expert']"


@query(
    f"select p_partkey, 1 as n, concat(p_brand, ' (', p_type, ', x)') as name, {_LEVELS}[p_size % 5 + 1] as label, cast(p_size % 5 + 1 as integer) as ordinal from part "
    "union all select p_partkey, 2, p_name, 'Beginner', 1 from part union all select p_partkey, 3, concat(p_type, ' (expert)'), 'Beginner', 1 from part"
)
def parse_paren_list(spark, d):
    label = T.label_of((F.col("p_size") % 5 + 1).cast("int"))
    raw = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(", x) ( "), label, F.lit(" ), "), "p_name", F.lit(" , "), "p_type", F.lit(" (expert),  "))
    each = table(spark, d, "part").select("p_partkey", F.posexplode(T.proficiency_skills(raw)).alias("n", "s"))
    return each.select("p_partkey", (F.col("n") + 1).alias("n"), "s.name", "s.label", "s.ordinal")


@query(
    "select c_custkey, concat_ws(chr(10), nullif(trim(case when c_custkey % 4 = 0 then ' ' else c_name end), ''), concat('Skills: ', c_mktsegment), 'Secondary skills: ', concat('Soft skills: ', n_name), "
    "concat('Years experience: ', cast(c_custkey % 7 as varchar), '.0'), concat('Potential roles: ', c_mktsegment, ', ', n_name), concat('Summary: ', c_name)) as person_text, "
    "concat('Designation: ', c_mktsegment, chr(10), 'Primary skills: ', n_name, ', ', c_name, chr(10), 'Secondary skills: ', chr(10), 'Location: ', n_name, ', ', r_name, chr(10), 'Experience: ', c_nationkey, '-', c_nationkey + 2, ' years') as demand_text, "
    "concat('Title: ', c_name, chr(10), 'Industry: ', c_mktsegment, chr(10), 'Location: ', n_name, chr(10), 'Responsibilities:', chr(10), '- ', n_name, chr(10), '- ', r_name, chr(10), 'Must have skills: ', c_mktsegment, chr(10), 'Good to have skills: ', chr(10), 'Other requirements:') as posting_text "
    "from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
)
def canonical_text(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name"))
    none = F.array().cast("array<string>")
    return c.select(
        "c_custkey",
        T.profile_text(name, F.col("c_mktsegment"), F.lit(None).cast("string"), F.col("n_name"), (F.col("c_custkey") % 7).cast("double"), F.concat_ws(", ", "c_mktsegment", "n_name"), F.col("c_name")).alias("person_text"),
        T.demand_text(F.col("c_mktsegment"), F.array("n_name", "c_name"), none, F.col("n_name"), F.col("r_name"), F.col("c_nationkey"), F.col("c_nationkey") + 2).alias("demand_text"),
        T.posting_text(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name"), F.array("n_name", "r_name"), F.array("c_mktsegment"), none, F.lit(None).cast("string")).alias("posting_text"),
    )


_COUNTRY = "case {0} when 'USA' then 'United States' when 'United States of America' then 'United States' when 'UK' then 'United Kingdom' when 'Britain' then 'United Kingdom' else {0} end"
_RAW = "(['USA', ' UK ', 'Britain', '  ', 'United States of America', n_name])[n_nationkey % 6 + 1]"


@query(f"select n_nationkey, {_RAW} as raw, {_COUNTRY.format(f'nullif(trim({_RAW}), chr(0))')} as country from nation where trim({_RAW}) <> '' union all select n_nationkey, {_RAW}, null from nation where trim({_RAW}) = ''")
def country_alias(spark, d):
    raw = F.element_at(F.array(F.lit("USA"), F.lit(" UK "), F.lit("Britain"), F.lit("  "), F.lit("United States of America"), F.col("n_name")), F.col("n_nationkey") % 6 + 1)
    return table(spark, d, "nation").select("n_nationkey", raw.alias("raw"), T.country(raw).alias("country"))


@query(f"with x as (select n_nationkey, n_name, case n_nationkey % 3 when 0 then 'UK' when 1 then concat(r_name, ', IN') end as land from nation join region on n_regionkey = r_regionkey) select n_nationkey, n_name as city, {_COUNTRY.format('land')} as country from x")
def location_split(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(", UK"))).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit(","), "r_name", F.lit(", IN"))).otherwise(F.col("n_name"))
    city, land = T.location(raw)
    return n.select("n_nationkey", city.alias("city"), land.alias("country"))


@query(
    "select p_partkey, coalesce(nullif(trim(case when p_size % 2 = 0 then p_name else ' ' end), ''), p_type) as title, coalesce(case when p_size > 25 then p_size end, 0) as years, "
    "coalesce(case when p_size % 5 = 0 then p_brand end, p_type) as industry from part where p_name is not null and p_name <> ''"
)
def fallbacks(spark, d):
    p = table(spark, d, "part").where("p_name is not null and p_name <> ''")
    title = F.coalesce(T.clean(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ")), F.col("p_type"))
    return p.select("p_partkey", title.alias("title"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(0)).alias("years"), F.coalesce(F.when(F.col("p_size") % 5 == 0, F.col("p_brand")), F.col("p_type")).alias("industry"))


@query("select event_id, case when event_id % 10 = 0 then null else cast(json_extract(props, '$.k') as bigint) end as k from events")
def json_props(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.from_json(raw, "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query(
    "select p_partkey, p_name as title, concat(p_brand, '|', p_type) as duties, p_type as must, p_brand as good, '' as edu, 'second' as repeated, concat(p_name, '|', p_type) as flat from part"
)
def md_sections(spark, d):
    md = F.concat(
        F.lit("intro\r\n## Job Title\n "), "p_name", F.lit(" \n\n## Duties  \n- "), "p_brand", F.lit("\n* "), "p_type", F.lit("\n## Skill Requirements\n**Must Have:**\r\n- "), "p_type",
        F.lit("\n**Preferred:**\n- old\n**Certifications:**\n- none\n**Good to have**\n - "), "p_brand", F.lit("\n## Note\nfirst\n## Note\nsecond"),
    )
    p = table(spark, d, "part").withColumn("m", T.section_map(md))
    need = T.requirement_buckets(F.col("m")["Skill Requirements"])
    flat = T.requirement_buckets(F.concat(F.lit("- "), "p_name", F.lit("\n- "), "p_type"))
    j = lambda c: F.array_join(c, "|")
    return p.select("p_partkey", F.col("m")["Job Title"].alias("title"), j(T.bullets(F.col("m")["Duties"])).alias("duties"), j(need["must"]).alias("must"), j(need["good"]).alias("good"), j(need["edu"]).alias("edu"), F.col("m")["Note"].alias("repeated"), j(flat["must"]).alias("flat"))


@query(
    "select distinct raw, array_to_string(list_transform(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: w <> ''), lambda w: case when w = lower(w) and regexp_matches(w, '[a-z]') then concat(upper(w[1]), w[2:]) else w end), ' ') as title from (select concat(p_name, '  ', p_type, ' c++ iOS') as raw from part)"
)
def titlecase(spark, d):
    raw = F.concat("p_name", F.lit("  "), "p_type", F.lit(" c++ iOS"))
    return table(spark, d, "part").select(raw.alias("raw"), T.title_case(raw).alias("title")).distinct()


@query(f"select concat('doc_', doc_id) as doc_id, cast(len({V.TOKENS.format('text')}) as integer) as n, array_to_string({V.TOKENS.format('text')}[1:5], ' ') as head from documents")
def tokenize(spark, d):
    t = T.tokens(F.col("text"))
    return V.texts(spark, d).select("doc_id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query(
    f"with {V.JUDGEMENTS}, q as (select item_id, [split_part(text, ' ', 1), upper(split_part(text, ' ', 2)), 'zzz'] as s from benchmark), t as (select item_id, d.doc_id, array_to_string(list_filter(s, lambda x: contains(lower(d.text), lower(x))), '|') as m from judgements j join q on j.qid = concat('q_', item_id) join documents d on j.doc_id = concat('doc_', d.doc_id)) "
    "select item_id, doc_id, case when item_id % 2 = 0 then m else '' end as matched from t"
)
def matched_skills(spark, d):
    w = lambda i: F.element_at(F.split("text", " "), F.lit(i))
    q = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("q_"), "item_id").alias("qid"), F.array(w(1), F.upper(w(2)), F.lit("zzz")).alias("s"))
    judged = V.judgements(spark, d).select("qid", F.substring("doc_id", 5, 20).cast("long").alias("doc_id"))
    pairs = judged.join(q, "qid").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return pairs.select("item_id", "doc_id", F.array_join(T.matched_skills(F.col("s"), F.col("text"), F.col("item_id") % 2 == 0), "|").alias("matched"))


@query(
    "select concat('person_', c_custkey) as id, 'person' as kind, case when nullif(trim(case when c_custkey % 3 = 0 then ' ' else c_name end), '') is null then concat('Person ', c_custkey) else c_name end as title, "
    "concat_ws(' · ', nullif(c_mktsegment, 'BUILDING'), n_name) as subtitle, coalesce(nullif(case when c_custkey % 2 = 0 then '' else c_mktsegment end, ''), c_name) as snippet from customer join nation on c_nationkey = n_nationkey"
)
def display_title(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = T.clean(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")))
    return c.select(
        F.concat(F.lit("person_"), "c_custkey").alias("id"), F.lit("person").alias("kind"), F.coalesce(name, F.concat(F.lit("Person "), "c_custkey")).alias("title"),
        F.concat_ws(" · ", F.nullif("c_mktsegment", F.lit("BUILDING")), "n_name").alias("subtitle"), F.coalesce(F.nullif(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("")), F.col("c_name")).alias("snippet"),
    )


@query(
    "select event_id, 'bm25' as stage, round(least(greatest(value / 30 * 100, 2), 100), 6) as width, round(greatest(2, value / max(value) over () * 100), 6) as latency_pct from events "
    "union all select event_id, 'rerank', round(least(greatest(value * 100, 2), 100), 6), round(greatest(2, value / max(value) over () * 100), 6) from events"
)
def score_bar(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    top = e.agg(F.max("value")).first()[0]
    bars = e.select("event_id", F.greatest(F.lit(2.0), F.col("value") / top * 100).alias("pct"), F.expr("stack(3, 'bm25', value / 30, 'rerank', value, 'dense', cast(null as double)) as (stage, share)")).where("share is not null")
    return bars.select("event_id", "stage", F.round(F.least(F.greatest(F.col("share") * 100, F.lit(2.0)), F.lit(100.0)), 6).alias("width"), F.round("pct", 6).alias("latency_pct"))


@query(f"with {V.SKILLS}, {V.PERSON_EDGES}, {V.HAS_SKILL} select person_id, category, cast(count(*) as bigint) as n, cast(count(*) filter (lower(skill_name) in ('brand#1 promo', 'brand#2 small')) as bigint) as n_highlighted from has_skill group by all")
def skill_highlight(spark, d):
    lit = F.array_contains(F.transform(F.array(F.lit("BRAND#1 promo"), F.lit("Brand#2 SMALL")), lambda x: F.lower(x)), F.lower("skill_name"))
    return V.has_skill(spark, d).groupBy("person_id", "category").agg(F.count("*").alias("n"), F.sum(lit.cast("long")).alias("n_highlighted"))


@query(f"select p_partkey, concat(p_brand, ', ', p_type, ' engineer at ', {_LEVELS}[p_size % 5 + 1], ' or higher') as candidate, concat(p_name, ' role with ', p_brand, ', ', p_type) as job from part")
def query_templates(spark, d):
    level = T.label_of((F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.concat_ws(", ", "p_brand", "p_type"), F.lit(" engineer at "), level, F.lit(" or higher")).alias("candidate"), F.concat("p_name", F.lit(" role with "), F.concat_ws(", ", "p_brand", "p_type")).alias("job"))
