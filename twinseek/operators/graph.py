"""The property graph as node and edge tables, and the skill-overlap channel over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORY_WEIGHT, PRIORITY_WEIGHT
from ..session import durable
from .lexical import top_k


def weight(c: Column, table: dict[str, float]) -> Column:
    out = F.when(F.lit(False), None)
    for name, w in table.items():
        out = out.when(c == name, F.lit(w))
    return out.otherwise(F.lit(1.0))


def query_skill_ids(queries: DataFrame, canonical: DataFrame, slug) -> DataFrame:
    """(qid, pos, skill_id) of queries(qid, query_skills): legacy slugs looked up in canonical(legacy_id,
    canonical_id); order and repeats are kept, unknown skills fall away."""
    each = queries.select("qid", F.posexplode("query_skills").alias("pos", "raw")).withColumn("legacy_id", slug(F.col("raw")))
    return each.join(canonical.select("legacy_id", F.col("canonical_id").alias("skill_id")).distinct(), "legacy_id").select("qid", "pos", "skill_id")


def overlap(asked: DataFrame, edges: DataFrame, doc_id: str, value: Column) -> DataFrame:
    """(qid, doc_id, score, overlap) of asked(qid, skill_id) over edges: a skill asked twice scores twice, all
    edges of a pair add up, the overlap counts it once. Both sides are summed before they meet, and edges of
    skills that nobody asks for are left out before they are summed."""
    wanted = durable(asked.groupBy("qid", "skill_id").agg(F.count("*").alias("_times")))
    named = edges.join(wanted.select("skill_id").distinct(), "skill_id", "left_semi")
    summed = named.groupBy("skill_id", F.col(doc_id).alias("doc_id")).agg(F.sum(value).alias("_value"))
    hits = summed.join(wanted, "skill_id")
    return hits.groupBy("qid", "doc_id").agg(F.sum(F.col("_times") * F.col("_value")).alias("score"), F.count("*").alias("overlap"))


def ranked(asked: DataFrame, edges: DataFrame, key: str, value: Column, k: int, min_overlap: int, named: str) -> DataFrame:
    """(qid, doc_id, score, overlap, rank): the k best by overlap(). Queries that ask for the same skills the same
    number of times are answered once. With named, keys are numbers and doc_id is the number behind that text."""
    times = asked.groupBy("qid", "skill_id").agg(F.count("*").alias("n"))
    same = times.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("skill_id", "n"))).alias("_all"))
    groups = durable(same.groupBy("_all").agg(F.collect_list("qid").alias("qids")).withColumn("_one", F.element_at("qids", 1)))
    once = asked.join(groups.select(F.col("_one").alias("qid")), "qid", "left_semi")
    scored = overlap(once, edges, key, value).where(F.col("overlap") >= min_overlap)
    scored = scored.withColumn("doc_id", F.concat(F.lit(named), "doc_id")) if named else scored
    best = top_k(scored, k, F.col("overlap").desc())
    return best.withColumnRenamed("qid", "_one").join(groups.select("_one", F.explode("qids").alias("qid")), "_one").select("qid", "doc_id", "score", "overlap", "rank")


def persons(asked: DataFrame, has_skill: DataFrame, k: int = 100, min_overlap: int = 1, key: str = "person_id", named: str = "") -> DataFrame:
    """(qid, doc_id, score, overlap, rank) by proficiency times category weight; a null proficiency counts 1."""
    value = F.coalesce("proficiency", F.lit(1)) * weight(F.col("category"), CATEGORY_WEIGHT)
    return ranked(asked, has_skill, key, value, k, min_overlap, named)


def jobs(asked: DataFrame, requires_skill: DataFrame, k: int = 100, min_overlap: int = 1, key: str = "job_id", named: str = "") -> DataFrame:
    """(qid, doc_id, score, overlap, rank) by priority weight."""
    value = weight(F.col("priority"), PRIORITY_WEIGHT)
    return ranked(asked, requires_skill, key, value, k, min_overlap, named)


def upsert(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the given order."""
    last = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def linked(edges: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Edges whose two ends exist."""
    return edges.join(left.select(left_key), left_key, "left_semi").join(right.select(right_key), right_key, "left_semi")


def role_ranks(persons_: DataFrame) -> DataFrame:
    """(person_id, role, rank): 1-based places in potential_roles; blank ones take a place but give no row."""
    each = persons_.select(F.col("id").alias("person_id"), F.posexplode("potential_roles").alias("pos", "role"))
    return each.select("person_id", F.trim("role").alias("role"), (F.col("pos") + 1).alias("rank")).where("role <> ''")


def build(profiles: DataFrame, profile_skills: DataFrame, jobs: DataFrame, job_skills: DataFrame, canonical: DataFrame, slug) -> dict[str, DataFrame]:
    """Node and edge tables of the ETL's tables and canonical(legacy_id, canonical_id, canonical_name, source, uri,
    confidence). Blank roles, designations, industries and places give neither node nor edge; skills that
    canonical does not know give no edge. Edges of one pair are merged as they are written, by upsert."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    place = slug(F.concat_ws("-", blank("city"), blank("country")))
    roles = profiles.select(F.col("id").alias("person_id"), F.posexplode("potential_roles").alias("_i", "_t")).select("person_id", F.trim("_t").alias("title"), (F.col("_i") + 1).alias("rank")).where("title <> ''").withColumn("role_id", slug(F.col("title")))
    placed = jobs.where((blank("city") != "") | (blank("country") != "")).select(F.col("id").alias("job_id"), place.alias("location_id"), blank("city").alias("city"), blank("country").alias("country"))
    named = lambda c: jobs.where(blank(c) != "").select(F.col("id").alias("job_id"), F.trim(c).alias(c))
    ids = canonical.select(F.col("legacy_id").alias("skill_id"), "canonical_id").distinct()
    known = lambda edges: edges.join(ids, "skill_id").drop("skill_id").withColumnRenamed("canonical_id", "skill_id")
    skills = canonical.groupBy(F.col("canonical_id").alias("id")).agg(
        F.min("canonical_name").alias("name"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"), F.min("uri").alias("uri"), F.coalesce(F.max(F.nanvl("confidence", F.lit(0.0))), F.lit(0.0)).alias("confidence")
    )
    filled = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return {
        "node_skill": skills,
        "node_person": profiles.select("id", filled("name"), F.coalesce("years_experience", F.lit(0.0)).alias("years_experience"), filled("canonical_text")),
        "node_job": jobs.select("id", filled("title"), filled("designation"), filled("industry"), F.coalesce("experience_lower", F.lit(0)).alias("experience_lower"), F.coalesce("experience_upper", F.lit(0)).alias("experience_upper"), "source", filled("canonical_text")),
        "node_role": roles.select(F.col("role_id").alias("id"), "title").distinct(),
        "node_designation": named("designation").select(F.col("designation").alias("name")).distinct(),
        "node_industry": named("industry").select(F.col("industry").alias("name")).distinct(),
        "node_location": placed.select(F.col("location_id").alias("id"), "city", "country").distinct(),
        "edge_has_skill": known(profile_skills.select("person_id", "skill_id", "category", "proficiency_label", "proficiency", "source")),
        "edge_requires_skill": known(job_skills.select("job_id", "skill_id", "priority", "category", "source")),
        "edge_can_fill": roles.select("person_id", "role_id", "rank"),
        "edge_is_designation": named("designation"),
        "edge_in_industry": named("industry"),
        "edge_at_location": placed.select("job_id", "location_id"),
    }


def unique(nodes: DataFrame, key: str) -> DataFrame:
    """Values of a key that break its uniqueness, with their counts."""
    return nodes.groupBy(key).count().where("count > 1")


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Nodes before edges, each an overwritten table."""
    for name in sorted(tables, key=lambda n: (not n.startswith("node_"), n)):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def wipe(spark, path: str) -> None:
    """Removes the graph's tables."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.union(one)
    return out
