"""Query sets with graded judgements made from the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_either, label_of


def seeded(df: DataFrame, key: str, n: int, seed: int = 42, prefix: str = "q") -> DataFrame:
    """n rows in the order of the hash of seed and key, with qid <prefix>_000 on; the same on every engine."""
    mark = F.md5(F.concat(F.lit(f"{seed}#"), F.col(key)))
    picked = df.withColumn("_m", mark).orderBy("_m", key).limit(n)
    order = Window.orderBy("_m", key)  # over n rows
    return picked.withColumn("qid", F.concat(F.lit(f"{prefix}_"), F.format_string("%03d", F.row_number().over(order) - 1))).drop("_m")


def top_skills(edges: DataFrame, entity: str, order: list, n: int = 3) -> DataFrame:
    """(entity, names, values, n_skills): the first n skills of each entity in an order of (columns) and the count."""
    best = Window.partitionBy(entity).orderBy(*order)
    ranked = edges.withColumns({"_n": F.row_number().over(best), "_all": F.count("*").over(Window.partitionBy(entity))}).where(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", "skill_name", "value")))
    return ranked.groupBy(entity).agg(listed.alias("_l"), F.max("_all").alias("n_skills")).select(entity, F.transform("_l", lambda x: x["skill_name"]).alias("names"), F.transform("_l", lambda x: x["value"]).alias("values"), "n_skills")


def candidate_queries(edges: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Queries for people with three or more skills that are not soft: their three best, worded with the least level."""
    hard = edges.where("category <> 'soft'").repartition("person_id").groupBy("person_id", "skill_name").agg(F.max("proficiency").alias("value"))
    top = top_skills(hard, "person_id", [F.col("value").desc(), "skill_name"]).where("n_skills >= 3")
    picked = seeded(top, "person_id", n, seed, "cand")
    level = F.array_min("values").cast("int")
    return picked.select(
        "qid", F.lit("candidate_search").alias("task"), F.concat(F.array_join("names", ", "), F.lit(" engineer at "), label_of(level), F.lit(" or higher")).alias("text"), F.col("person_id").alias("anchor_id"),
        F.col("names").alias("query_skills"), level.alias("min_proficiency_ordinal"), F.col("n_skills").alias("anchor_skill_count"),
    )


def job_queries(job_skills: DataFrame, titles: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Queries for jobs(job_id, title) with a title and a skill: the first three by priority and name."""
    rows = job_skills.repartition("job_id").groupBy("job_id", "skill_name").agg(F.min("priority").alias("value"))
    top = top_skills(rows, "job_id", ["value", "skill_name"]).join(titles.where("title <> ''"), "job_id")
    picked = seeded(top, "job_id", n, seed, "job")
    return picked.select("qid", F.lit("job_search").alias("task"), F.concat(F.col("title"), F.lit(" role with "), F.array_join("names", ", ")).alias("text"), F.col("job_id").alias("anchor_id"), F.col("names").alias("query_skills"), F.col("title").alias("designation"))


def judge(queries: DataFrame, edges: DataFrame, entity: str, least_overlap: int = 2, threshold: float = 0.5) -> DataFrame:
    """(qid, doc_id, rel, overlap, jaccard): 2 for the anchor, 1 for entities whose skill set is at least
    `threshold` alike and shares min(least_overlap, number of query skills). Only entities that share a skill
    are looked at; the others cannot qualify."""
    sets = edges.select(F.col(entity).alias("doc_id"), "skill_name").repartition("doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("skill_name")).alias("_s"))
    asked = queries.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("query_skills"))).alias("_q")).select("qid", F.size("_q").alias("n_q"), F.explode("_q").alias("skill_name"))
    each = sets.select("doc_id", F.size("_s").alias("n_d"), F.explode("_s.skill_name").alias("skill_name")).join(asked, "skill_name")
    shared = each.groupBy("doc_id", "n_d", "qid", "n_q").agg(F.count("*").alias("overlap"))
    scored = shared.withColumn("jaccard", F.col("overlap") / (F.col("n_q") + F.col("n_d") - F.col("overlap")))
    near = scored.where((F.col("overlap") >= F.least(F.lit(least_overlap), F.col("n_q"))) & (F.col("jaccard") >= threshold))
    anchors = queries.select("qid", F.col("anchor_id").alias("doc_id"), F.lit(2).alias("rel"))
    return near.select("qid", "doc_id", F.lit(1).alias("rel")).union(anchors).groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))


def judge_jobs(queries: DataFrame, edges: DataFrame, titles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """judge() for jobs, where the title of one must contain the other's as well."""
    rows = judge(queries, edges, "job_id", 1, threshold)
    named = rows.join(queries.select("qid", F.lower(F.trim("designation")).alias("_a"), "anchor_id"), "qid").join(titles.select(F.col("job_id").alias("doc_id"), F.lower(F.trim("title")).alias("_b")), "doc_id")
    return named.where((F.col("rel") == 2) | contains_either(F.col("_a"), F.col("_b"))).select("qid", "doc_id", "rel")


#: Words whose hash brings a text and a passage together: those after a passage's first, which may be cut.
KEY_WORDS = 5
#: First words of the hashed ones up to which texts are hashed only where one of them stands.
NAMED_WORDS = 2_000


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) where texts(doc_id, text) hold the whole text of passages(item_id, text).

    Texts and passages meet over the hash of KEY_WORDS words inside the passage, and the whole passage is looked
    for only then. Passages of fewer words are looked for in every text.
    """
    words = F.split("text", r"\s+")
    key = lambda w, at: F.xxhash64(F.array_join(F.slice(w, at, KEY_WORDS), " "))
    long = passages.where(F.size(words) >= KEY_WORDS + 2).select("item_id", F.col("text").alias("_p"), key(words, F.lit(2)).alias("_k"))
    n = F.size("_w")
    starts = [r[0] for r in passages.where(F.size(words) >= KEY_WORDS + 2).select(F.element_at(words, 2)).distinct().limit(NAMED_WORDS + 1).collect()]
    at = F.sequence(F.lit(1), F.greatest(n - KEY_WORDS + 1, F.lit(1)))
    at = at if len(starts) > NAMED_WORDS else F.filter(at, lambda i: F.get(F.col("_w"), i - 1).isin(*starts))
    keys = F.array_distinct(F.transform(at, lambda i: key(F.col("_w"), i)))
    each = texts.withColumn("_w", words).select("doc_id", F.explode(keys).alias("_k"))
    near = each.join(long.select("item_id", "_k"), "_k").select("doc_id", "item_id").distinct()
    found = near.join(long.select("item_id", "_p"), "item_id").join(texts, "doc_id").where(F.contains(F.col("text"), F.col("_p")))
    short = passages.where(F.size(words) < KEY_WORDS + 2).select("item_id", F.col("text").alias("_p"))
    everywhere = texts.join(short, F.contains(F.col("text"), F.col("_p")))
    return found.select("doc_id", "item_id").union(everywhere.select("doc_id", "item_id")).distinct()


def paraphrases(queries: DataFrame, cache: DataFrame, write, styles: tuple[str, ...]) -> DataFrame:
    """(source_qid, paraphrased_qid, task, anchor_id, original_text, paraphrased_text, style, query_skills) of the
    originals among queries: from the cache where it has them, else by write, any function from
    (source_qid, text, style) to the same with paraphrased_text. Styles go round by the hash of the qid. What the
    writer leaves blank is left out, so that it is asked again."""
    style = F.element_at(F.array(*map(F.lit, styles)), (F.pmod(F.xxhash64("qid"), F.lit(len(styles))) + 1).cast("int"))
    own = queries.where(~F.col("qid").endswith("_p")).select(F.col("qid").alias("source_qid"), F.concat("qid", F.lit("_p")).alias("paraphrased_qid"), "task", "anchor_id", F.col("text").alias("original_text"), "query_skills", style.alias("style"))
    new = own.join(cache.select("source_qid"), "source_qid", "left_anti")
    said = write(new.select("source_qid", F.col("original_text").alias("text"), "style")).where("trim(paraphrased_text) <> ''").select("source_qid", F.trim("paraphrased_text").alias("paraphrased_text"))
    columns = ("source_qid", "paraphrased_qid", "task", "anchor_id", "original_text", "paraphrased_text", "style", "query_skills")
    return cache.select(*columns).join(own.select("source_qid"), "source_qid", "left_semi").select(*columns).union(new.join(said, "source_qid").select(*columns))


def inherit(paraphrases: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judgements of paraphrases(qid, source_qid): those of their sources."""
    return paraphrases.join(qrels.withColumnRenamed("qid", "source_qid"), "source_qid").select("qid", "doc_id", "rel")


def rewrite(queries: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Originals, once per qid, and then the paraphrases; earlier paraphrases (qid ending in _p) give way."""
    originals = queries.where(~F.col("qid").endswith("_p")).join(paraphrases.select("qid"), "qid", "left_anti").dropDuplicates(["qid"])
    return originals.unionByName(paraphrases, allowMissingColumns=True)
