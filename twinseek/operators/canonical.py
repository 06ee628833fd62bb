"""Skill canonicalisation: alias table, ontology labels, greedy embedding clusters, raw names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalise, service_slug, title_case, word_set
from ..session import durable
from .vector import matrix, unit

ONTOLOGY_LEAST, CLUSTER_LEAST = 0.7, 0.92


def by_alias(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """skills(raw_name) matched on aliases(alias, canonical_name) by normalised name; confidence 1."""
    table = aliases.select(F.col("alias").alias("_alias"), "canonical_name")
    return skills.join(table, normalise(F.col("raw_name")) == F.col("_alias")).drop("_alias").withColumns({"canonical_id": service_slug(F.col("canonical_name")), "source": F.lit("alias"), "confidence": F.lit(1.0)})


def by_ontology(skills: DataFrame, labels: DataFrame, least: float = ONTOLOGY_LEAST) -> DataFrame:
    """skills(raw_name) matched on labels(title, uri): the best token-set Jaccard of at least `least`, first title on
    ties. Candidates share a token, so pairs without one are never formed."""
    words = lambda df, c: df.select(c, F.explode(word_set(F.col(c))).alias("_w"))
    pairs = words(skills, "raw_name").distinct().join(words(labels, "title").distinct(), "_w").select("raw_name", "title").distinct()
    scored = pairs.withColumn("confidence", jaccard(word_set(F.col("raw_name")), word_set(F.col("title")))).where(F.col("confidence") >= least)
    best = Window.partitionBy("raw_name").orderBy(F.round("confidence", 9).desc(), "title")
    hit = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").join(labels, "title")
    return skills.join(hit.withColumnRenamed("title", "canonical_name"), "raw_name").withColumns({"canonical_id": service_slug(F.col("canonical_name")), "source": F.lit("ontology")})


#: Numbers in the vectors that the driver looks for leaders in at a time, and in the products that a task holds at once.
BLOCK_VALUES, TILE_VALUES = 1 << 20, 4 << 20


def first_best(s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of s the first column of the greatest value, rounded to 9 places, among those of at least `least`,
    and that value; minus infinity where none is."""
    if not s.shape[1]:
        return np.zeros(len(s), np.int64), np.full(len(s), -np.inf)
    most = s.max(axis=1)
    at = (s >= np.maximum(most - 2e-9, least)[:, None]).argmax(axis=1)
    value = s[np.arange(len(s)), at]
    for i in np.flatnonzero((np.round(value, 9) != np.round(most, 9)) & (most >= least)):
        at[i] = np.flatnonzero((np.round(s[i], 9) == np.round(most[i], 9)) & (s[i] >= least))[0]
        value[i] = s[i, at[i]]
    return at, np.where(most >= least, value, -np.inf)


def leaders(u: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders among the unit vectors u in their order: their places, and for each vector the place in them of the
    leader it joins and the similarity; a leader joins itself."""
    led, at, value = np.zeros(0, np.int64), np.zeros(len(u), np.int64), np.ones(len(u))
    step = max(1, min(256, TILE_VALUES // max(1, len(u))))
    for start in range(0, len(u), step):
        tile, new = u[start : start + step], []
        old_at, old = first_best(tile @ u[led].T, least)
        within = tile @ tile.T
        for i in range(len(tile)):
            k, v = first_best(within[i : i + 1, new], least)
            if max(old[i], v[0]) < least:
                at[start + i] = len(led) + len(new)
                new.append(i)
            elif np.round(old[i], 9) >= np.round(v[0], 9):
                at[start + i], value[start + i] = old_at[i], old[i]
            else:
                at[start + i], value[start + i] = len(led) + k[0], v[0]
        led = np.concatenate([led, start + np.array(new, np.int64)])
    return led, at, value


def cluster(rows: DataFrame, least: float = CLUSTER_LEAST) -> DataFrame:
    """(id, centroid, similarity) of rows(id, vec, ord): leaders in the order of `ord` — a row joins the most
    similar earlier leader if it is at least `least` similar, else it becomes one. ord is a unique long.

    The sequential result in rounds. The driver finds the leaders in a block of the first rows that are still open;
    all later rows are then compared with these, and those that have found one are open no longer. Each row keeps the
    best leader of a round only. Blocks and products are of bounded size; the work is rows times leaders.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, centroid {kind}, similarity double, led_by long"
    rows = durable(rows.select("id", "vec", "ord").repartition(2 * spark.sparkContext.defaultParallelism, "id"))
    some = rows.first()
    step = max(1, BLOCK_VALUES // max(1, len(some.vec))) if some else 1
    left, out = rows, spark.createDataFrame([], schema)
    while block := left.orderBy("ord").limit(step).collect():
        ids, order = [r.id for r in block], np.array([r.ord for r in block])
        u = unit([r.vec for r in block])
        led, at, value = leaders(u, least)
        own = spark.createDataFrame([(i, ids[led[k]], float(v), int(order[led[k]])) for i, k, v in zip(ids, at, value)], schema)
        shared = spark.sparkContext.broadcast(([ids[i] for i in led], order[led], u[led], order))

        def run(batches, shared=shared):
            names, first, q, settled = shared.value
            size = max(1, TILE_VALUES // len(q))
            for b in batches:
                place = b.column("ord").to_numpy(zero_copy_only=False)
                later = np.flatnonzero((place > first[0]) & ~np.isin(place, settled))
                for start in range(0, len(later), size):
                    i = later[start : start + size]
                    s = unit(matrix(b.column("vec").take(pa.array(i)))) @ q.T
                    if place[i].min() <= first[-1]:
                        s[first[None, :] >= place[i][:, None]] = -np.inf
                    k, v = first_best(s, least)
                    i, k, v = i[hit := v >= least], k[hit], v[hit]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(i)), pa.array([names[x] for x in k], b.column("id").type), pa.array(v), pa.array(first[k])], ["id", "centroid", "similarity", "led_by"])

        found = durable(rows.where(F.col("ord") > int(order[led[0]])).mapInArrow(run, schema).union(own))
        shared.destroy()
        out = out.union(found)
        if len(block) < step:
            break
        left = durable(left.where(F.col("ord") > int(order[-1])).join(found.select("id"), "id", "left_anti"))
    best = F.max_by(F.struct("centroid", "similarity"), F.struct(F.round("similarity", 9), -F.col("led_by")))
    return out.groupBy("id").agg(best.alias("b")).select("id", "b.centroid", "b.similarity")


def layers(*found: DataFrame) -> DataFrame:
    """Layers one after another, columns by name."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def one(skills: DataFrame, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of skills(raw_name) with canonical_name, source and confidence: alias, then ontology, then the
    title-cased name with 0.5; a blank name stays with 0."""
    names = skills.select("raw_name").distinct()
    first = by_alias(names, aliases).select("raw_name", F.col("canonical_name").alias("a"))
    second = by_ontology(names.where("trim(raw_name) <> ''"), labels).select("raw_name", F.col("canonical_name").alias("b"), F.col("confidence").alias("c"))
    blank = F.trim(F.coalesce("raw_name", F.lit(""))) == ""
    out = skills.join(first, "raw_name", "left").join(second, "raw_name", "left")
    pick = lambda blank_, alias, label, raw: F.when(blank, blank_).when(F.col("a").isNotNull(), alias).when(F.col("b").isNotNull(), label).otherwise(raw)
    return out.select(
        "raw_name", pick(F.col("raw_name"), F.col("a"), F.col("b"), title_case(F.col("raw_name"))).alias("canonical_name"), pick(F.lit("raw"), F.lit("alias"), F.lit("ontology"), F.lit("raw")).alias("source"),
        pick(F.lit(0.0), F.lit(1.0), F.col("c"), F.lit(0.5)).alias("confidence"),
    )


def run(skills: DataFrame, aliases: DataFrame, labels: DataFrame | None = None, encode=None, least: float = CLUSTER_LEAST) -> DataFrame:
    """All of skills(legacy_id, raw_name, occurrences) through the layers: (raw_name, legacy_id, occurrences,
    canonical_id, canonical_name, source, uri, confidence).

    Names the alias table knows; of the rest those an ontology label (labels(title, uri)) is like; of the rest, with
    encode (a column to its vector), those that join the cluster of a more frequent name; the others stay as they
    are. Leaders are tried by occurrences, then name.
    """
    columns = ("raw_name", "legacy_id", "occurrences", "canonical_id", "canonical_name", "source", "uri", "confidence")
    none = F.lit(None).cast("string")
    first = durable(by_alias(skills, aliases).withColumn("uri", none).select(*columns))
    rest, found = skills.join(first.select("raw_name"), "raw_name", "left_anti"), [first]
    if labels is not None:
        second = durable(by_ontology(rest.where("trim(raw_name) <> ''"), labels).select(*columns))
        rest, found = rest.join(second.select("raw_name"), "raw_name", "left_anti"), [*found, second]
    named = rest.withColumn("canonical_name", F.col("raw_name"))
    if encode is not None:
        order = Window.orderBy(F.col("occurrences").desc(), "raw_name")  # one row a name left over; a range partition and its offsets beyond that
        rows = durable(rest.select("raw_name", F.row_number().over(order).cast("long").alias("id"), encode(F.col("raw_name")).alias("vec")).withColumn("ord", F.col("id")))
        of = cluster(rows.select("id", "vec", "ord"), least).select("id", "centroid")
        led = rows.select("id", "raw_name").join(of, "id").join(rows.select(F.col("id").alias("centroid"), F.col("raw_name").alias("canonical_name")), "centroid").select("raw_name", "canonical_name")
        named = rest.join(led, "raw_name")
    joined = F.col("canonical_name") != F.col("raw_name")
    third = named.withColumns({"canonical_id": service_slug(F.col("canonical_name")), "source": F.when(joined, "embedding").otherwise("raw"), "uri": none, "confidence": F.when(joined, least).otherwise(0.5)})
    return layers(*found, third.select(*columns))


def stats(canonical: DataFrame) -> DataFrame:
    """(total_raw_skills, distinct_canonical_skills, compression_ratio, uris_resolved) of run()."""
    n, ids = F.count("*"), F.countDistinct("canonical_id")
    return canonical.agg(n.alias("total_raw_skills"), ids.alias("distinct_canonical_skills"), F.round(n / F.greatest(ids, F.lit(1)), 3).alias("compression_ratio"), F.count(F.when(F.coalesce("uri", F.lit("")) != "", 1)).alias("uris_resolved"))


def rollup(canonical: DataFrame) -> DataFrame:
    """One row per canonical_id: the first name by occurrences, its sources, a uri, the greatest confidence."""
    key = F.struct(-F.col("occurrences"), F.col("raw_name"))
    return canonical.groupBy("canonical_id").agg(
        F.min_by("canonical_name", key).alias("canonical_name"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("uri").alias("uri"), F.max("confidence").alias("confidence"), F.count("*").alias("n_raw")
    )
