"""Document fingerprints by spot signatures.

A common word is an anchor; the two content words after it, other common words skipped, are its chain, and
anchor and chain together are a signature. A document's fingerprint is its set of signatures. Sets are
partitioned by their length so that only sets of the same or the neighbouring partition can be similar
enough, and Jaccard is not computed where the lengths alone rule it out. Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "como con del el es las los más no para por se su una y"
)
#: Rows of a block whose order is settled in one task, blocks at most, and sampled rows that choose a block's bounds.
BLOCK_ROWS, MOST_BLOCKS, SAMPLED = 256, 1 << 14, 16
#: Code points of a text that bounds look at among rows of one doc_id.
HEAD = 12


def signatures(text: Column) -> Column:
    """Distinct signatures of a whole text as a sorted array of longs, one for every anchor. A text without spots has
    its words for signatures, one without words itself, and an empty one none."""
    any_of = "|".join(sorted(set(ANCHORS.split())))
    spot = rf"(?<![^ ])((?:(?:{any_of}) )++)([^ ]++ )(?=(?:(?:{any_of}) )*+([^ ]++)?)"
    flat = F.concat(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.split(F.regexp_replace(flat, spot, "\n$1\t$2$3\n"), "\n")
    mark = lambda x: F.shiftrightunsigned(F.xxhash64(x), 32)
    # Neighbouring anchors share the chain after them.
    anchors, chain = (lambda x: F.split(F.rtrim(F.substring_index(x, "\t", 1)), " ")), (lambda x: F.substring_index(x, "\t", -1))
    spots = F.flatten(F.transform(F.filter(marked, lambda x: x.contains("\t")), lambda x: F.transform(anchors(x), lambda a: mark(F.concat(a, F.lit("\t"), chain(x))))))
    words = F.sort_array(F.array_distinct(F.transform(F.split(F.trim(flat), " "), mark)))
    alone = F.when(text == "", F.array().cast("array<bigint>")).when(F.trim(flat) == "", F.array(mark(text))).otherwise(words)
    return let(F.sort_array(F.array_distinct(spots)), lambda s: F.when(F.size(s) > 0, s).otherwise(alone))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def length_partition(n: Column, threshold: float) -> Column:
    """Partition of a set length: sets at least `threshold` alike are in the same or in neighbouring ones."""
    return F.floor(F.log(n + 1.0) / -math.log(threshold))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def pruned_jaccard(a: Column, b: Column, threshold: float) -> Column:
    """Jaccard of two sets, 0 where their lengths keep it below threshold; 1 for two empty sets."""

    def of(x: Column) -> Column:
        def of_both(y: Column) -> Column:
            small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
            far = F.abs(length_partition(F.size(x), threshold) - length_partition(F.size(y), threshold)) > 1
            return F.when((large > 0) & (far | (small < threshold * large)), 0.0).otherwise(jaccard(x, y))

        return let(b, of_both)

    return let(a, of)


def blocks(rows: DataFrame) -> Column:
    """Block of a row of (doc_id, text) in ascending order of (doc_id, nulls last; text): bounds from a sample by hash,
    so blocks hold about as many rows each however ids lie, and rows of one id are parted by how their texts begin.
    The bounds set task sizes only; the driver holds at most MOST_BLOCKS * SAMPLED of them."""
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("i"), F.substr("text", F.lit(1), F.lit(HEAD)).alias("t"))
    n = rows.count()
    wanted = min(MOST_BLOCKS, n // BLOCK_ROWS)
    if not wanted:
        return F.lit(0)
    least = int(-(1 << 63) + min(1.0, wanted * SAMPLED / n) * ((1 << 64) - 1025))
    some = sorted((r.n, r.i, r.t) for r in rows.where(F.xxhash64("doc_id", F.substr("text", F.lit(1), F.lit(HEAD))) <= least).select(place.alias("p")).select("p.*").distinct().collect())
    ends = some[SAMPLED - 1 :: SAMPLED]
    width = max(1, math.isqrt(len(ends)))  # two levels: which run of bounds, which bound in it
    runs = [[{"n": n, "i": i, "t": t} for n, i, t in ends[a : a + width]] for a in range(0, len(ends), width)]
    bounds = F.from_json(F.lit(json.dumps(runs)), "array<array<struct<n:boolean,i:bigint,t:string>>>")
    below = lambda bs, p: F.size(F.filter(bs, lambda b: b < p))
    run = lambda p: F.size(F.filter(bounds, lambda bs: F.element_at(bs, -1) < p))
    found = let(place, lambda p: let(run(p), lambda k: k * width + F.coalesce(below(F.get(bounds, k), p), F.lit(0))))
    return F.coalesce(found, F.lit(0))  # never null, so that no join filters nulls out below the one shuffle


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with sigs, next_text and next_sigs: the text after it by doc_id and its signatures, after the last the first.

    Rows that share a doc_id go by text; a null doc_id goes last; null texts are empty. Texts are written to one
    shuffle, by block, and signatures are taken once from each text; what follows a block's last row is the first
    of the next block that has rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.withColumn("block", blocks(rows)).repartition("block")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    after = F.lead(F.struct("text", "sigs")).over(order)
    placed = dealt.withColumn("sigs", signatures(F.col("text"))).withColumn("after", after)
    # No row number here: Spark would take the first rows before the shuffle too, and shuffle texts twice.
    firsts = dealt.withColumn("before", F.lag(F.lit(1)).over(order)).where("before is null").select("block", F.struct("text", signatures(F.col("text")).alias("sigs")).alias("first"))
    turn = Window.orderBy("block")  # at most MOST_BLOCKS + 1 numbers
    numbers = firsts.select("block")
    follow = numbers.select("block", F.lead("block").over(turn).alias("next_block"), F.min("block").over(Window.partitionBy()).alias("start"))
    follow = follow.select(F.col("block").alias("_block"), F.coalesce("next_block", "start").alias("next_block"))
    follow = follow.join(firsts.select(F.col("block").alias("next_block"), "first"), "next_block").select("_block", "first")
    full = placed.join(follow, F.col("block") == F.col("_block")).withColumn("after", F.coalesce("after", "first"))
    return full.select("doc_id", "text", "sigs", F.col("after.text").alias("next_text"), F.col("after.sigs").alias("next_sigs"))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, sigs, edited_sigs, next_sigs, near_edited, near_next) for every row of docs(doc_id, text).

    edited is the text with its last quarter of code points replaced by the first as many (or all) of the next
    document. An only document follows itself. Likenesses are exact. No rows give none.
    """
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    out = with_next(docs).withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    near = lambda other: jaccard(F.col("sigs"), F.col(other))
    return out.withColumns({"near_edited": near("edited_sigs"), "near_next": near("next_sigs")}).drop("next_text")


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members(doc_id, class_id) puts documents of one signature set into a class named by its
    least doc_id; pairs(a, b, likeness) holds every two classes, a < b, at least `threshold` alike.

    Sets meet only within a partition of set lengths or with the next one, and only over a signature among the
    first |A| - ceil(threshold |A|) + 1 of either, rarest first, which two similar sets cannot both lack; the
    lengths prune a pair before its Jaccard is computed. Empty sets are one class and pair with none. Rows
    without a doc_id are left out.
    """
    rows = docs.where("doc_id is not null").select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    key = F.xxhash64("sigs")
    names = rows.groupBy(key.alias("_k"), "sigs").agg(F.min("doc_id").alias("class_id"))
    members = rows.withColumn("_k", key).join(names, ["_k", "sigs"]).select("doc_id", "class_id")
    sets = names.where(F.size("sigs") > 0).select("class_id", "sigs", F.size("sigs").alias("n"))
    each = sets.select("class_id", "n", F.explode("sigs").alias("sig"))
    rare = each.groupBy("sig").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    head = each.join(rare.where("df > 1"), "sig", "left").withColumn("nth", place).where(F.col("df").isNotNull())
    head = head.where(F.col("nth") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).withColumn("part", length_partition(F.col("n"), threshold)).select("class_id", "n", "sig", "part")
    left = head.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = head.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "part")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["sig", "part"]).where(ordered & (F.col("na") >= threshold * F.col("nb"))).select("a", "b").distinct()
    own = lambda c: sets.select(F.col("class_id").alias(c), F.col("sigs").alias(f"s{c}"))
    scored = found.join(own("a"), "a").join(own("b"), "b").withColumn("likeness", pruned_jaccard(F.col("sa"), F.col("sb"), threshold)).where(F.col("likeness") >= threshold)
    return members, scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
