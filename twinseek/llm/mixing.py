"""Mixing sources to target weights by pivotal dependent rounding.

Every document wants target / source_size copies of itself. The whole part is granted; the fractional parts
are rounded in pairs: mass (words) moves from one document to the other in a random direction, weighted so
that the expected copies stay, until one of the two is integral; the other goes on to the next pair. Words
are conserved at every step. Groups of documents leave one residual per source, residuals meet again in
groups of groups, and so on up a reduction tree, until one per source is left and is rounded to the nearest.
The random numbers are hashes of the rows, so reruns agree. Each group also passes on a few undecided documents of
every size as change: at the root the last fraction is rounded and the words it misses are made up by rounding
change the other way, so that a long document left to the end does not leave its source off target.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_words

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents of a leaf of the reduction tree, and children of an inner node. They set task sizes only.
LEAF, FAN = 4000, 32
#: Undecided documents of a source that a group passes on, for each power of two of words.
CHANGE = 6
#: Sources of a group above the leaves, on average.
SOURCES = 32
EPS = 1e-12
_STATE = "node long, source string, doc_id long, row_key long, copies_of_row long, size long, whole long, part double, done boolean"


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words wanted of each source: 100 % of all words by weight, at most MOST_COPIES times its own, the
    excess shared again by weight among the sources below that until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    total, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        unit = (total - sum(out.values())) / sum(weight[s] for s in open_)
        above = {s: float(MOST_COPIES * sizes[s]) for s in open_ if unit * weight[s] > MOST_COPIES * sizes[s]}
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        out |= above
        open_ = [s for s in open_ if s not in above]
    return out


def uniform(key: int, level: int) -> float:
    """A number in [0, 1) from a row's key (splitmix64)."""
    z = (key + (level + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return (z ^ z >> 31) / 2.0**64


def pivot(parts: list[float], masses: list[float], keys: list[int], level: int) -> int | None:
    """Rounds parts in place; the index that stays fractional, if one does."""
    held = None
    for j in range(len(parts)):
        if parts[j] < EPS or parts[j] > 1 - EPS:
            parts[j] = float(round(parts[j]))
            continue
        if held is None:
            held = j
            continue
        i, a, b = held, masses[held], masses[j]
        to_i = min((1 - parts[i]) * a, parts[j] * b)
        to_j = min(parts[i] * a, (1 - parts[j]) * b)
        move = to_i if uniform(keys[i] ^ keys[j], level) * (to_i + to_j) < to_j else -to_j
        parts[i] += move / a
        parts[j] -= move / b
        for k in (i, j):
            if parts[k] < EPS or parts[k] > 1 - EPS:
                parts[k] = float(round(parts[k]))
        held = i if 0 < parts[i] < 1 else j if 0 < parts[j] < 1 else None
    return held


def make_up(parts: list[float], masses: list[float], fractional: list[bool], miss: float) -> float:
    """Rounds units the other way while that brings the words taken nearer to those wanted: from the largest down all
    that do not pass the mark, then the unit, or the pair of one more and one less, that fits best, again and again.
    miss is how many words too many are taken; what is left of it is returned. Only units whose share was
    fractional can go either way."""
    able = sorted((k for k in range(len(parts)) if fractional[k]), key=lambda k: (masses[k], k))
    for k in reversed(able):
        turned = masses[k] if parts[k] == 0 else -masses[k]
        if turned * miss < 0 and abs(turned) <= abs(miss):
            parts[k], miss = 1 - parts[k], miss + turned
    while True:
        more, less = ([k for k in able if parts[k] == x] for x in (0, 1))
        sizes = [masses[k] for k in less]
        near = [(abs(miss + masses[i]), (i,)) for i in more] + [(abs(miss - masses[j]), (j,)) for j in less]
        near += [(abs(miss + masses[i] - masses[less[j]]), (i, less[j])) for i in more for at in [bisect_left(sizes, miss + masses[i])] for j in (at - 1, at) if 0 <= j < len(sizes)]
        rest, turn = min(near, default=(math.inf, ()))
        if rest >= abs(miss) - EPS:
            return abs(miss)
        for k in turn:
            miss += masses[k] if parts[k] == 0 else -masses[k]
            parts[k] = 1 - parts[k]


def change(masses: list[float], keys: list[int]) -> set[int]:
    """CHANGE units of every power of two, by key."""
    kept: dict[int, int] = {}
    out = set()
    for k in sorted(range(len(masses)), key=lambda k: (keys[k], masses[k])):
        level = int(masses[k]).bit_length()
        if kept.get(level, 0) < CHANGE:
            kept[level] = kept.get(level, 0) + 1
            out.add(k)
    return out


def settle(parts: list[float], masses: list[float], keys: list[int], level: int, last: bool) -> list[bool]:
    """Rounds the parts of one source's units in place, large units first; tells which are decided."""
    order = sorted(range(len(parts)), key=lambda k: (-masses[k], keys[k]))
    spare = set() if last else change(masses, keys)
    chosen = [k for k in order if k not in spare]
    fractional = [EPS < p < 1 - EPS for p in parts]
    mine = [parts[k] for k in chosen]
    left = pivot(mine, [masses[k] for k in chosen], [keys[k] for k in chosen], level)
    done = [k not in spare or not fractional[k] for k in range(len(parts))]
    if left is not None and last:
        near, mass, able, tried = round(mine[left]), [masses[k] for k in chosen], [fractional[k] for k in chosen], []
        for end in (near, 1 - near):  # the farther one only if it ends nearer
            ways = [float(end) if k == left else p for k, p in enumerate(mine)]
            tried.append((make_up(ways, mass, able, (end - mine[left]) * mass[left]), ways))
        mine = min(tried, key=lambda x: x[0])[1]
    elif left is not None:
        done[chosen[left]] = False
    for k, p in zip(chosen, mine):
        parts[k] = p
    return done


def rounded(level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "row_key", "doc_id"], na_position="last", kind="stable").reset_index(drop=True)
        done, part = [True] * len(group), group["part"].tolist()
        mass, key = (group["size"] * group["copies_of_row"]).tolist(), group["row_key"].tolist()
        for at in group.groupby("source", dropna=False, sort=False).indices.values():
            for i in at:
                if mass[i] <= 0:  # no words: no mass to pair
                    part[i] = float(uniform(key[i], level) < part[i])
            heavy = [i for i in at if mass[i] > 0]
            mine = [part[i] for i in heavy]
            decided = settle(mine, [float(mass[i]) for i in heavy], [int(key[i]) for i in heavy], level, last)
            for i, p, d in zip(heavy, mine, decided):
                part[i], done[i] = p, d
        return group.assign(part=part, done=done)

    return run


def row_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row_key, copies_of_row, size, source_size, target, copies) for each distinct row of
    docs(doc_id, text, lang, source).

    Rows alike in all four columns are one unit and get the same number of copies each; rows that only share
    a doc_id are decided one by one. A null source is a source of its own, the last. Texts without words
    count 0 and are rounded on their own. If a source has no words its target is 0. An empty table gives none.
    A source's words miss its target by what its undecided units cannot make up, usually a few words. The
    table of sources (a name and two numbers each) is the only thing the driver sees.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    units = scratch.keep(docs.select("doc_id", "source", row_key(docs).alias("row_key"), n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "row_key", "size").agg(F.count("*").alias("copies_of_row")))
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies_of_row")).alias("words"), F.count("*").alias("n")).collect()
    want = targets({r.source: r.words for r in found})
    sources = scratch.keep(spark.createDataFrame([(r.source, r.words, want[r.source]) for r in found], "name string, source_size long, target double").coalesce(1))
    leaves = max(1, -(-sum(r.n for r in found) // LEAF))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = units.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        F.pmod(F.xxhash64("row_key"), F.lit(leaves)).alias("node"), "source", "doc_id", "row_key", "copies_of_row", "size", F.floor(each).alias("whole"), (each - F.floor(each)).alias("part"), F.lit(False).alias("done")
    )
    level, decided = 0, []
    while True:
        last = leaves == 1
        key = ["node"] if level == 0 else ["node", F.pmod(F.xxhash64("source"), F.lit(max(1, len(found) // SOURCES)))]
        state = scratch.keep(state.groupBy(*key).applyInPandas(rounded(level, last), _STATE))
        decided.append(state.where("done"))
        if last:
            break
        leaves = -(-leaves // FAN)
        state = state.where("not done").withColumn("node", F.floor(F.col("node") / FAN))
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "source", "row_key", "copies_of_row", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("long").alias("copies")
    )
