"""Reciprocal rank fusion, reranking of the head, and final results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K = 60
CHANNELS = ("bm25", "dense", "kg")
#: Channels of each mode; the reranked mode splices the head of rrf3.
MODES = {"bm25": ("bm25",), "dense": ("dense",), "rrf": ("bm25", "dense"), "rrf3": CHANNELS, "rrf3_rerank": CHANNELS, "kg_only": ("kg",)}


def rrf(runs: dict[str, DataFrame], keep: int | None = None) -> DataFrame:
    """(qid, doc_id, fused, <channel>_score, <channel>_rank ..., n_candidates, rank) of runs(qid, doc_id, score, rank).

    Ranks come from the channels; fused is the sum of 1 / (60 + rank). Ties go to what came first in the
    channels' order: rank in bm25, then dense, then kg, nulls last.
    """
    union = reduce(DataFrame.union, [df.select("qid", "doc_id", F.lit(name).alias("channel"), "score", "rank") for name, df in runs.items()])
    mine = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v)))
    fused = union.groupBy("qid", "doc_id").agg(
        F.sum(F.lit(1.0).cast("double") / (K + F.col("rank"))).alias("fused"), *(mine(c, v).alias(f"{c}_{v}") for c in CHANNELS for v in ("score", "rank"))
    )
    order = Window.partitionBy("qid").orderBy(F.round("fused", 12).desc(), *(F.col(f"{c}_rank").asc_nulls_last() for c in CHANNELS))
    out = fused.withColumns({"n_candidates": F.count("*").over(Window.partitionBy("qid")), "rank": F.row_number().over(order)})
    return out.where(F.col("rank") <= keep) if keep else out


def single(run: DataFrame, channel: str) -> DataFrame:
    """A channel alone in the shape of rrf(): its own score takes the fused place."""
    null = {f"{c}_{v}": F.lit(None).cast("double" if v == "score" else "int") for c in CHANNELS for v in ("score", "rank") if c != channel}
    return run.select("qid", "doc_id", F.col("score").alias("fused"), F.col("score").alias(f"{channel}_score"), F.col("rank").alias(f"{channel}_rank"), F.count("*").over(Window.partitionBy("qid")).alias("n_candidates"), "rank").withColumns(null)


def fuse(mode: str, runs: dict[str, DataFrame], keep: int | None = None) -> DataFrame:
    """Plan of a mode: only its channels are in it."""
    used = MODES[mode]
    return single(runs[used[0]], used[0]) if len(used) == 1 else rrf({c: runs[c] for c in used}, keep)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Default pair scorer: the share of query tokens the text has, through a sigmoid."""
    q = F.array_distinct(tokens(query))
    share = F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))
    return 1 / (1 + F.exp(-(6 * share - 3)))


Scorer = Callable[[Column, Column], Column]


def rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame, head: int = 25, scorer: Scorer = overlap_scorer, pad: bool = False) -> DataFrame:
    """fused with rerank and the new rank. The first `head` are ordered by the scorer, the others keep theirs; a
    document without a text is scored on an empty one.
    With pad the others get minus their rank for a score, so that a run sorts right by score alone."""
    top = fused.where(F.col("rank") <= head).join(queries.select("qid", F.col("text").alias("_q")), "qid").join(texts.select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    scored = top.withColumn("rerank", F.round(scorer(F.col("_q"), F.coalesce("_t", F.lit(""))), 9)).drop("_q", "_t")
    rest = fused.where(F.col("rank") > head).withColumn("rerank", -F.col("rank").cast("double") if pad else F.lit(None).cast("double"))
    order = Window.partitionBy("qid").orderBy((F.col("old") <= head).desc(), F.when(F.col("old") <= head, F.col("rerank")).desc(), "old")
    return scored.unionByName(rest).withColumnRenamed("rank", "old").withColumn("rank", F.row_number().over(order)).drop("old")


def results(ranked: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """The first k of each query with their entity; a missing one is a blank person."""
    score = F.coalesce("rerank", "fused") if "rerank" in ranked.columns else F.col("fused")
    return ranked.where(F.col("rank") <= k).withColumn("score", score).join(meta, "doc_id", "left").fillna({"kind": "person", "snippet": ""})
