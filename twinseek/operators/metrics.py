"""Ranked-retrieval metrics over runs and graded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PANEL = ("recall_10", "recall_100", "mrr_10", "ap", "ndcg_10")


def per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, recall_10, recall_100, mrr_10, ap, ndcg_10) for every query with a judgement; a query without a
    run scores 0. run(qid, doc_id, rank), qrels(qid, doc_id, rel); rel of 1 or more is relevant, gain is linear."""
    ideal = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    wanted = qrels.withColumn("i", F.row_number().over(ideal)).groupBy("qid").agg(
        F.sum((F.col("rel") >= 1).cast("long")).alias("n_rel"), F.sum(F.when(F.col("i") <= 10, F.col("rel") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg")
    )
    hits = run.select("qid", "doc_id", "rank").join(qrels, ["qid", "doc_id"]).where("rel >= 1")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    at = lambda k: (F.col("rank") <= k).cast("long")
    got = hits.withColumn("nth", nth).groupBy("qid").agg(
        F.sum(at(10)).alias("h10"), F.sum(at(100)).alias("h100"), F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("ap_sum"),
        F.sum(F.when(F.col("rank") <= 10, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return wanted.join(got, "qid", "left").select(
        "qid", share("h10", "n_rel").alias("recall_10"), share("h100", "n_rel").alias("recall_100"), F.coalesce(F.when(F.col("first") <= 10, 1.0 / F.col("first").cast("double")), F.lit(0.0)).alias("mrr_10"),
        share("ap_sum", "n_rel").alias("ap"), share("dcg", "idcg").alias("ndcg_10"),
    )


def means(scored: DataFrame, places: int = 6) -> list[Column]:
    return [F.round(F.avg(m), places).alias(m) for m in PANEL]


def cuts(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """(cut, value, n, metrics) overall, per task and per stratum in one pass; a null stratum is 'original'."""
    joined = scored.join(queries.select("qid", "task", F.coalesce("stratum", F.lit("original")).alias("stratum")), "qid")
    cols = ", ".join(f"round(avg({m}), 6) as {m}" for m in PANEL)
    return joined.sparkSession.sql(
        f"select case when grouping(task) = 0 then 'task' when grouping(stratum) = 0 then 'stratum' else 'overall' end as cut, coalesce(task, stratum, 'all') as value, count(*) as n, {cols} "
        "from {scored} group by grouping sets ((), (task), (stratum))",
        scored=joined,
    )


def best_per(rows: DataFrame, group: str, by: str, order: str) -> DataFrame:
    """rows with is_best on the one greatest of `by` in each group; nulls lose, the first in `order` wins ties."""
    window = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), order)
    return rows.withColumn("is_best", (F.row_number().over(window) == 1) & F.col(by).isNotNull())
