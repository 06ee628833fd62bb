"""BM25 over tables: postings, document lengths, term counts; many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import durable

K1, B = 1.5, 0.75


@dataclass
class Index:
    """postings(term, doc_id, tf, and dl if no doc_id repeats), docs(doc_id, dl), terms(term, df), and the number and mean length of documents."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    n: int
    avgdl: float

    def save(self, path: str, buckets: int = 0) -> None:
        """Parquet tables; postings are range-partitioned by term, so a query's terms prune row groups."""
        self.postings.repartitionByRange(buckets or 32, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.sparkSession.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double").write.mode("overwrite").parquet(f"{path}/corpus")


def load(spark, path: str) -> Index:
    n, avgdl = spark.read.parquet(f"{path}/corpus").first()
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "docs", "terms")), n, avgdl)


#: Query terms up to which tokens are left out before anything is written or shuffled: as names in the plan, by a broadcast of them.
NAMED_TERMS, MOST_TERMS = 20_000, 100_000


def build(corpus: DataFrame, only: DataFrame | None = None) -> Index:
    """Index of corpus(doc_id, text). Documents without tokens count in the number and mean length. With
    only(qid, text), an index for those queries: postings of other terms are left out before anything is written
    if the terms are few, and as late as the search itself if they are many. Texts are cut into tokens once: the
    tokens are an intermediate table. If no doc_id repeats, a term's documents are counted where they lie, and postings
    have the length of their document (dl)."""
    cut = corpus.select("doc_id", tokens(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
    wanted = None
    if only is not None:
        wanted = query_terms(only).select("term").distinct()
        few = [r.term for r in wanted.limit(NAMED_TERMS + 1).collect()]
        if len(few) <= min(NAMED_TERMS, MOST_TERMS):
            named = ", ".join(f"'{t}'" for t in few) or "''"  # tokens have no quotes
            cut, wanted = cut.withColumn("tokens", F.expr(f"filter(tokens, t -> t in ({named}))")), None
        elif wanted.limit(MOST_TERMS + 1).count() > MOST_TERMS:
            wanted = None
    cut = durable(cut)
    docs = cut.select("doc_id", "dl")
    n, avgdl, ids = docs.agg(F.count("*"), F.avg("dl"), F.countDistinct("doc_id")).first()
    keep = lambda each: each if wanted is None else each.join(F.broadcast(wanted), "term", "left_semi")
    key = ["doc_id", "dl"] if ids == n else ["doc_id"]
    postings = keep(cut.repartition("doc_id").select(*key, F.explode("tokens").alias("term"))).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    once = keep(cut.select(F.explode(F.array_distinct("tokens")).alias("term"))) if ids == n else postings
    return Index(postings, docs, once.groupBy("term").agg(F.count("*").alias("df")), n, avgdl or 0.0)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times) of queries(qid, text); a repeated term counts as often as it stands there."""
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of every document with a query term."""
    asked = durable(query_terms(queries).join(index.terms, "term"))  # read again, its size is known: if it is small, postings stay where they are
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / index.avgdl))
    rows = index.postings if "dl" in index.postings.columns else index.postings.join(index.docs, "doc_id")
    hits = rows.join(asked, "term")
    return hits.select("qid", "doc_id", (F.col("times") * idf * weight).alias("part")).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def top_k(scored: DataFrame, k: int, *more) -> DataFrame:
    """The k best rows of each qid with rank, by score rounded to 9 places, then `more`, then doc_id."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), *more, "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 100, pad_zero: bool = True) -> DataFrame:
    """(qid, doc_id, score, rank). With pad_zero each query gets k documents, those without any query term last
    with score 0 in order of doc_id; only the first 2 k ids can be among them."""
    found = top_k(scores(index, queries), k).select("qid", "doc_id", "score", "rank")
    if not pad_zero:
        return found
    found = durable(found)  # at most k rows a query, read three times below
    have = queries.select("qid").distinct().join(found.groupBy("qid").agg(F.count("*").alias("have")), "qid", "left").fillna(0, ["have"]).where(F.col("have") < k)
    first = index.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    spare = have.join(F.broadcast(first)).join(found.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))
    padded = spare.withColumn("nth", nth).where(F.col("have") + F.col("nth") <= k)
    return found.union(padded.select("qid", "doc_id", F.lit(0.0), (F.col("have") + F.col("nth")).cast("int")))
