"""Quality rules: counts per document and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials over the buckets are estimated,
one from trusted documents and one from the whole raw corpus; a document's score is the log-likelihood ratio
between them divided by its number of n-grams, and a fixed threshold decides. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS = 1 << 14
#: Trusted documents of the target multinomial, at most; the first by hash of doc_id. The raw corpus has no bound.
TRUSTED_ROWS = 5000
#: Mean log-likelihood ratio below which a document is rejected.
THRESHOLD = -0.08
#: Pseudo-counts of the target multinomial, spread as the raw corpus is: a bucket that few trusted documents could
#: have reached says little, so clean documents are not rejected for words of their own.
PRIOR = 20.0 * BUCKETS
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, "     "), " "), "")


def with_counts(docs: DataFrame) -> DataFrame:
    """docs(text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    # Arrays meet as arguments, never as outer references inside a lambda: a filter that Catalyst pushes down
    # repeats these expressions, and an outer reference would then be computed once per element.
    out = docs.withColumns({"_words": words_of(text), "_lines": lines})
    n = F.size("_words")
    pairs = F.zip_with("_words", F.slice("_words", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    grams = F.zip_with(pairs, F.slice("_words", F.lit(3), n), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    out = out.withColumn("_grams", F.slice(grams, F.lit(1), F.greatest(n - 2, F.lit(0))))
    # Only texts with a repeated window are sorted: equal windows become neighbours, with their places.
    placed = F.when(F.size(F.array_distinct("_grams")) == F.size("_grams"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    out = out.withColumn("_placed", placed)
    twins = F.zip_with(
        "_placed",
        F.slice("_placed", F.lit(2), F.size("_placed")),
        lambda x, y: F.when(x["h"] == y["h"], F.array(*(p["i"] + k for p in (x, y) for k in range(3)))).otherwise(F.array().cast("array<int>")),
    )
    covered = F.size(F.array_distinct(F.flatten(twins)))
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, " " + BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    ).drop("_words", "_lines", "_grams", "_placed")


def failed() -> Column:
    """The base verdict on with_counts()."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_buckets(docs: DataFrame) -> DataFrame:
    """docs(text) with _ngrams: the buckets of every word, then of every pair of neighbours, the first after a start mark."""
    out = docs.withColumn("_hashes", F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.col("_hashes")), "_hashes", lambda a, b: bucket(F.xxhash64(a, b)))
    return out.withColumn("_ngrams", F.concat(F.transform("_hashes", bucket), F.slice(pairs, F.lit(1), F.size("_hashes")))).drop("_hashes")


def ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of each bucket. trusted holds at most TRUSTED_ROWS doc_ids; no trusted text: all 0."""
    flags = F.broadcast(trusted.select(F.col("doc_id").alias("_trusted")))
    grams = with_buckets(docs.select("doc_id", "text")).join(flags, F.col("doc_id") == F.col("_trusted"), "left")
    counts = grams.select(F.explode_outer("_ngrams").alias("bucket"), F.col("_trusted").isNotNull().cast("long").alias("good")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()
    n_raw, n_good = sum(r.raw for r in counts), sum(r.good for r in counts)
    out = [0.0] * BUCKETS
    if n_good:
        for r in counts:
            out[r.bucket] = math.log((r.good * n_raw / r.raw + PRIOR) / (n_good + PRIOR))
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with the five counts, base_failed, llr and kept.

    labels(doc_id, quality) names the trusted documents (quality 1). Null and empty texts have no words, so
    base_failed. A text without n-grams has llr 0. Rows that repeat a doc_id are judged one by one and count
    towards the multinomials one by one. Without trusted documents llr is 0 and the base rules alone decide.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    trusted = scratch.keep(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS))
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios(docs, trusted))), ",").cast("array<double>")
    out = with_buckets(with_counts(docs))
    total = F.aggregate("_ngrams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    return (
        out.withColumns({"base_failed": failed(), "llr": F.when(F.size("_ngrams") > 0, total / F.size("_ngrams")).otherwise(0.0)})
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))
        .drop("_ngrams")
    )
