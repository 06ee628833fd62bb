"""Column profiles, value shapes, and the mapping of columns to canonical fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE_ROWS, TOKEN_ROWS = 25, 50
ABSENT, HIGH = 0.45, 0.7

# The canonical fields in their order, the kind of value each holds and the patterns of its name.
FIELDS = (
    ("id", "primary_key", ("^id$", "^profile_?id$", "^user_?id$", "^uuid$", "^_id$")),
    ("name", "person_name", ("^(full_?)?name$", "^display_?name$", "^person$")),
    ("headline", "short_text", ("^headline$", "^tagline$", "^title$", "^heading$")),
    ("summary", "long_text", ("^summary$", "^bio$", "^about$", "^description$", "^profile$")),
    ("skills", "list_or_csv", ("^skills?$", "^skill_?list$", "^technologies$", "^tech$")),
    ("experience", "json_or_text", ("^experiences?$", "^work_?history$", "^positions?$", "^career$")),
    ("education", "json_or_text", ("^educations?$", "^schools?$", "^degrees?$", "^academic")),
    ("location", "short_text", ("^location$", "^city$", "^region$", "^geo$", "^address$", "^based_?in$")),
    ("years_experience", "numeric", ("^years?_?(of_)?exp(erience)?$", "^total_?exp", "^yoe$")),
    ("current_company", "short_text", ("^current_?company$", "^company$", "^employer$", "^org(anisation)?$")),
    ("current_title", "short_text", ("^current_?title$", "^role$", "^position$", "^job_?title$")),
    ("industry", "short_text", ("^industry$", "^sector$", "^domain$", "^vertical$")),
)


def profile(df: DataFrame) -> DataFrame:
    """(name, dtype, null_pct, n_distinct, sample) of each column: shares and samples in one pass, different values of
    all columns in another, in which each value is a key and nothing is sorted."""
    kinds, texts = df.dtypes, [F.col(f"`{c}`").cast("string") for c, _ in df.dtypes]
    aggs = [x for i, v in enumerate(texts) for x in (F.avg(v.isNull().cast("double")).alias(f"n{i}"), F.min(F.when(F.trim(v) != "", F.substring(v, 1, 80))).alias(f"s{i}"))]
    each = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.lit(t).alias("dtype"), F.round(100 * F.coalesce(F.col(f"n{i}"), F.lit(0.0)), 4).alias("null_pct"), F.col(f"s{i}").alias("sample")) for i, (c, t) in enumerate(kinds)]
    shares = df.agg(*aggs).select(F.explode(F.array(*each)).alias("x")).select("x.*")
    values = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(texts)))).alias("x")).select("x.i", "x.v").where("v is not null")
    counts = values.distinct().groupBy("i").agg(F.count("*").alias("n_distinct"))
    return shares.join(counts, "i", "left").select("name", "dtype", "null_pct", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "sample")


def shapes(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row: shares of JSON-like, delimited and numeric values among the first SHAPE_ROWS, mean number of
    tokens of the first TOKEN_ROWS, by key, nulls left out."""
    first = df.where(F.col(column).isNotNull()).select(key, F.col(column).cast("string").alias("v")).orderBy(key).limit(TOKEN_ROWS)
    head = first.orderBy(key).limit(SHAPE_ROWS)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    a = head.agg(share(F.try_parse_json("v").isNotNull() & F.trim("v").rlike(r"^[\[{]")).alias("json"), share(F.size(F.split("v", "[,;|]")) >= 3).alias("delimited"), share(F.col("v").try_cast("double").isNotNull()).alias("numeric"))
    b = first.agg(F.round(F.avg(F.size(F.regexp_extract_all("v", F.lit(r"\S+"), F.lit(0)))), 6).alias("tokens"))
    return a.crossJoin(b)


def scores(df: DataFrame, key: str) -> DataFrame:
    """(column, field, score): 0.6 for the name, whole or in part, and 0.4 for the shape of the values."""
    spark, n = df.sparkSession, df.count()
    measured = None
    for c, _ in df.dtypes:
        shape = shapes(df, c, key).select(F.lit(c).alias("column"), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("json", "delimited", "numeric", "tokens")))
        measured = shape if measured is None else measured.union(shape)
    keys = df.agg(*(F.struct((F.countDistinct(f"`{c}`") / max(1, n)).alias("u"), (F.count(f"`{c}`") / max(1, n)).alias("f")).alias(c) for c, _ in df.dtypes))
    keys = keys.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.u"), F.col(f"`{c}`.f")) for c, _ in df.dtypes))).alias("x")).select("x.*")
    fields = spark.createDataFrame([(f, k, "|".join(f"(?:{p.strip('^$')})" for p in ps), "|".join(ps)) for f, k, ps in FIELDS], "field string, kind string, whole string, part string")
    name = F.replace(F.lower(F.trim("column")), F.lit(" "), F.lit("_"))
    named = F.when(F.regexp_like(name, F.concat(F.lit("^(?:"), "whole", F.lit(")$"))), 1.0).when(F.regexp_like(name, F.col("part")), 0.6).otherwise(0.0)
    words = F.col("tokens")
    value = (
        F.when(F.col("kind") == "primary_key", 0.7 * F.col("u") + 0.3 * F.col("f")).when(F.col("kind") == "numeric", F.col("numeric"))
        .when(F.col("kind") == "json_or_text", F.greatest("json", 0.5 * F.col("delimited"), 0.5 * F.least(words / 30, F.lit(1.0)))).when(F.col("kind") == "list_or_csv", F.greatest(0.8 * F.col("json"), F.col("delimited")))
        .when(F.col("kind") == "long_text", F.least(words / 50, F.lit(1.0))).when(F.col("kind") == "short_text", F.greatest(F.lit(0.0), F.least(1 - F.abs(words - 4) / 20, F.lit(1.0)))).otherwise(F.when(words.between(1.5, 5), 1.0).otherwise(0.4))
    )
    return measured.join(keys, "column").join(fields).select("column", "field", F.round(0.6 * named + 0.4 * value, 6).alias("score"))


def assign(scores: list[tuple[str, str, float]], fields: list[str]) -> list[tuple[str, str | None, float, str]]:
    """(field, column, score, confidence): fields in their order take the best column left, the first on ties."""
    out, used = [], set()
    for f in fields:
        best = None
        for column, field, s in scores:
            if field == f and column not in used and (best is None or s > best[1]):
                best = (column, s)
        if best is None or best[1] < ABSENT:
            out.append((f, None, 0.0 if best is None else best[1], "absent"))
            continue
        used.add(best[0])
        out.append((f, best[0], best[1], "high" if best[1] >= HIGH else "medium"))
    return out
