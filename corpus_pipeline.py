"""The corpus pipeline: quality rules, near-dedup, personal data, mixing and packing, over whole documents.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents; columns the stages do not know are carried along, whatever their names. A stage's
result must be written before the next stage is called, which removes the intermediate tables it was made from.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm import mixing, packing, pii, quality_rules, simhash
from twinseek.llm.common import Scratch, table, where_computed

KNOWN = ("doc_id", "text", "lang", "source")
#: Near-duplicates: so many words a shingle, and at least this Jaccard similarity of the shingles.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def _inner(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all others in one."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in KNOWN]
    return docs.select(*KNOWN, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_rest"))


def _outer(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again. n_chars follows the text."""
    back = {c: F.col(f"`{c}`") if c in KNOWN else F.col(f"_rest.`{c}`") for c in docs.columns}
    if "n_chars" in back:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(c.alias(name) for name, c in back.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality_rules.judge(_inner(docs), table(spark, sf_dir, "labels"))
    return _outer(where_computed(judged, F.col("kept")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id; of rows that share it, and after
    all others of rows that lack it, the first by hash of its columns. Groups come from SimHash balls, verified on
    whole texts, and from MinHash bands where fingerprints of similar texts lie beyond the balls."""
    return _outer(simhash.first_of_groups(_inner(docs), NEAR_WORDS, NEAR_SIMILARITY), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by the name of its kind."""
    return _outer(pii.redact(pii.detect(_inner(docs))), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never."""
    rows = _inner(docs)
    rows = rows.withColumn("_key", mixing.row_key(rows))
    units = mixing.mix(rows).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_row"), "copies")
    taken = rows.join(units, (F.col("_key") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return _outer(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, added=True)


_made: dict[SparkSession, list[Scratch]] = {}


def _stage(work):
    """work as a stage: first the intermediate tables of the session's stage before it go."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scratch in _made.pop(spark, []):
            scratch.clear()
        with Scratch.collected(_made.setdefault(spark, [])):
            return work(spark, docs, sf_dir)

    return stage


STAGES = [(name, _stage(work)) for name, work in (("quality_rules", quality), ("simhash_dedup", near_dedup), ("pii", personal_data), ("mixing", mixture), ("packing", packed))]

#: Shingle hashes, learned classifiers and vocabularies have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next, and then removed."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
