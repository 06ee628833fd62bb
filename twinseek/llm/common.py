"""Shared pieces of the corpus-preparation operators: table access, durable intermediate results, columns."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators between words in every contract.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `documents` that operators use; others, whatever their names, are left behind."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang", "source")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where that is unset a folder of
    this machine is made and set, but only for a local master; on a cluster other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_twinseek_shared", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._twinseek_shared = tempfile.mkdtemp(prefix="twinseek-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage, survive lost executors and can be dropped."""

    #: Where collected() gathers the scratches made inside it.
    _gathering: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/twinseek-{uuid.uuid4().hex}", 0
        for made in Scratch._gathering:
            made.append(self)

    @staticmethod
    @contextmanager
    def collected(made: list[Scratch]):
        """Adds every scratch that is made meanwhile to the list, so that clear() can remove it once its results are written."""
        Scratch._gathering.append(made)
        try:
            yield made
        finally:
            Scratch._gathering.remove(made)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._twinseek_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        self._delete(df._twinseek_path)

    def clear(self) -> None:
        """Removes all tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)


def n_words(text: Column) -> Column:
    """Number of words of ASCII-space-separated text, 0 for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(longs: Column) -> Column:
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: a + x)


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array of longs. Sums of whole blocks first, so the work is n * block
    rather than n * n and no array is copied per element."""

    def of(array: Column) -> Column:
        last = F.greatest(F.size(array) - 1, F.lit(0))
        blocks = F.sequence(F.lit(0), (last / block).cast("int"))
        at = lambda i: (i / block).cast("int")

        def placed(before: Column) -> Column:
            starts = F.transform(F.sequence(F.lit(0), last), lambda i: before[at(i)] + total(F.slice(array, at(i) * block + 1, i % block)))
            return F.slice(starts, F.lit(1), F.size(array))

        sums = F.transform(blocks, lambda b: total(F.slice(array, b * block + 1, F.lit(block))))
        return let(sums, lambda s: let(F.transform(blocks, lambda b: total(F.slice(s, F.lit(1), b))), placed))

    return let(lengths, of)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) on columns that are dear to compute. The row number keeps Catalyst from pushing the
    filter below the projection, which would compute those columns once for the filter and once more."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")
