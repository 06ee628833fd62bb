"""Vectors: normalising, exact cosine search in Arrow blocks, and a feature-hash encoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import durable
from .lexical import top_k

#: Query vectors held by every task at once, in numbers; more queries go in several passes.
BLOCK_VALUES = 8 << 20


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + 1e-12)))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns inside the JVM."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows."""
    if len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("vectors of one length expected")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def unit(rows: list | np.ndarray) -> np.ndarray:
    m = np.array(rows, np.float64).reshape(len(rows), -1)
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-12)


def search(corpus: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """(qid, doc_id, score, rank): the k nearest of corpus(doc_id, vec) to each of queries(qid, vec) by cosine.

    Exact. The corpus streams through once per block of queries; each batch keeps its k best per query, and a
    window settles the rest. A block's size is bounded by BLOCK_VALUES numbers; the driver holds one block at a
    time, and where there are several each one's result is written before the next is fetched. qid is unique.
    """
    asked = queries.where("vec is not null").select("qid", "vec")
    spark, parts, last = corpus.sparkSession, [], None
    kind = corpus.schema["doc_id"].dataType
    qkind = queries.schema["qid"].dataType.simpleString()
    some = asked.first()
    step = max(1, BLOCK_VALUES // max(1, len(some.vec))) if some else 0
    while step:
        block = (asked if last is None else asked.where(F.col("qid") > last)).orderBy("qid").limit(step).collect()
        if not block:
            break
        last = block[-1].qid
        shared = spark.sparkContext.broadcast(([r.qid for r in block], unit([r.vec for r in block])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in batches:
                vec = b.column("vec")
                if not len(vec):
                    continue
                s = unit(vec.to_pylist()) @ q.T
                ids = b.column("doc_id")
                by_id = np.argsort(np.array(ids.to_pylist(), object), kind="stable")
                best = by_id[np.argsort(-np.round(s[by_id], 9), axis=0, kind="stable")[:k]]
                rows = best.T.ravel()
                cols = np.repeat(np.arange(len(names)), best.shape[0])
                yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in cols]), ids.take(pa.array(rows)), pa.array(s[rows, cols])], ["qid", "doc_id", "score"])

        found = top_k(corpus.where("vec is not null").select("doc_id", "vec").mapInArrow(run, f"qid {qkind}, doc_id {kind.simpleString()}, score double"), k)
        if len(block) < step:
            parts.append(found)
            break
        parts.append(durable(found))
    if not parts:
        return spark.createDataFrame([], f"qid {qkind}, doc_id {kind.simpleString()}, score double, rank int")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def save(corpus: DataFrame, path: str) -> None:
    """corpus(doc_id, vec) as a parquet table of unit vectors; an index that is there already stays as it is."""
    corpus.where("vec is not null").select("doc_id", F.transform(normalised(F.col("vec")), lambda x: x.cast("float")).alias("vec")).write.mode("ignore").parquet(path)


def load(spark, path: str, width: int | None = None) -> DataFrame:
    """A saved index; vectors that are not `width` long are an error."""
    out = spark.read.parquet(path)
    if width is not None and not out.where(F.size("vec") != width).isEmpty():
        raise ValueError(f"vectors of {width} numbers expected")
    return out


def hash_encode(text: Column, width: int = 64) -> Column:
    """Deterministic encoder: every token adds one to the dimension its MD5 names."""
    hashed = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(width)))
    # Each dimension is a letter of its own, so that counting it is one pass over a text without a call for each token.
    letters = F.array_join(F.transform(hashed, lambda h: F.element_at(F.array(*(F.lit(chr(0x100 + i)) for i in range(width))), (h + 1).cast("int"))), "")
    count = lambda at: F.transform(F.array(*(F.lit(chr(0x100 + i)) for i in range(width))), lambda c: (F.length(at) - F.length(F.replace(at, c, F.lit("")))).cast("double"))
    return F.transform(F.array(letters), count)[0]
