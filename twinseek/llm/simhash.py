"""SimHash near-dedup by meet-in-the-middle ball hashing, and the distributed components it needs.

Every distinct fingerprint emits all variants within half the radius (itself and its 64 one-bit
neighbours for radius 2). Two fingerprints within the radius share a variant, and two that share one are
within the radius, so after a shuffle on the variants each group is linked as a chain, never as all pairs.
A group holds at most 65 distinct fingerprints, because copies were folded before.

similar_groups is for edited copies, whose fingerprints lie further apart than a ball of all 64 bits reaches. Its
fingerprints are cut into blocks, and every block emits its ball: of two fingerprints within WIDE_RADIUS some block
differs in at most two bits, so they share a variant of it, and all that share one are compared. Of the
pairs within the radius as many become links as connect them, and the Jaccard similarity of the whole texts' shingles
decides. Where that parts a chain, or texts are alike though their fingerprints lie further apart, pairs come from
MinHash bands afterwards. No pair of a band's bucket is left out for the bucket's size: what is not compared is
connected already, or ruled out by the numbers of shingles. Pairs beyond a few predecessors are never made rows: a
large bucket's texts meet in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

HALF_RADIUS = 1
SHINGLE_WORDS = 3
#: Differing bits up to which every pair of fingerprints meets in similar_groups: three to a block, less one.
WIDE_RADIUS = 11
#: MinHash bands and the minima of a band: a pair of Jaccard similarity 0.8 shares no band three times in a million.
BANDS, BAND_ROWS = 32, 5
#: Predecessors in a band's bucket that a document is compared with at first; most of a large group is connected then.
NEIGHBOURS = 8
#: Documents, and shingles, of a block of a large bucket; a task compares two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1 << 20


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of UTF-8 text: a bit is set if over half of the shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return _voted(np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8))


def _voted(raw: np.ndarray) -> int:
    """The bits that over half of the big-endian hashes have, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        votes += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(raw)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct `fp` of nodes exactly as 'at most two differing bits' does."""
    masks = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    balls = nodes.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    chain = Window.partitionBy("variant").orderBy("fp")
    return (
        balls.select("fp", F.lag("fp").over(chain).alias("u"))
        .where(F.col("u").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("u"))) <= 2 * HALF_RADIUS))
        .select("u", F.col("fp").alias("v"))
        .distinct()
    )


def wide_links(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (u, v) of the distinct `fp` of nodes(fp, n, sim) that connect them exactly as 'sim differs in at most
    radius bits, and n is similar enough' does. radius is 3 to 63.

    Blocks of sim emit their balls of half radius HALF_RADIUS. A variant's holders meet in one task, sorted by sim;
    pairs that are connected already, mostly by their neighbours, are not compared, and no pair is made a row before.
    """
    blocks = radius // (2 * HALF_RADIUS + 1) + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    variants = []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        block = F.shiftrightunsigned("sim", low).bitwiseAND(F.lit((1 << high - low) - 1)).bitwiseOR(F.lit(k << high - low).cast("long"))
        # A one before the number of the block: no key of one block is one of another, however wide they are.
        block = block.bitwiseOR(F.lit(1 << (high - low + blocks.bit_length())).cast("long"))
        variants += [block.bitwiseXOR(F.lit(flip).cast("long")) for flip in (0, *(1 << i for i in range(high - low)))]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sim, fp, n in _whole_keys(batches):
            i, j = close_pairs(key, sim.view(np.uint64), n, radius, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["u", "v"])

    balls = nodes.where("n > 0").select(F.explode(F.array(*variants)).alias("key"), "sim", "fp", "n")
    met = balls.repartition("key").sortWithinPartitions("key", "sim", "fp").mapInArrow(meet, "u long, v long")
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first, cut anew so that no value of it is parted."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        rows = [c.to_numpy() for c in b.columns]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if held and (cut or held[-1][0][-1] != rows[0][-1]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in rows])]
            held = []
        elif cut:
            yield [c[:cut] for c in rows]
        held.append([c[cut:] for c in rows])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def close_pairs(key: np.ndarray, sim: np.ndarray, n: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one key whose sim differs in at most radius bits and whose n is similar enough: enough of them to
    connect all that are. Keys ascend."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

    def close(i: np.ndarray, step: int) -> np.ndarray:
        i = i[np.bitwise_count(sim[i] ^ sim[i + step]) <= radius]
        return i[np.minimum(n[i], n[i + step]) >= similarity * np.maximum(n[i], n[i + step])]

    at = np.flatnonzero(np.arange(len(key)) + 1 < end)
    first = close(at, 1)
    left, right = [first], [first + 1]
    # A label is the first row of those connected to it by their neighbours, then any that such share.
    label = np.arange(len(key))
    label[first + 1] = 0
    label = np.maximum.accumulate(label)
    step = 2
    while len(at):
        if step & (step - 1) == 0:
            whole = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            at = at[~np.repeat(whole, sizes)[at]]
        at = at[at + step < end[at]]
        near = close(at, step)
        for i in near[label[near] != label[near + step]].tolist():
            if label[i] != label[i + step]:
                group = label[start[i] : end[i]]
                group[group == label[i + step]] = label[i]
                left.append([i])
                right.append([i + step])
        step += 1
    return np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have a link.

    Alternating large and small stars: every step is a partially aggregated minimum and an equi-join, so a
    hub is never gathered into one task. The number of rounds grows with the logarithm of the longest path.
    """
    pairs = scratch.keep(links.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    seen = mark(pairs)
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
        then = scratch.keep(small.distinct())
        now = mark(then)
        scratch.drop(pairs)
        pairs = then
        if now == seen:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the shingles of UTF-8 text, ascending; words as in fingerprint()."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), ">u8").astype(np.uint64))


def _signed(data: bytes, seed: int = 0) -> int:
    return int.from_bytes(xxhash.xxh64_digest(data, seed), "big", signed=True)


def set_fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles, each counted once: equal sets have equal ones."""
    return _voted(shingles.astype(">u8").view(np.uint8).reshape(-1, 8))


def shingle_key(text: bytes, width: int) -> int:
    """A number that texts share if they have the same set of shingles."""
    return _signed(shingle_set(text, width).tobytes())


_random = np.random.default_rng(42)
_FACTORS, _TERMS = (_random.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)


def bands(shingles: np.ndarray) -> list[int]:
    """One hash for each band of the MinHash of a set; none for the empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return [_signed(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, BAND_ROWS))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar_groups(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(signed, roots): all rows of docs(text, ...) with _fp, shingle_key of the text, and _rid, a number of the row;
    and (node, root) for every _fp that is linked to another: the least _fp of its component. Texts are linked where
    their sets of width-word shingles have at least that Jaccard similarity.

    Pairs come from SimHash balls. Where these leave texts apart, pairs come from MinHash buckets, each document first
    with its NEIGHBOURS predecessors; then, where a larger bucket still holds several components, all members of
    different components in blocks. Pairs are verified on whole texts. Null and word-free texts have one _fp and are
    like each other only.
    """
    spark = docs.sparkSession
    scratch, names = Scratch(spark), docs.columns
    schema = T.StructType([*docs.schema.fields, *spark.createDataFrame([], "_fp long, _n long, _sim long, _bands array<long>").schema.fields])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py() or b"", width) for t in b.column("text").cast(pa.binary())]
            more = [pa.array([f(s) for s in sets], pa.int64()) for f in (lambda s: _signed(s.tobytes()), len, set_fingerprint)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], [*names, "_fp", "_n", "_sim", "_bands"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[shingle_set(t.as_py() or b"", width) for t in b.column(c).cast(pa.binary())] for c in ("text_u", "text_v")]
            yield b.select(["u", "v"]).filter(pa.array([jaccard(x, y) >= similarity for x, y in zip(*sets)], pa.bool_()))

    signed = scratch.keep(docs.mapInArrow(sign, schema).withColumn("_rid", F.monotonically_increasing_id()))
    nodes = signed.select(F.col("_fp").alias("fp"), F.col("_n").alias("n"), F.col("_sim").alias("sim")).distinct()
    close = scratch.keep(wide_links(nodes, WIDE_RADIUS, similarity))
    bucket = Window.partitionBy("band").orderBy("fp")
    posts = scratch.keep(signed.groupBy(F.col("_fp").alias("fp"), F.col("_n").alias("n")).agg(F.first("_bands").alias("bands")).select("fp", "n", F.explode("bands").alias("band")))
    before = F.array(*(F.struct(F.lag("fp", k).over(bucket).alias("u"), F.lag("n", k).over(bucket).alias("m")) for k in range(1, NEIGHBOURS + 1)))
    fits = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m)
    near = posts.select("fp", "n", before.alias("before")).select("fp", "n", F.posexplode("before").alias("nth", "b")).where("b.u is not null")
    near = scratch.keep(near.groupBy(F.col("b.u").alias("u"), F.col("fp").alias("v")).agg(F.min("nth").alias("nth"), F.first(fits(F.col("n"), F.col("b.m"))).alias("fits")))
    # One row of each text that has a neighbour. By the row's number, so that many copies of a text are no hot key, and
    # always a merge join: the plan is then the same at every size.
    ends = near.select("u", "v").union(close).select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    rows = signed.groupBy(F.col("_fp").alias("fp")).agg(F.min("_rid").alias("rid")).join(ends, "fp").select("rid")
    texts = scratch.keep(signed.select(F.col("_fp").alias("fp"), "text", F.col("_bands").alias("bands"), "_rid").join(rows.hint("merge"), F.col("_rid") == F.col("rid")).select("fp", "text", "bands"))

    def verified(pairs: DataFrame) -> DataFrame:
        end = lambda c: texts.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
        return scratch.keep(pairs.select("u", "v").join(end("u"), "u").join(end("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(verify, "u long, v long"))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")

    roots = components(verified(close), scratch)
    more = lambda links: components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links), scratch)
    # Of the bands, direct predecessors first. They join most of a large group, so that few of the other pairs need their texts.
    for nth in ("nth = 0", "nth > 0"):
        pairs = scratch.keep(apart(near.where("fits").where(nth), roots))
        if not pairs.isEmpty():
            roots = more(verified(pairs))
    links = scratch.keep(_across(posts, texts, roots, width, similarity))
    if not links.isEmpty():
        roots = more(links)
    for done in (close, posts, near, texts):
        scratch.drop(done)
    return signed.drop("_n", "_sim", "_bands"), roots


def _across(posts: DataFrame, texts: DataFrame, roots: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between components that share a bucket of more than NEIGHBOURS + 1 texts. Such a bucket is cut
    into blocks of bounded size, and each task compares the texts of two blocks, so that a bucket's pairs are
    never rows. A pair that shares several buckets is compared in the first."""
    whole = Window.partitionBy("band")
    large = posts.withColumns({"size": F.count("*").over(whole), "shingles": F.sum("n").over(whole)}).where(F.col("size") > NEIGHBOURS + 1)
    member = large.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    several = member.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("band")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = member.join(several, "band").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    each = placed.select("band", "fp", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("band", "fp", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        rows = table.sort_by("fp")
        fps, block, band = rows.column("fp").to_numpy(), rows.column("block").to_numpy(), rows.column("band")[0].as_py()
        shared = np.array(rows.column("bands").to_pylist(), np.int64)
        at = int(np.flatnonzero(shared[0] == band)[0])
        alone = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        links = link_sets([shingle_set(t.as_py() or b"", width) for t in rows.column("text").cast(pa.binary())], rows.column("root").to_numpy(), similarity, shared[:, :at], None if alone else block)
        return pa.table([pa.array([int(fps[i]) for i, _ in links], pa.int64()), pa.array([int(fps[j]) for _, j in links], pa.int64())], ["u", "v"])

    return each.join(texts, "fp").groupBy("band", "low", "high").applyInArrow(compare, "u long, v long")


def link_sets(sets: list[np.ndarray], roots: np.ndarray, similarity: float, before: np.ndarray, parts: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets at least `similarity` alike that connect different roots, enough of them to connect all
    that are. Pairs that agree in a column of `before` are left to others, and with parts those of one part."""
    n = np.array([len(s) for s in sets], np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(number, kind="stable")
    owners, first = owner[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
    starts, label, out = np.concatenate([[0], np.cumsum(n)]), np.unique(roots, return_inverse=True)[1], []
    for i in range(1, len(sets)):
        may = (label[:i] != label[i]) & (np.minimum(n[:i], n[i]) >= similarity * np.maximum(n[:i], n[i]))
        if parts is not None:
            may &= parts[:i] != parts[i]
        may = np.flatnonzero(may)
        if len(may) and before.shape[1]:
            may = may[~(before[may] == before[i]).any(axis=1)]
        if not len(may):
            continue
        if len(may) < 16:
            common = np.array([len(np.intersect1d(sets[j], sets[i], assume_unique=True)) for j in may])
        else:
            mine = number[starts[i] : starts[i + 1]]
            common = np.bincount(np.concatenate([owners[first[k] : first[k + 1]] for k in mine]), minlength=len(sets))[may]
        for j in may[common >= similarity * (n[may] + n[i] - common) - 1e-9]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def similar_documents(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of docs(doc_id, text), as near_duplicates, but linked as
    similar_groups links. fp is shingle_key."""
    signed, roots = similar_groups(docs.select("doc_id", "text"), width, similarity)
    fps = signed.select("doc_id", F.col("_fp").alias("fp"))
    return _placed(fps, fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), roots)


def first_of_groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """One row of each group of similar documents, with all columns of docs(doc_id, text, ...): that with the least
    doc_id, a null one last; of rows that share it the first by hash of its columns. Rows without a doc_id are
    grouped like any other. No rows give none."""
    signed, roots = similar_groups(docs, width, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.xxhash64("text", F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))).alias("h"), "_rid")
    rows = signed.select("_fp", order.alias("o")).join(roots, F.col("_fp") == F.col("node"), "left")
    chosen = rows.groupBy(F.coalesce("root", "_fp").alias("root")).agg(F.min("o").alias("o")).select(F.col("o._rid").alias("_chosen"))
    # Always a merge join: the rows that stay grow with the corpus, and the plan is then the same at every size.
    return signed.join(chosen.hint("merge"), F.col("_rid") == F.col("_chosen")).select(*(F.col(f"`{c}`") for c in docs.columns))


def _placed(fps: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """fps(doc_id, fp) with the root and the least doc_id of each row's component."""
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of docs(doc_id, text).

    root is the least fingerprint of the component. component_id is the smallest doc_id reachable over links of two or fewer differing bits.
    Null and word-free texts have fingerprint 0 and link like any other. Rows that repeat a doc_id keep a
    row each. A null doc_id is never a component_id unless nothing else is reachable. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.keep(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(ball_links(nodes), scratch)
    return _placed(fps, nodes, roots)


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
