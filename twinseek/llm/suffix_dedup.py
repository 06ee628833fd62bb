"""Exact removal of repeated 50-byte strings by a hash-compared suffix sort.

Texts are dealt into chunks. A prefix polynomial hash (modulo 2^64) gives the hash of any substring in one
step. Each 50-byte window is named by the least hash of the K-byte strings in it, so equal windows have the
same name wherever they stand, and neighbouring windows mostly share a name; a run of windows with one name
is handled together.

1. Every chunk reports its distinct names (a few bytes each), dealt by name. Names found in one document only
   cannot hold a repeat and are dropped; the answer is two bits a name.
2. Chunks send the bytes of the runs that are left, once per chunk, with the least doc_id that has them.
   Where a name has several different runs, all their windows are suffixes to sort: mergesort, comparing
   two suffixes by a binary search for their common extension over prefix hashes, then verifying that
   neighbours taken for equal have equal bytes. The answer is, per run, the least doc_id and the windows
   that a smaller doc_id has too.
3. Chunks cut the covered bytes out.

A name with very many different runs would gather them all in one task. Its runs are cut into their windows and
these are dealt by the hash of their bytes instead of by name: salt for a hot name that keeps equal windows
together. They are runs of one window each, sent as bytes and sorted and verified like all others.

What one chunk tells one bucket is folded first (a name, run or window once), so popular strings cost one
entry per chunk. All steps are one plan: the dealt texts are one exchange that is read three times, and a
lost executor's part is computed again from the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 50
K = 24
SPAN = WINDOW - K + 1  # K-byte strings of a window, and most windows of a run
WIDTH = -(-(SPAN + WINDOW) // 8) * 8  # more than the bytes of a run, in whole words of 8
#: Bytes of text in a chunk, and bytes hashed at a time. They set task and array sizes only.
CHUNK, BLOCK = 6 << 20, 1 << 18
#: Estimated different runs from which on a name is dealt by window. A chunk reports a name as found in one document,
#: in several, or with FEW or POPULAR different runs, rounded down. They set task sizes only.
FEW, POPULAR = 32, 512
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: none is later
U = np.uint64


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of a base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        up, down = np.full(n + 1, base, U), np.full(n + 1, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hashes:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.up, self.down = powers(base, BLOCK + 2 * WINDOW)
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]


class RowHashes:
    """Prefix polynomial hashes of rows of WIDTH bytes, of which the last is never used; a place is row * WIDTH + offset."""

    def __init__(self, rows: np.ndarray):
        up, self.down = powers(BASES[0], BLOCK + 2 * WINDOW)
        self.prefix = np.zeros((len(rows), WIDTH), U)
        np.cumsum((rows[:, :-1].astype(U) + U(1)) * up[: WIDTH - 1], axis=1, out=self.prefix[:, 1:])
        self.flat = self.prefix.reshape(-1)

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.flat[at + length] - self.flat[at]) * self.down[at % WIDTH]

    def names(self) -> np.ndarray:
        """Hashes of all K-byte strings of each row."""
        n = WIDTH - K
        return mixed((self.prefix[:, K:] - self.prefix[:, :-K]) * self.down[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


class Chunk:
    """The texts of a chunk end to end, and their runs: start, number of windows, name, hash of the bytes, document."""

    def __init__(self, doc_ids: np.ndarray, texts: list[bytes]):
        self.ids = doc_ids
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        found = [self._runs(a, min(len(self.data), a + BLOCK)) for a in range(0, len(self.data), BLOCK)]
        self.start, self.count, self.name, self.hash = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found) if found else ((),) * 4, (np.int64, np.int64, U, U)))
        self.doc = np.repeat(doc_ids, np.diff(np.append(0, np.searchsorted(self.start, self.ends))))

    def _runs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that start in [a, b). A block's edge splits a run, which changes no result."""
        part = self.data[a : b + WINDOW - 1]
        n = len(part) - WINDOW + 1  # windows that fit
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        h = Hashes(part)
        m = len(part) - K + 1
        least = mixed((h.prefix[K:] - h.prefix[:-K]) * h.down[:m])
        for step in (1, 2, 4, 8, SPAN - 16):
            least = np.minimum(least[:-step], least[step:])
        valid = np.zeros(n + 1, np.int32)
        lo, hi = np.searchsorted(self.ends, [a, b + WINDOW])
        for end in self.ends[lo : hi + 1]:  # windows that would cross the end of a text
            x, y = max(0, end - WINDOW + 1 - a), min(n, end - a)
            if x < y:
                valid[x] += 1
                valid[y] -= 1
        ok = np.cumsum(valid[:-1]) == 0
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
        edge = first.copy()
        edge[1:] |= ok[1:] != ok[:-1]
        at = np.flatnonzero(edge)
        count = np.diff(np.append(at, n))
        keep = ok[at]
        at, count = at[keep], count[keep]
        parts = -(-count // SPAN)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, left = np.repeat(at, parts) + nth * SPAN, np.repeat(count, parts) - nth * SPAN
            count = np.minimum(left, SPAN)
        return at + a, count, least[at], mixed(h.of(at, count + WINDOW - 1) + count.astype(U))

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct names, level of each: 0 .. 3 for one document, several, FEW and POPULAR different runs; name of each run)."""
        order = np.lexsort((self.hash, self.name))
        name, doc, run = self.name[order], self.doc[order], self.hash[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        other = new.copy()
        other[1:] |= run[1:] != run[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return name, np.zeros(0, np.uint8), np.zeros(0, np.int64)
        runs = np.add.reduceat(other, at, dtype=np.int64)
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        of = np.empty(len(name), np.int64)
        of[order] = np.cumsum(new) - 1
        return name[at], np.maximum(several, np.where(runs >= POPULAR, 3, np.where(runs >= FEW, 2, 0))).astype(np.uint8), of

    def bytes_of(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bytes of runs, one row each, zero beyond their end."""
        at = start[:, None] + np.arange(WIDTH)
        inside = np.arange(WIDTH) < (count + WINDOW - 1)[:, None]
        return np.where(inside, self.data[np.minimum(at, len(self.data) - 1)], 0).astype(np.uint8)


def bucket_of(name: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(name ^ U(0xA5A5A5A5A5A5A5A5)) % U(buckets)).astype(np.int64)


def by_bucket(where: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket, and (bucket, from, to) in it."""
    order = np.argsort(where, kind="stable")
    w = where[order]
    at = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    return order, [(int(w[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(w)))]


def pack(**arrays: np.ndarray) -> bytes:
    table = pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.large_binary()) for x in arrays.values()], list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes, **types) -> list[np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return [np.frombuffer(batch.column(k)[0].as_py(), t) for k, t in types.items()]


def classes(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Number of each row's class of rows with equal keys and equal bytes. Hashes put equal rows side by side, bytes decide."""
    words = np.ascontiguousarray(rows).view(U).reshape(len(rows), WIDTH // 8)
    h = np.zeros(len(rows), U)
    for k in range(WIDTH // 8):
        h = mixed(h * U(BASES[1]) + words[:, k])
    for k in keys:
        h = mixed(h + k.astype(U))
    order = np.argsort(h, kind="stable")
    new = np.ones(len(rows), bool)
    there = words[order]
    new[1:] = (there[1:] != there[:-1]).any(axis=1)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def least_of(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST)
    np.minimum.at(out, group, value)
    return out


def sort_suffixes(h: RowHashes | Hashes, data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): suffixes `at` of data, WINDOW bytes of each, sorted within groups (which are ascending);
    equal[i] tells that the i-th in order repeats the one before it in its group."""

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), WINDOW, a.dtype)
        differ = np.flatnonzero(h.of(a, WINDOW) != h.of(b, WINDOW))
        a, b = a[differ], b[differ]
        lo, hi = np.zeros(len(a), a.dtype), np.full(len(a), WINDOW - 1, a.dtype)
        for _ in range((WINDOW - 1).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = h.of(a, mid) == h.of(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[differ] = lo
        return out

    def less(a: np.ndarray, b: np.ndarray, if_equal: np.ndarray) -> np.ndarray:
        n = common(a, b)
        at_end = n == WINDOW
        n = np.minimum(n, WINDOW - 1)
        return np.where(at_end, if_equal, data[a + n] < data[b + n])

    n = len(at)
    order = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    width = 1
    while width < (size.max() if n else 0):
        place = np.arange(n)
        run = (place - begin) // width
        mine = begin + run * width
        other = begin + (run ^ 1) * width
        lo, hi = np.minimum(other, end), np.minimum(other + width, end)
        base, right = lo.copy(), run & 1 == 1
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            # An equal suffix of the left run goes before one of the right run.
            before = less(at[order[mid]], at[order[active]], right[active])
            lo[active] = np.where(before, mid + 1, lo[active])
            hi[active] = np.where(before, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = np.minimum(mine, np.where(other < end, other, mine)) + (place - mine) + (lo - base)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        width *= 2
    equal = np.zeros(n, bool)
    if n > 1:
        a, b = at[order[:-1]], at[order[1:]]
        same = (group[order[1:]] == group[order[:-1]]) & (h.of(a, WINDOW) == h.of(b, WINDOW))
        i = np.flatnonzero(same)
        same[i] = (data[a[i][:, None] + np.arange(WINDOW)] == data[b[i][:, None] + np.arange(WINDOW)]).all(axis=1)
        equal[1:] = same
    return order, equal


def judge(count: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of one bucket: (least doc_id with the run, bits of its windows that a still smaller doc_id has)."""
    cls = classes(rows, count)
    n = int(cls.max()) + 1 if len(cls) else 0
    least = least_of(cls, doc, n)
    rep = np.empty(n, np.int64)
    rep[cls] = np.arange(len(cls))
    bits = np.zeros(n, np.uint32)
    for some in _by_name(rows[rep]):
        _judge_windows(count[rep[some]], least[some], rows[rep[some]], bits, some)
    return least[cls], bits[cls]


def _by_name(rows: np.ndarray, most: int = 50_000):
    """Rows whose name other rows have too, by name, in blocks of about `most` that do not part a name."""
    name = np.concatenate([RowHashes(rows[a : a + most]).names()[:, :SPAN].min(axis=1) for a in range(0, len(rows), most)]) if len(rows) else np.zeros(0, U)
    order = np.argsort(name, kind="stable")
    twin = name[order][1:] == name[order][:-1]
    several = np.append(False, twin) | np.append(twin, False) if len(rows) else np.zeros(0, bool)
    order = order[several]
    edge = np.flatnonzero(np.append(name[order][1:] != name[order][:-1], True)) + 1
    a = 0
    while a < len(order):
        b = int(edge[min(np.searchsorted(edge, a + most), len(edge) - 1)])
        yield order[a:b]
        a = b


def _judge_windows(count: np.ndarray, least: np.ndarray, rows: np.ndarray, bits: np.ndarray, some: np.ndarray) -> None:
    h = RowHashes(rows)
    names = h.names()
    name = names[:, :SPAN].min(axis=1)
    # Equal windows hold their name's first place at the same offset, so only those are sorted against each other.
    place = np.where(names == name[:, None], np.arange(names.shape[1]), names.shape[1])
    place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
    owner = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    group = (np.cumsum(np.append(False, name[1:] != name[:-1])) * WIDTH)[owner] + place[owner, nth] - nth
    by = np.argsort(group, kind="stable")
    owner, nth, group = owner[by], nth[by], group[by]
    order, equal = sort_suffixes(h, rows.reshape(-1), (owner * WIDTH + nth).astype(np.int32), group)
    owner, nth = owner[order], nth[order]
    same = np.cumsum(~equal) - 1
    first = least_of(same, least[owner], int(same[-1]) + 1)
    smaller = first[same] < least[owner]
    np.bitwise_or.at(bits, some[owner[smaller]], np.uint32(1) << nth[smaller].astype(np.uint32))


def _chunk(table: pa.Table) -> Chunk:
    """The chunk in an order of its own, so that each step numbers runs alike however its rows arrived."""
    pairs = sorted((i is None, LAST if i is None else i, t or b"") for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()))
    chunk = Chunk(np.array([i for _, i, _ in pairs], np.int64), [t for *_, t in pairs])
    chunk.nameless = sum(none for none, *_ in pairs)  # the last rows
    return chunk


_OUT = "to long, back long, data binary"


def _rows(to: list[int], back: list[int], data: list[bytes]) -> pa.Table:
    return pa.table([pa.array(to, pa.int64()), pa.array(back, pa.int64()), pa.array(data, pa.binary())], ["to", "back", "data"])


class Plan:
    """The steps for a number of buckets and a width of reported names."""

    def __init__(self, buckets: int, name_bytes: int):
        self.buckets, self.name_bytes = buckets, name_bytes

    # 1: chunk -> bucket: names
    def report(self, table: pa.Table) -> pa.Table:
        chunk = _chunk(table)
        names, level, _ = chunk.names()
        order, parts = by_bucket(bucket_of(names, self.buckets))
        short = np.ascontiguousarray(names[order].view(np.uint8).reshape(-1, 8)[:, : self.name_bytes])
        mine = table.column("chunk")[0].as_py()
        return _rows([b for b, *_ in parts], [mine] * len(parts), [pack(n=short[x:y], d=np.packbits(np.stack([level[order[x:y]] & 1, level[order[x:y]] >> 1]))) for _, x, y in parts])

    # 1: bucket -> chunk: bits of its names that several documents share, and of those with very many runs
    def count(self, table: pa.Table) -> pa.Table:
        names, weights, sizes = [], [], []
        for data in table.column("data"):
            raw, bits = unpack(data.as_py(), n=np.uint8, d=np.uint8)
            n = len(raw) // self.name_bytes
            wide = np.zeros((n, 8), np.uint8)
            wide[:, : self.name_bytes] = raw.reshape(n, self.name_bytes)
            low, high = np.unpackbits(bits)[: 2 * n].reshape(2, n)
            names.append(wide.reshape(-1).view(U))
            weights.append(np.array([1, 2, FEW, POPULAR])[low + 2 * high])
            sizes.append(n)
        name, weight = np.concatenate(names), np.concatenate(weights)
        order = np.argsort(name, kind="stable")
        s = name[order]
        at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        total = np.empty(len(s), np.int64)
        total[order] = np.repeat(np.add.reduceat(weight[order], at), np.diff(np.append(at, len(s))))
        mine, back, out, x = table.column("to")[0].as_py(), [], [], 0
        for chunk, n in zip(table.column("back").to_pylist(), sizes):
            t = total[x : x + n]
            x += n
            back.append(chunk)
            out.append(pack(b=np.packbits(np.stack([t > 1, t >= POPULAR]))))
        return _rows(back, [mine] * len(back), out)

    def _pieces(self, chunk: Chunk, answers: pa.Table) -> "Pieces":
        """The runs to judge, those of popular names window by window."""
        names, _, name_of = chunk.names()
        order, parts = by_bucket(bucket_of(names, self.buckets))
        state = np.zeros(len(names), np.uint8)
        said = dict(zip(answers.column("back").to_pylist(), answers.column("data")))
        for b, x, y in parts:
            (bits,) = unpack(said[b].as_py(), b=np.uint8)
            shared, many = np.unpackbits(bits)[: 2 * (y - x)].reshape(2, y - x)
            state[order[x:y]] = shared + many
        of = state[name_of]
        whole, hot = np.flatnonzero(of == 1), np.flatnonzero(of == 2)
        n = chunk.count[hot]
        start = np.repeat(chunk.start[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        deal = np.zeros(len(start), U)
        for a in range(0, len(chunk.data), BLOCK):
            i = np.flatnonzero((start >= a) & (start < a + BLOCK))
            if len(i):
                deal[i] = mixed(Hashes(chunk.data[a : a + BLOCK + WINDOW]).of(start[i] - a, WINDOW) + U(1))
        join = lambda x, y: np.concatenate([x, y])
        return Pieces(chunk, join(chunk.start[whole], start), join(chunk.count[whole], np.ones(len(start), np.int64)), join(chunk.doc[whole], np.repeat(chunk.doc[hot], n)), join(chunk.hash[whole], deal), join(chunk.name[whole], deal), self.buckets)

    # 2: chunk -> bucket: distinct runs
    def send(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], [], [])
        got = self._pieces(_chunk(table), answers)
        out = []
        for _, x, y in got.parts:
            i = got.order[x:y]
            count = got.count[got.rep[i]]
            rows = got.chunk.bytes_of(got.start[got.rep[i]], count)
            out.append(pack(c=count.astype(np.uint8), d=got.least[i], r=rows[np.arange(WIDTH) < (count + WINDOW - 1)[:, None]]))
        return _rows([b for b, *_ in got.parts], [table.column("chunk")[0].as_py()] * len(out), out)

    # 2: bucket -> chunk: verdicts in the order they were sent
    def decide(self, table: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), c=np.uint8, d=np.int64, r=np.uint8) for x in table.column("data")]
        count, doc, raw = (np.concatenate(x) for x in zip(*got))
        count = count.astype(np.int64)
        rows = np.zeros((len(count), WIDTH), np.uint8)
        rows[np.arange(WIDTH) < (count + WINDOW - 1)[:, None]] = raw
        least, bits = judge(count, doc, rows)
        out, x = [], 0
        for g in got:
            out.append(pack(l=least[x : x + len(g[0])], m=bits[x : x + len(g[0])]))
            x += len(g[0])
        return _rows(table.column("back").to_pylist(), [table.column("to")[0].as_py()] * len(got), out)

    # 3: chunk: cut
    def cut(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64())], ["doc_id", "starts", "ends", "kept", "n_bytes"])
        chunk = _chunk(table)
        first, second = answers.filter(pc.equal(answers["step"], 1)), answers.filter(pc.equal(answers["step"], 2))
        got = self._pieces(chunk, first)
        least, bits = np.full(len(got.rep), LAST), np.zeros(len(got.rep), np.uint32)
        said = {b: unpack(x.as_py(), l=np.int64, m=np.uint32) for b, x in zip(second.column("back").to_pylist(), second.column("data"))}
        for b, x, y in got.parts:
            least[got.order[x:y]], bits[got.order[x:y]] = said[b]
        edge = np.zeros(len(chunk.data) + 1, np.int32)
        whole = np.flatnonzero(least[got.cls] < got.doc)
        np.add.at(edge, got.start[whole], 1)
        np.add.at(edge, got.start[whole] + got.count[whole] + WINDOW - 1, -1)
        own = np.flatnonzero((least[got.cls] == got.doc) & (bits[got.cls] != 0))
        for k in range(SPAN):
            hit = got.start[own[bits[got.cls[own]] >> np.uint32(k) & np.uint32(1) == 1]] + k
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        starts, ends, kept, a = [], [], [], 0
        for b in chunk.ends:
            mask = gone[a:b]
            step = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            starts.append(step[::2])
            ends.append(step[1::2])
            kept.append(chunk.data[a:b][~mask].tobytes() if len(step) else chunk.data[a:b].tobytes())
            a = b
        sizes, n = np.diff(np.concatenate([[0], chunk.ends])), len(chunk.ids) - chunk.nameless
        ids = [int(i) if k < n else None for k, i in enumerate(chunk.ids)]
        return pa.table([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "starts", "ends", "kept", "n_bytes"])


class Pieces:
    """Runs of a chunk to judge. cls is the class of equal bytes of each, rep a run of each class, least the least
    doc_id that has it; order and parts say which classes go to which bucket. Hashes propose classes, bytes confirm them."""

    def __init__(self, chunk: Chunk, start: np.ndarray, count: np.ndarray, doc: np.ndarray, run: np.ndarray, deal: np.ndarray, buckets: int):
        self.chunk, self.start, self.count, self.doc = chunk, start, count, doc
        order = np.argsort(run, kind="stable")
        new = np.ones(len(run), bool)
        new[1:] = run[order][1:] != run[order][:-1]
        self.cls = np.empty(len(run), np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.rep = order[new]
        several = np.flatnonzero(self.rep[self.cls] != np.arange(len(run)))
        alone = [some[self._differ(some)] for some in (several[a : a + (1 << 16)] for a in range(0, len(several), 1 << 16))]
        alone = np.concatenate(alone) if alone else several
        if len(alone):  # hashes that collide: each such run is a class of its own
            self.cls[alone] = len(self.rep) + np.arange(len(alone))
            self.rep = np.concatenate([self.rep, alone])
        self.least = least_of(self.cls, doc, len(self.rep))
        self.order, self.parts = by_bucket(bucket_of(deal[self.rep], buckets))

    def _differ(self, some: np.ndarray) -> np.ndarray:
        other = self.rep[self.cls[some]]
        a, b = (self.chunk.bytes_of(self.start[i], self.count[i]) for i in (some, other))
        return (self.count[some] != self.count[other]) | (a != b).any(axis=1)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) for every row of docs(doc_id, text): the maximal byte ranges removed
    and the bytes that stay.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are those
    of the input. Texts are UTF-8 bytes, null counts as empty, and matches never cross documents. Rows that
    share a doc_id never remove from each other; a null doc_id is as late as the greatest long. No rows give none.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, -(-total // CHUNK))
    plan = Plan(buckets, min(8, max(4, math.ceil((math.log2(total + 2) + 8) / 8))))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("chunk"), "doc_id", "text")
    chunks = dealt.groupBy("chunk")
    report, count, decide = (lambda t: plan.report(t)), (lambda t: plan.count(t)), (lambda t: plan.decide(t))
    send, cut = (lambda t, answers: plan.send(t, answers)), (lambda t, answers: plan.cut(t, answers))
    first = chunks.applyInArrow(report, _OUT).groupBy("to").applyInArrow(count, _OUT)
    sent = chunks.cogroup(first.groupBy("to")).applyInArrow(send, _OUT)
    second = sent.groupBy("to").applyInArrow(decide, _OUT)
    answers = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    return chunks.cogroup(answers.groupBy("to")).applyInArrow(cut, "doc_id long, starts array<long>, ends array<long>, kept binary, n_bytes long")
