"""Packing by minimum bin slack.

Texts become token ids, full windows are cut off, and the remainders of a batch fill windows one by one:
the longest one left opens the window, and a bitset subset-sum over the multiset of lengths left finds the
fill closest to capacity; the counts that reach it are traced back. What slack stays is filled by cutting
one more remainder. The last window of a batch is cut into sequences of power-of-two length, which need no
padding. Batches are bounded by tokens and packed where they are read, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
END_ID = 1
BATCH_TOKENS = 2_000_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_encoders: dict[tuple[str, bool], object] = {}


def encoder(name: str, added: bool = True):
    """Encoder of a public vocabulary by file name. The ranks file holds the vocabulary of the .json of the
    same stem and gives the same ids about six times as fast. With added, the .json's added tokens have their
    ids where they occur in a text, as its tokenizer has them by default; else they are plain text."""
    if (name, added) not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {}
        if added:
            with open(public_tokenizers.path(name), encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", ())}
            ranks = {token: i for token, i in ranks.items() if i not in special.values()}
        made = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        held = lambda text: any(t in text for t in special)
        _encoders[name, added] = lambda text: made.encode(text, allowed_special="all") if held(text) else made.encode_ordinary(text)
    return _encoders[name, added]


def best_fill(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each length to take so that their sum is as near to room as it can be without passing it."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k, (size, n) in enumerate(zip(lengths, counts)):
        part, left = 1, min(n, room // size)
        while left > 0:  # binary splitting of the count
            take = min(part, left)
            steps.append((k, take, size * take, reach))
            reach |= (reach << (size * take)) & full
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, [0] * len(lengths)
    for k, take, size, before in reversed(steps):
        if not before >> at & 1:
            at -= size
            used[k] += take
    return used


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length). Each but those of the last window is exactly full."""
    out, at = [], {}
    for i, n in enumerate(lengths):
        whole = n - n % capacity
        out += [[(i, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            at.setdefault(n - whole, []).append((i, whole))
    sizes = sorted(at)  # ascending

    def pop(size: int) -> tuple[int, int, int]:
        item, start = at[size].pop()
        if not at[size]:
            del at[size]
            sizes.pop(bisect_right(sizes, size) - 1)
        return item, start, size

    while sizes:
        window = [pop(sizes[-1])]
        room = capacity - window[0][2]
        fit = bisect_right(sizes, room)
        offered = sizes[:fit][::-1]  # all that fit; the large ones first, so that small ones are left to complete later windows
        for size, n in zip(offered, best_fill(offered, [len(at[s]) for s in offered], room)):
            window += [pop(size) for _ in range(n)]
            room -= size * n
        while room and sizes:  # fill the slack by cutting the longest remainder
            item, start, size = pop(sizes[-1])
            take = min(size, room)
            window.append((item, start, take))
            if take < size:
                if size - take not in at:
                    sizes.insert(bisect_right(sizes, size - take), size - take)
                at.setdefault(size - take, []).append((item, start + take))
            room -= take
        if not room:
            out.append(window)
        else:
            out += powers_of_two(window, capacity - room)
    return out


def powers_of_two(window: list[tuple[int, int, int]], used: int) -> list[list[tuple[int, int, int]]]:
    """A part-filled window as sequences of power-of-two length."""
    out, pieces = [], window[::-1]
    for bit in reversed(range(used.bit_length())):
        if used >> bit & 1:
            room, sequence = 1 << bit, []
            while room:
                item, start, size = pieces.pop()
                take = min(size, room)
                sequence.append((item, start, take))
                if take < size:
                    pieces.append((item, start + take, size - take))
                room -= take
            out.append(sequence)
    return out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, batch_tokens: int = BATCH_TOKENS, added: bool = True) -> DataFrame:
    """One row per piece of docs(doc_id, text): where it starts in its document, how long it is, the CRC-32 of
    its ids, and its place in a sequence.

    Every row is packed, also rows that repeat a doc_id (each is a document of its own) and a null doc_id. A
    null or empty text is the end id alone. Any length is cut freely. An empty table gives no pieces.
    The ids are those of the vocabulary's tokenizer; without added its added tokens are plain text, see encoder().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, n = encoder(vocabulary, added), TaskContext.get().partitionId() << 40, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held
            rows = []
            for sequence in pack_lengths([len(x) for x in ids], capacity):
                offset = 0
                for item, start, length in sequence:
                    rows.append((names[item], start, length, zlib.crc32(ids[item][start : start + length]), len(ids[item]), base + n, offset))
                    offset += length
                n += 1
            ids.clear()
            names.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                tokens = encode(text.as_py() or "")
                tokens.append(END_ID)
                ids.append(np.array(tokens, "<u4"))
                names.append(doc_id)
                held += len(tokens)
                if held >= batch_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
