import random
import zlib
from collections import defaultdict

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import docs, rows
from tokenizers import Tokenizer
from twinseek.llm import packing, registry


def check_pieces(pieces, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == want.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(want[d][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want[d])
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", "one", "<|endoftext|> has its id", "naïve café ÿ \U0001f600", "x" * 9000, "word " * 30000]
    texts += [" ".join(r.choice(["alpha", "be", "Gamma's", "42", "é"]) for _ in range(r.randrange(900))) for _ in range(300)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = rows(texts)
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x, *_ in data}
    df = docs(spark, data).withColumnRenamed("source", "length")
    got = [p.asDict() for p in packing.pack(df, batch_tokens=20000).collect()]
    assert check_pieces(got, want, 2048) == 0


def test_added_tokens_as_the_tokenizer_has_them(spark, tmp_path):
    texts = [None, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n é", "<|endoftext| >", "no token"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x, *_ in rows(texts)}
    docs(spark, rows(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    for got in (registry.op8_min_bin_slack(spark, str(tmp_path)), cp.packed(spark, docs(spark, rows(texts)), "")):
        assert check_pieces([p.asDict() for p in got.collect()], want, 2048) == 0


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_best_fill_is_optimal(seed):
    r = random.Random(seed)
    lengths = r.sample(range(3, 60), 6)
    counts = [r.randrange(1, 4) for _ in lengths]
    room = r.randrange(10, 200)
    sums = {0}
    for s, n in zip(lengths, counts):
        sums = {a + s * k for a in sums for k in range(n + 1) if a + s * k <= room}
    used = packing.best_fill(lengths, counts, room)
    assert all(u <= n for u, n in zip(used, counts))
    assert sum(s * u for s, u in zip(lengths, used)) == max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_windows_are_full(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 300) for _ in range(r.randrange(1, 200))] + [64] * 20
    sequences = packing.pack_lengths(lengths, 100)
    sizes = [sum(n for _, _, n in s) for s in sequences]
    assert all(n == 100 or n & (n - 1) == 0 for n in sizes)
    cover = defaultdict(list)
    for s in sequences:
        for i, start, n in s:
            cover[i].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(cover[i]):
            assert start == at
            at += size
        assert at == n
