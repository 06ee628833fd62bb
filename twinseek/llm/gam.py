"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a shallow tree to it; as a tree over one binned
feature is a step function, each feature ends as a table of values by bin. Then the pairs that explain most
of what is left get two-way tables in the same way. A score is a sum of table look-ups for whole batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows used to learn, at most; the first by hash of doc_id. All rows are scored.
TRAIN_ROWS = 20000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 120, 40, 6, 0.15, 2.0

FEATURES = ("log_words", "word_length", "symbols", "capitals", "exclaims", "pipes", "digits", "stops", "non_ascii", "distinct_words", "top_word", "repeats", "trigram_repeats", "dup_lines", "line_length", "no_letters")
_CLASSES = np.zeros((256, 8))
for _k, _chars in enumerate((b"#*$%&<>", bytes(range(65, 91)), bytes(range(97, 123)), b"!", b"|", bytes(range(48, 58)), b".,;:?", bytes(range(0x80, 0xC0)))):
    _CLASSES[list(_chars), _k] = 1


def features(text: bytes) -> list[float]:
    """The features of a whole UTF-8 text; 0 where nothing is there to divide by."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    symbols, upper, lower, bang, pipe, digit, stop, tail = hist.tolist()
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = max(1, n - 2)
    return [
        float(np.log1p(n)),
        (size - tail) / n,
        symbols / size,
        upper / max(1.0, upper + lower),
        bang / n,
        pipe / n,
        digit / size,
        stop / n,
        tail / size,
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(size / max(1, len(lines)))),
        sum(not w.isalnum() and not any(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w) for w in seen) / len(seen),
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best split of binned gradients."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Value by bin of a tree of the given depth."""
    gain, at = best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value by pair of bins: one cut of the first feature, and one of the second on either side."""
    _, at = best_cut(g.sum(axis=1), h.sum(axis=1))
    out = np.zeros_like(g)
    for rows in (slice(0, at), slice(at, None)):
        if g[rows].size:
            out[rows] = tree(g[rows].sum(axis=0), h[rows].sum(axis=0), 1)
    return out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns from features and 0/1 labels; with one label only, or no rows, a constant."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(set(y.tolist())) < 2:
        return model
    b, raw = model.bins(x), np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)), 2)
            t += step
            raw += step[b[:, k]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(model.tables[j])
        at, shape = b[:, i] * n + b[:, j], (len(model.tables[i]), n)
        g, h = slopes()
        return np.bincount(at, g, shape[0] * n).reshape(shape), np.bincount(at, h, shape[0] * n).reshape(shape), at

    def worth(pair: tuple[int, int]) -> float:
        g, h, _ = grid(*pair)
        v = pair_tree(g, h)
        return float((g * v + 0.5 * h * v * v).sum())

    model.pairs = sorted(combinations(range(len(FEATURES)), 2), key=worth)[:PAIRS]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            g, h, at = grid(i, j)
            step = RATE * pair_tree(g, h)
            t += step
            raw += step.ravel()[at]
    return model


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text): likelihood of quality 1.

    Learned from labels(doc_id, quality); a doc_id labelled twice counts with its greater label, null labels
    and labels without a document not at all. Null texts are empty. Rows that repeat a doc_id get a score
    each. With nothing to learn from all scores are alike. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(with_features(docs))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    marks = scratch.keep(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))
    sample = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "y", "x").orderBy("doc_id", "x").limit(2 * TRAIN_ROWS).collect()
    x = np.array([r.x for r in sample]).reshape(-1, len(FEATURES))
    model = docs.sparkSession.sparkContext.broadcast(train(x, np.array([float(r.y > 0) for r in sample])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
