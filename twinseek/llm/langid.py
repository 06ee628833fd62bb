"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into phrases, each the
longest match found in a language's automaton; the language that needs the fewest phrases per character
wins. All letters of all scripts are told apart. The automata's edges lie interleaved in one array: a state is
its offset there, an edge stands at offset + symbol together with the offset it belongs to, and all languages
and many texts are walked at once by such look-ups. Long texts are walked in pieces side by side, each from a
guess of the state the piece before it ends in; pieces whose guess was wrong are walked again until every piece
starts where the one before it ended, so the parse is that of the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample, per language: labelled rows, and characters of the window taken from each.
SAMPLE_ROWS, SAMPLE_CHARS = 128, 240
#: A piece's length, and how far back the walk begins that guesses the state at a piece's start. They set array sizes only.
PIECE, BACK = 1024, 64
SPACE, UNSEEN = 0, 1  # symbols of a run of characters that are not letters, and of letters that no language has


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # code point -> symbol
    edges: np.ndarray  # at a state's offset + symbol: offset << 32 | offset of the next state; -1 if empty
    opened: np.ndarray  # language, symbol -> the state after a phrase's first symbol
    nowhere: int  # the state without edges: before the first symbol, after a symbol the language lacks


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence (state 0 is the root)."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def symbol_table(letters: set[str]) -> np.ndarray:
    """Symbol of every code point: letters by their small form."""
    number = {c: i for i, c in enumerate(sorted(letters), UNSEEN + 1)}
    return np.array([number.get(c.lower()[0], UNSEEN) if (c := chr(p)).isalpha() else SPACE for p in range(sys.maxunicode + 1)], np.int32)


def symbols_of(symbol: np.ndarray, text: str) -> np.ndarray:
    """Symbols of a text, runs of anything that is not a letter as one space."""
    s = symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    return s[~((s == SPACE) & (np.concatenate([[SPACE], s[:-1]]) == SPACE))] if len(s) else s


def place(rows: list[list[int]], width: int) -> tuple[np.ndarray, int]:
    """(an offset for each row of symbols, length of the array) so that no two rows share an offset, nor a place
    offset + symbol. Offsets are drawn at random, for long rows first, until all fit."""
    random = np.random.default_rng(0)
    size = 3 * sum(map(len, rows)) + 4 * width + 64
    offset, taken, used = np.zeros(len(rows), np.int64), np.zeros(size, bool), np.zeros(size, bool)
    used[0] = True
    degree = np.array([len(r) for r in rows], np.int64)
    for n in sorted(set(degree.tolist()), reverse=True):
        left = np.flatnonzero(degree == n)
        symbols = np.array([rows[i] for i in left], np.int64).reshape(len(left), n)
        tries = 0
        while len(left):
            tries += 1
            if tries % 200 == 0:
                size *= 2
                taken, used = (np.concatenate([x, np.zeros(size - len(x), bool)]) for x in (taken, used))
            often = max(1, 4096 // len(left))  # proposals for each row; the first that is free is taken
            at = random.integers(0, size - width, (len(left), often))
            free = ~used[at] & ~taken[at[:, :, None] + symbols[:, None, :]].any(axis=2)
            at = at[np.arange(len(left)), free.argmax(axis=1)]
            ok = free.any(axis=1)
            spots = at[:, None] + symbols
            for wanted in (at[:, None], spots):  # of rows that want one place the first gets it
                mine = np.zeros(size, np.int64)
                rank = np.arange(len(left), 0, -1)
                np.maximum.at(mine, wanted[ok], rank[ok, None])
                ok &= (mine[wanted] == rank[:, None]).all(axis=1)
            offset[left[ok]], used[at[ok]], taken[spots[ok]] = at[ok], True, True
            left, symbols = left[~ok], symbols[~ok]
    return offset, size


def train(samples: dict[str, list[str]]) -> Model:
    languages = sorted(samples)
    symbol = symbol_table({c.lower()[0] for ts in samples.values() for t in ts for c in t if c.isalpha()})
    width = int(symbol.max()) + 1
    states: list[dict[int, int]] = []
    roots = []
    for lang in languages:
        go = automaton([int(s) for t in samples[lang] for s in (*symbols_of(symbol, t), SPACE)])
        roots.append(len(states))
        states += [{c: len(states) + to for c, to in edges.items()} for edges in go]
    inner = sorted({i for i, edges in enumerate(states) if edges}.difference(roots))
    placed, size = place([list(states[i]) for i in inner], width)
    offset = np.zeros(len(states), np.int64)  # states without edges, and the roots, which no look-up starts from, have offset 0
    offset[inner] = placed
    edges = np.full(size, -1, np.int64)
    for i in inner:
        for c, to in states[i].items():
            edges[offset[i] + c] = offset[i] << 32 | offset[to]
    opened = np.zeros((len(languages), width), np.int64)
    for k, root in enumerate(roots):
        for c, to in states[root].items():
            opened[k, c] = offset[to]
    return Model(languages, symbol, edges, opened, 0)


def walk(model: Model, lanes: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases opened, state at the end) of each language (rows) in each lane of symbols (columns), from a state each."""
    size = np.array([len(x) for x in lanes], np.int64)
    order = np.argsort(-size, kind="stable")
    most = int(size.max()) if len(lanes) else 0
    grid = np.zeros((most, len(lanes)), np.int64)
    for k, i in enumerate(order):
        grid[: size[i], k] = lanes[i]
    live = np.searchsorted(-size[order], -np.arange(most), "left")
    now, opened = state[:, order], np.zeros((len(model.languages), len(lanes)), np.int64)
    for column, m in zip(grid, live):
        at, column = now[:, :m], column[:m]
        edge = model.edges[at + column]
        lost = (edge >> 32) != at
        opened[:, :m] += lost
        now[:, :m] = np.where(lost, model.opened[:, column], edge & 0xFFFFFFFF)
    opened_back, now_back = np.empty_like(opened), np.empty_like(now)
    opened_back[:, order], now_back[:, order] = opened, now
    return opened_back, now_back


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Number of phrases of each text (symbols) in each language, shape (texts, languages)."""
    pieces = [t[a : a + PIECE] for t in texts for a in range(0, max(1, len(t)), PIECE)]
    counts = np.array([max(1, -(-len(t) // PIECE)) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    later = np.setdiff1d(np.arange(len(pieces)), first)
    start = np.full((len(model.languages), len(pieces)), model.nowhere, np.int64)
    if len(later):
        start[:, later] = walk(model, [pieces[i - 1][-BACK:] for i in later], start[:, later])[1]
    opened, state = walk(model, pieces, start)
    while len(wrong := later[(start[:, later] != state[:, later - 1]).any(axis=0)]):
        start[:, wrong] = state[:, wrong - 1]
        opened[:, wrong], state[:, wrong] = walk(model, [pieces[i] for i in wrong], start[:, wrong])
    return np.add.reduceat(opened, first, axis=1).T


def predict(model: Model, texts: list[str | None], batch: int = 2_000_000) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    todo, held = [], 0

    def parse() -> None:
        counts = phrases(model, [s for _, s in todo])
        for (i, _), row in zip(todo, counts):
            best = int(np.argmin(row))  # ties: the first language in code-point order
            out[i] = (model.languages[best], float(1 / np.exp(np.maximum(row[best] - row, -700)).sum()))
        todo.clear()

    for i, t in enumerate(texts):
        if t and model.languages:
            s = symbols_of(model.symbol, t)
            if (s != SPACE).any():
                todo.append((i, s))
                held += len(s)
        if held > batch:
            parse()
            held = 0
    if todo:
        parse()
    return out


def sample(labelled: DataFrame) -> dict[str, list[str]]:
    """A bounded, repeatable sample of labelled text: of each language the SAMPLE_ROWS rows of least hash, and of each
    row a window of SAMPLE_CHARS characters whose place the hash decides too. A language has the same bounds
    whatever their number. Rows far beyond the bound are sorted out by a threshold of their hash before the shuffle."""
    mark = F.xxhash64("doc_id", "text")
    rows = labelled.where("lang is not null and trim(text) <> ''")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    spread = lambda n: int(-(1 << 63) + min(1.0, 8 * SAMPLE_ROWS / n) * ((1 << 64) - 1025))
    limit = F.create_map(*(x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(spread(n)))))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    few = rows.select("lang", "doc_id", mark.alias("mark"), "text").where(F.col("mark") <= limit[F.col("lang")])
    few = few.select("lang", "doc_id", "mark", F.substr("text", (F.pmod(F.xxhash64("mark"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("mark", "doc_id", "text")
    ranked = few.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= SAMPLE_ROWS)
    found: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r.rank)):
        found.setdefault(r.lang, []).append(r.text)
    return found


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text), learned from labelled(doc_id, text, lang).

    Whole texts are parsed. A null text, a text without letters, and any text when nothing is labelled, are
    'und' with score 0. Equal phrase counts go to the first language in code-point order. score is the
    winner's share of exp(-phrases) over all languages. Rows that repeat are judged one by one. Columns other than these are not
    read. The model has at most SAMPLE_ROWS * (SAMPLE_CHARS + 1) symbols a language, three edges each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(labelled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = predict(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
