"""Quality classifier: a generalised additive model with pairwise interactions.

Each document is described by a fixed list of numbers taken from its text. The model is a sum of
one lookup table per number and of a few two-way tables, all in log-odds. Training goes round the
tables in a cycle: a shallow tree of at most four leaves is fitted to the gradient on the bins of one number and added to
its table with a small step. The pairs with the largest remaining gain then get two-way tables in the
same manner. Scoring bins a document's numbers and adds table entries.

Training uses a bounded sample of labelled documents, at most ``most_documents`` of each label with
the smallest hashes of their ids; only their numbers reach the driver. All documents are scored.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.llm.labels import labelled_sample
from frailscope.llm.tokens import (
    Text,
    is_held_out,
    map_text,
    pieces_of,
    prefix_hashes,
    segments,
    short_batches,
    span_hashes,
    text_bytes,
    words_of,
)

THRESHOLD = 0.5
FEATURES = (
    "log_words",
    "word_length",
    "long_words",
    "short_words",
    "distinct_words",
    "repeats_next",
    "bare_symbol_words",
    "upper_case",
    "digits",
    "symbols",
    "exclamations",
    "stops",
    "words_per_line",
    "repeated_lines",
)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>~^_=+\\@{}[]", np.uint8))
_CLASSES = {
    "upper_case": np.isin(np.arange(256), np.arange(65, 91)),
    "digits": np.isin(np.arange(256), np.arange(48, 58)),
    "symbols": _SYMBOLS,
    "exclamations": np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8)),
    "stops": np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8)),
}


def _distinct_per_text(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Different hashes in each text, from their upper bits."""
    bits = np.uint64(max(1, int(texts).bit_length()))
    keys = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=texts)


def features(text: Text) -> np.ndarray:
    """One row per text in the order of FEATURES; a text without words has zeros only."""
    words = words_of(text)
    n = len(words.first) - 1
    counts, owner = words.counts, words.owner
    many = np.maximum(counts, 1)
    starts = np.cumsum(np.concatenate([[0], (text.data & 0xC0) != 0x80]))  # characters, not bytes
    length = starts[words.end] - starts[words.start]
    size = np.maximum(segments(length, words.first), 1)
    out = np.zeros((n, len(FEATURES)))

    def put(name: str, values: np.ndarray) -> None:
        out[:, FEATURES.index(name)] = np.where(counts > 0, values, 0.0)

    put("log_words", np.log1p(counts))
    put("word_length", size / many)
    put("long_words", segments((length > 12).astype(np.int64), words.first) / many)
    put("short_words", segments((length < 3).astype(np.int64), words.first) / many)
    put("distinct_words", _distinct_per_text(owner, words.hashes, n) / many)
    same = np.zeros(len(owner), np.int64)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    put("repeats_next", segments(same, words.first) / many)
    marks = np.cumsum(np.concatenate([[0], _SYMBOLS[text.data]]))
    bare = marks[words.end] - marks[words.start] == words.end - words.start
    put("bare_symbol_words", segments(bare.astype(np.int64), words.first) / many)
    for name, members in _CLASSES.items():
        put(name, segments(members[text.data].astype(np.int64), text.bounds) / size)

    # Lines with a word: cut at newlines and at the ends of texts.
    cut = np.unique(np.concatenate([text.bounds, np.flatnonzero(text.data == 10), np.flatnonzero(text.data == 10) + 1]))
    begin, end = cut[:-1], cut[1:]
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[full], end[full]
    line_owner = np.searchsorted(text.bounds, begin, side="right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    put("words_per_line", counts / lines)
    hashes = span_hashes(prefix_hashes(text.data), begin, end)
    put("repeated_lines", 1 - _distinct_per_text(line_owner, hashes, n) / lines)
    return out


class AdditiveModel(NamedTuple):
    intercept: float
    edges: list[np.ndarray]  # bin borders of each number
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]  # coarser borders of each number
    pair_tables: list[np.ndarray]


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])


def log_odds(model: AdditiveModel, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.intercept)
    fine, coarse = _bins(x, model.edges), _bins(x, model.pair_edges)
    for j, table in enumerate(model.tables):
        out += table[fine[:, j]]
    for (j, k), table in zip(model.pairs, model.pair_tables, strict=True):
        out += table[coarse[:, j], coarse[:, k]]
    return out


def _borders(column: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of binned gradients."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gains = (
        _gain(left_g, left_h, ridge) + _gain(total_g - left_g, total_h - left_h, ridge) - _gain(total_g, total_h, ridge)
    )
    best = int(gains.argmax())
    return float(gains[best]), best + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Values by bin of a regression tree of a few leaves, grown where the gain is largest."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, at, a, b = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return values


def _cross_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of a tree that cuts one number of a two-way table, then the other on each side."""
    gain, at = _cut(g.sum(axis=1), h.sum(axis=1), ridge)
    values = np.zeros(g.shape)
    for rows in (slice(0, at), slice(at, None)):
        more, cut = _cut(g[rows].sum(axis=0), h[rows].sum(axis=0), ridge)
        gain += more
        for columns in (slice(0, cut), slice(cut, None)):
            values[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
    return gain, values


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray,
    rounds: int = 120,
    pair_rounds: int = 40,
    most_pairs: int = 6,
    step: float = 0.15,
    ridge: float = 5.0,
) -> AdditiveModel:
    """Cyclic boosting of lookup tables to the labels ``y`` (0 or 1)."""
    edges = [_borders(x[:, j], 48) for j in range(x.shape[1])]
    pair_edges = [_borders(x[:, j], 12) for j in range(x.shape[1])]
    fine, coarse = _bins(x, edges), _bins(x, pair_edges)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    intercept = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = slopes()
            bins = fine[:, j]
            values = step * _shallow_tree(
                np.bincount(bins, g, len(table)), np.bincount(bins, h, len(table)), ridge
            )
            table += values
            total += values[bins]

    shapes = [len(e) + 1 for e in pair_edges]

    def crossed(j: int, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = coarse[:, j] * shapes[k] + coarse[:, k]
        size = shapes[j] * shapes[k]
        grids = [np.bincount(cell, v, size).reshape(shapes[j], shapes[k]) for v in (g, h)]
        first, second = _cross_tree(*grids, ridge), _cross_tree(*(v.T for v in grids), ridge)
        gain, values = first if first[0] >= second[0] else (second[0], second[1].T)
        return gain, values, cell

    gains = [(crossed(j, k)[0], j, k) for j, k in combinations(range(x.shape[1]), 2)]
    pairs = [(j, k) for gain, j, k in sorted(gains, key=lambda r: (-r[0], r[1:]))[:most_pairs] if gain > 1e-9]
    pair_tables = [np.zeros((shapes[j], shapes[k])) for j, k in pairs]
    for _ in range(pair_rounds):
        for (j, k), table in zip(pairs, pair_tables, strict=True):
            _, values, cell = crossed(j, k)
            table += step * values
            total += step * values.ravel()[cell]
    return AdditiveModel(intercept, edges, tables, pairs, pair_edges, pair_tables)


_FEATURE_SCHEMA = ", ".join(f"{name} double" for name in FEATURES)


def fit(docs: DataFrame, labels: DataFrame, most_documents: int = 15_000) -> AdditiveModel | float:
    """The model of the labelled documents outside the held-out third.

    Without documents of both labels, the share of good labels is returned instead (1 without any,
    so that nothing is rejected).
    """
    sample, sizes = labelled_sample(
        labels, "quality", is_held_out("doc_id", 3, 1), {0: most_documents, 1: most_documents}
    )
    rows = sample.collect()  # bounded by the limits
    if not sizes:
        return 1.0
    if len(sizes) < 2:
        return float(sizes.get(1, 0) > 0)
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, good int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")

    def numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(text_bytes(batch.column("text")))
        arrays = [batch.column("good"), *(pa.array(x[:, j]) for j in range(x.shape[1]))]
        return pa.RecordBatch.from_arrays(arrays, ["good", *FEATURES])

    found = map_text(texts, numbers, f"good int, {_FEATURE_SCHEMA}").toArrow()
    y = found.column("good").to_numpy().astype(float)
    x = np.column_stack([found.column(name).to_numpy() for name in FEATURES])
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 1.0
    order = np.lexsort((*x.T, y))  # the rows arrive in no fixed order
    x, y = x[order], y[order]
    taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y > 0, sizes[1] / taken[1], sizes[0] / taken[0])
    return fit_additive(x, y, weight * len(y) / weight.sum())


def _chance(model: AdditiveModel | float, texts: pa.Array) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    return 1 / (1 + np.exp(-np.clip(log_odds(model, features(text_bytes(texts))), -500, 500)))


def score(docs: DataFrame, model: AdditiveModel | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts are scored as texts without words. Rows are scored one by one, so repeated
    rows and ids do not matter; a null doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chance = pa.array(_chance(shared.value, batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), chance], ["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(plain, run, "doc_id long, score double").select(
        "doc_id",
        is_held_out("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: AdditiveModel | float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch):
                yield part.filter(pa.array(_chance(shared.value, part.column("text")) >= THRESHOLD))

    return short_batches(docs).mapInArrow(run, docs.schema)
