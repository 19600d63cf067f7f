"""Toxicity by two class-conditional Kneser-Ney models of the bytes of words.

A toxic and an ordinary model are estimated from labelled documents. Both predict each byte of a
word from up to five bytes before it, with absolute discounts and Kneser-Ney continuation counts,
down to the byte frequencies of both classes together, so an expression too rare to judge gets
nearly the same probability from either. A word's log-likelihoods are divided by its length; the
difference of the two is its evidence. A document is scored by its mean evidence over all words, its strongest
word and its length. A logistic curve over these, fitted on documents that the models had
not seen, gives the probability.

The models are fitted on a bounded sample of labelled documents: at most ``toxic_documents`` and
``ordinary_documents``, those with the smallest hashes of their ids. All their byte sequences count,
also those seen once. The documents themselves are all scored, in full, in one pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.llm.labels import labelled_sample
from frailscope.llm.tokens import (
    Remembered,
    gather,
    is_held_out,
    map_text,
    mix,
    prefix_hashes,
    segments,
    signed,
    span_hashes,
    text_bytes,
    words_of,
)

ORDER = 6
DISCOUNT = 0.75
THRESHOLD = 0.3
_ORDER_SALTS = np.arange(ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class KneserNey(NamedTuple):
    """Byte sequences of all orders by hash. For each class, 0 ordinary and 1 toxic: count, and as a context total and types."""

    grams: np.ndarray
    counts: np.ndarray  # 2 x grams
    totals: np.ndarray
    types: np.ndarray
    bytes: np.ndarray  # shared byte probabilities


class ToxicityModel(NamedTuple):
    kneser_ney: KneserNey
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray


def _marked(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words, each after a space; word of each byte; place of each byte in its word)."""
    word = np.repeat(np.arange(len(start)), size + 1)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.arange(len(word)) - first[word]
    out = np.full(len(word), 32, np.uint8)
    out[place > 0] = gather(data, start, size)
    return out, word, place


def _gram_hashes(data: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """By order, the hash of the byte sequence that ends at each byte; 0 where it would leave the word."""
    prefix, at = prefix_hashes(data), np.arange(len(data))
    found = []
    for order in range(1, ORDER + 1):
        start = at + 1 - order
        ok = place >= order - 1
        hashes = np.zeros(len(data), np.uint64)
        hashes[ok] = mix(span_hashes(prefix, start[ok], at[ok] + 1) + _ORDER_SALTS[order])
        found.append(hashes)
    return found


def _count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of byte sequences by class and fold, added up within the batch."""
    text = text_bytes(batch.column("text"))
    words = words_of(text)
    group = batch.column("toxic").to_numpy() * 2 + batch.column("fold").to_numpy()
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for g in np.unique(group):
        mine = np.flatnonzero(group[words.owner] == g)
        if not len(mine):
            continue
        _, lead, times = np.unique(words.hashes[mine], return_index=True, return_counts=True)
        lead = mine[lead]
        data, word, place = _marked(text.data, words.start[lead], words.end[lead] - words.start[lead])
        orders = _gram_hashes(data, place)
        for k, hashes in enumerate(orders):
            ok = np.flatnonzero(hashes)
            distinct, first, which = np.unique(hashes[ok], return_index=True, return_inverse=True)
            at = ok[first]
            n = np.bincount(which, times[word[ok]]).astype(np.int64)
            context = np.zeros(len(at), np.uint64)
            context[place[at] > 0] = (orders[k - 1] if k else np.zeros_like(hashes))[at[place[at] > 0] - 1]
            suffix = orders[k - 1][at] if k else np.zeros(len(at), np.uint64)
            whole = (place[at] == k).astype(np.int64)
            letter = data[at].astype(np.int64) | (k << 8) | (whole << 16) | (int(g) << 17)
            for column, values in zip(columns, (distinct, context, suffix, letter, n), strict=True):
                column.append(values)
    if not columns[0]:
        return pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in ("gram", "context", "suffix", "kind", "n")]))
    gram, context, suffix, kind, n = (np.concatenate(c) for c in columns)
    return pa.RecordBatch.from_arrays(
        [signed(gram), signed(context), signed(suffix), pa.array(kind), pa.array(n)], ["gram", "context", "suffix", "kind", "n"]
    )


def kneser_ney(table: dict[str, np.ndarray], folds: tuple[int, ...] = (0, 1)) -> KneserNey:
    """The models of counted byte sequences, of the given folds."""
    kind = table["kind"]
    fold, toxic = (kind >> 17) & 1, (kind >> 18) & 1
    chosen = np.isin(fold, folds)
    table = {c: v[chosen] for c, v in table.items()}
    toxic, kind = toxic[chosen], kind[chosen]
    grams, lead, which = np.unique(table["gram"], return_index=True, return_inverse=True)
    raw = np.array([np.bincount(which, table["n"] * (toxic == c), len(grams)) for c in (0, 1)])
    order, letter, whole = (kind[lead] >> 8) & 255, kind[lead] & 255, (kind[lead] >> 16) & 1
    context, suffix = table["context"][lead], table["suffix"][lead]

    def at(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are among the grams, and where."""
        place = np.minimum(np.searchsorted(grams, hashes), max(len(grams) - 1, 0))
        hit = np.flatnonzero(grams[place] == hashes) if len(grams) else np.zeros(0, np.int64)
        return hit, place[hit]

    # Below the top order, a sequence counts the different bytes before it, except at the word's start.
    counts = raw.copy()
    hit, place = at(suffix)
    lower = (order < ORDER - 1) & (whole == 0)
    for c in (0, 1):
        continued = np.bincount(place, (raw[c][hit] > 0) * (order[hit] > 0), len(grams))
        counts[c][lower] = continued[lower]
    hit, place = at(context)
    totals = np.array([np.bincount(place, counts[c][hit], len(grams)) for c in (0, 1)])
    types = np.array([np.bincount(place, counts[c][hit] > 0, len(grams)) for c in (0, 1)])
    single = order == 0
    shared = np.bincount(letter[single], raw[:, single].sum(axis=0), 256) + 1.0
    return KneserNey(grams, counts, totals, types, shared / shared.sum())


def word_evidence(model: KneserNey, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood of each word if toxic, minus that if ordinary."""
    marked, word, place = _marked(data, start, size)
    n = len(model.grams)
    chance = np.tile(model.bytes[marked], (2, 1))
    before = None
    for hashes in _gram_hashes(marked, place):
        ok = hashes != 0
        at = np.full(len(hashes), -1)
        if n:
            spot = np.minimum(np.searchsorted(model.grams, hashes[ok]), n - 1)
            at[ok] = np.where(model.grams[spot] == hashes[ok], spot, -1)
        if before is not None:
            context = np.full(len(hashes), -1)
            inner = np.flatnonzero(ok & (place > 0))
            context[inner] = before[inner - 1]
            known = np.flatnonzero(context >= 0)
            for c in (0, 1):
                total, types = model.totals[c][context[known]], model.types[c][context[known]]
                seen = known[total > 0]
                total, types = total[total > 0], types[total > 0]
                own = np.where(at[seen] >= 0, model.counts[c][at[seen]], 0)
                chance[c][seen] = (np.maximum(own - DISCOUNT, 0) + DISCOUNT * types * chance[c][seen]) / total
        before = at
    ratio = np.where(place > 0, np.log(chance[1]) - np.log(chance[0]), 0.0)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    return segments(ratio, first) / np.maximum(size, 1)


def _features(model: KneserNey, memory: Remembered, texts: pa.Array) -> np.ndarray:
    """Per text: mean evidence, strongest word, log of the words; zeros without words."""
    text = text_bytes(texts)
    words = words_of(text)
    distinct, lead, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    size = words.end - words.start
    evidence = memory.look_up(
        distinct, lambda new: word_evidence(model, text.data, words.start[lead[new]], size[lead[new]])[:, None]
    )[which, 0]
    counts = words.counts
    out = np.zeros((len(counts), 3))
    some = np.flatnonzero(counts)
    out[:, 0] = segments(evidence, words.first) / np.maximum(counts, 1)
    if len(some):
        out[some, 1] = np.maximum.reduceat(evidence, words.first[some])
    out[:, 2] = np.log1p(counts)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    toxic_documents: int = 6_000,
    ordinary_documents: int = 12_000,
) -> ToxicityModel | float:
    """The model of the labelled documents outside the held-out quarter; see the module's text.

    Without documents of both classes there is nothing to compare, and the share of toxic labels
    (0 without any) is returned instead.
    """
    sample, sizes = labelled_sample(
        labels, "toxic", is_held_out("doc_id", 4, 2), {1: toxic_documents, 0: ordinary_documents}
    )
    rows = sample.collect()  # bounded by the two limits
    taken = {k: sum(r["label"] == k for r in rows) for k in (0, 1)}
    if not taken[0] or not taken[1]:
        return sizes.get(1, 0) / max(1, sum(sizes.values()))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, toxic int")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", fold.alias("fold"))
    counted = map_text(texts, _count_grams, "gram long, context long, suffix long, kind long, n long")
    counted = counted.groupBy("gram", "context", "suffix", "kind").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # bounded by the documents of the sample
    table = {c: found.column(c).to_numpy() for c in found.column_names}
    table |= {c: table[c].view(np.uint64) for c in ("gram", "context", "suffix")}

    crossed = [docs.sparkSession.sparkContext.broadcast(kneser_ney(table, (1 - f,))) for f in (0, 1)]

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, 3))
        folds = batch.column("fold").to_numpy()
        for f in (0, 1):
            mine = np.flatnonzero(folds == f)
            if len(mine):
                out[mine] = _features(crossed[f].value, Remembered(1), batch.column("text").take(pa.array(mine)))
        arrays = [batch.column("toxic"), *(pa.array(out[:, i]) for i in range(3))]
        return pa.RecordBatch.from_arrays(arrays, ["toxic", "mean", "peak", "size"])

    seen = map_text(texts, features, "toxic int, mean double, peak double, size double").toArrow()
    x = np.column_stack([seen.column(c).to_numpy() for c in ("mean", "peak", "size")])
    y = seen.column("toxic").to_numpy().astype(float)
    if len(set(y)) < 2:
        return sizes.get(1, 0) / max(1, sum(sizes.values()))
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))  # the rows arrive in no fixed order
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weight = np.where(y > 0, sizes[1] / taken[1], sizes[0] / taken[0])
    weight = weight * len(y) / weight.sum()
    return ToxicityModel(kneser_ney(table), fit_logistic((x - centre) / scale, y, weight), centre, scale)


def score(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """(doc_id, held_out, score, predicted, mean_evidence, strongest_word) for every row (doc_id, text).

    Null and empty texts have no evidence and the score that follows from that. Rows are scored one
    by one; a null doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memory: list[Remembered] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        if isinstance(model, float):
            chance, x = np.full(batch.num_rows, model), np.zeros((batch.num_rows, 3))
        else:
            if not memory:
                memory.append(Remembered(1))
            x = _features(model.kneser_ney, memory[0], batch.column("text"))
            line = np.column_stack([(x - model.centre) / model.scale, np.ones(len(x))]) @ model.weights
            chance = 1 / (1 + np.exp(-np.clip(line, -500, 500)))
        arrays = [batch.column("doc_id"), pa.array(chance), pa.array(x[:, 0]), pa.array(x[:, 1])]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "mean_evidence", "strongest_word"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_text(plain, run, "doc_id long, score double, mean_evidence double, strongest_word double")
    return scored.select(
        "doc_id",
        is_held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "mean_evidence",
        "strongest_word",
    )
