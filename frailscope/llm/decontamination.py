"""Benchmark decontamination by greedy string tiling.

Seeds are the 5-token sequences of the benchmark, found in every document by their rolling hash and
joined on it. The seeds that lie on one diagonal of a document and a benchmark item form its maximal
matches. Tiling takes the longest match again and again, cuts off what is already covered, and
stops below five tokens; so a passage whose sentences were moved is still covered, by several
tiles. A document is contaminated if the tiles cover at least half of an item's tokens.

The benchmark is a query set: it is processed in blocks of a fixed number of tokens, each small
enough to be sent to all executors, and every block meets all documents in one pass without a
shuffle. The size of the benchmark sets the number of passes, never the memory.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.llm.tokens import PUNCTUATION_BREAKS, Words, grams, map_text, pieces_of, short_batches, text_bytes, words_of

SEED_WORDS = 5
MIN_COVERAGE = 0.5
BLOCK_WORDS = 200_000
_BITS = 20
_PAIRS_AT_ONCE = 1 << 20


class Benchmark(NamedTuple):
    """One block of the benchmark, indexed by its seeds."""

    ids: list[str]
    words: list[np.ndarray]  # token hashes of each item
    seed: np.ndarray  # sorted seed hashes, with the item and the token position of each
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def _tokens(texts: pa.Array) -> Words:
    return words_of(text_bytes(texts), breaks=PUNCTUATION_BREAKS)


def index_benchmark(ids: list[str], texts: list[str | None]) -> Benchmark:
    """Items without a token match nothing.

    Items of fewer than five tokens are found only in documents that consist of nothing else: inside longer texts, one to four words
    in a row say nothing about where they come from.
    """
    words = _tokens(pa.array(texts, pa.string()))
    seed, first = grams(words, SEED_WORDS)
    item = np.repeat(np.arange(len(ids)), np.diff(first))
    place = np.arange(len(seed)) - first[item]
    order = np.argsort(seed, kind="stable")
    marks = np.zeros(1 << _BITS, bool)
    marks[(seed & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    own = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
    return Benchmark(ids, own, seed[order], item[order], place[order], marks)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """The benchmark (item_id, text) in blocks of about ``block_words`` tokens."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("text is not null")
    total = rows.agg(F.sum(F.ceil(F.length("text") / 4))).first()[0] or 0
    blocks = max(1, ceil(total / block_words))
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        found = part.collect()
        if found:
            yield index_benchmark([str(r["item_id"]) for r in found], [r["text"] for r in found])


def seed_runs(spots: np.ndarray, marks: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(start in the document, start in the item, seeds in a row) of the stretches where both go on with equal seeds.

    The document has the seed ``marks`` at its places ``spots``, in ascending order; the item has ``seeds``, sorted, at ``places``.
    Pairs of equal seeds are looked at in slices of the document, and only the stretches are kept, so a text that
    repeats the item's words thousands of times takes no more memory than others.
    """
    low = np.searchsorted(seeds, marks)
    counts = np.searchsorted(seeds, marks, side="right") - low
    upto = np.cumsum(counts)
    found, at = [np.zeros((0, 3), np.int64)], 0
    while at < len(spots):
        begin = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, begin + _PAIRS_AT_ONCE, side="right")))
        in_document = np.repeat(spots[at:end], counts[at:end])
        in_item = places[np.repeat(low[at:end], counts[at:end]) + _counting(counts[at:end])]
        found.append(_stretches(in_document, in_item, np.ones(len(in_item), np.int64)))
        at = end
    joined = np.concatenate(found)
    return _stretches(joined[:, 0], joined[:, 1], joined[:, 2])


def _counting(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``counts``, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _stretches(in_document: np.ndarray, in_item: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of one diagonal that follow each other, made one."""
    if not len(in_item):
        return np.zeros((0, 3), np.int64)
    diagonal = in_document - in_item
    order = np.lexsort((in_item, diagonal))
    diagonal, in_document, in_item, length = diagonal[order], in_document[order], in_item[order], length[order]
    apart = (np.diff(diagonal) != 0) | (np.diff(in_item) != length[:-1])
    first = np.concatenate([[0], np.flatnonzero(apart) + 1])
    return np.column_stack([in_document[first], in_item[first], np.add.reduceat(length, first)])


def tile(document_tokens: int, item_tokens: int, runs: np.ndarray, least: int) -> list:
    """Greedy string tiling from the stretches of shared seeds of ``least`` tokens.

    Returns tiles (start in the document, start in the item, length). Of equally long matches the
    one that begins earlier in the item, then in the document, is taken.
    """
    queue = [(-(n + least - 1), i, d) for d, i, n in runs.tolist()]
    heapq.heapify(queue)
    free_document, free_item = np.ones(document_tokens, bool), np.ones(item_tokens, bool)
    left = item_tokens
    tiles = []
    while queue and left >= least:
        length, i, d = heapq.heappop(queue)
        length = -length
        free = free_document[d : d + length] & free_item[i : i + length]
        if free.all():
            free_document[d : d + length] = False
            free_item[i : i + length] = False
            left -= length
            tiles.append((d, i, length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - b >= least:
                heapq.heappush(queue, (-(e - b), i + b, d + b))
    return tiles


def matches(batch: pa.RecordBatch, block: Benchmark) -> tuple[Words, dict[int, list[tuple[str, float, list]]]]:
    """Per row the items (id, coverage, tiles) that its text covers by at least half.

    Every row is worked on by itself, first with each of its different seeds once: they say which
    tokens of an item can be covered at all. Only items of which that is half are tiled.
    """
    words = _tokens(batch.column("text"))
    found: dict[int, list] = defaultdict(list)
    hashes, first = grams(words, SEED_WORDS)
    spots = np.flatnonzero(block.filter[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    low = np.minimum(np.searchsorted(block.seed, hashes[spots]), max(len(block.seed) - 1, 0))
    spots = spots[block.seed[low] == hashes[spots]] if len(block.seed) else spots[:0]
    rows = np.searchsorted(first, spots, side="right") - 1
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(rows) != 0, [True]])) if len(rows) else np.zeros(1, np.int64)
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        row = int(rows[b])
        marks = hashes[spots[b:e]]
        different = np.unique(marks)
        low = np.searchsorted(block.seed, different)
        counts = np.searchsorted(block.seed, different, side="right") - low
        posting = np.repeat(low, counts) + _counting(counts)
        posting = posting[np.lexsort((block.place[posting], block.item[posting]))]
        items, start = np.unique(block.item[posting], return_index=True)
        for item, own_seeds in zip(items.tolist(), np.split(posting, start[1:])):
            own = block.words[item]
            least = min(SEED_WORDS, len(own))
            # No tiling covers more than the union of the seeds.
            reach = np.zeros(len(own) + 1, np.int64)
            np.add.at(reach, block.place[own_seeds], 1)
            np.add.at(reach, block.place[own_seeds] + least, -1)
            if np.count_nonzero(np.cumsum(reach)) < MIN_COVERAGE * len(own):
                continue
            own_seeds = own_seeds[np.argsort(block.seed[own_seeds], kind="stable")]
            runs = seed_runs(spots[b:e] - first[row], marks, block.seed[own_seeds], block.place[own_seeds])
            tiles = tile(int(words.counts[row]), len(own), runs, least)
            coverage = sum(t[2] for t in tiles) / len(own)
            if coverage >= MIN_COVERAGE:
                found[row].append((block.ids[item], coverage, sorted(tiles)))
    return words, found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, coverage, items, tiles) for every row of ``docs`` (doc_id, text).

    Tokens are runs of characters other than ASCII punctuation and white space, with A-Z as a-z.
    ``items`` lists the ids of the covered items in text order, comma-joined, ``coverage`` is the
    largest covered share of an item, and ``tiles`` has ``item:start:end`` in tokens of the
    document for every tile. Items of one to four tokens are found only in documents of just these tokens. Null or empty texts are never contaminated; null benchmark texts are
    left out; equal items are found separately. Rows are judged one by one, so repeated or null ids
    do not matter.
    """
    result = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_items"),
        F.lit(0.0).alias("coverage"),
        F.lit("").alias("items"),
        F.lit("").alias("tiles"),
    )
    for block in benchmark_blocks(benchmark):
        result = map_text(result, _adding(docs, block), result.schema.simpleString()[7:-1])
    return result.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "coverage", "items", "tiles")


def _adding(docs: DataFrame, block: Benchmark):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, found = matches(batch, shared.value)
        if not found:
            return batch
        columns = {c: batch.column(c).to_pylist() for c in ("n_items", "coverage", "items", "tiles")}
        for i, hits in found.items():
            hits = sorted(hits)
            columns["n_items"][i] += len(hits)
            columns["coverage"][i] = max(columns["coverage"][i], *(c for _, c, _ in hits))
            columns["items"][i] = ",".join(filter(None, [columns["items"][i], *(x for x, _, _ in hits)]))
            spans = [f"{x}:{d}:{d + n}" for x, _, tiles in hits for d, _, n in tiles]
            columns["tiles"][i] = ",".join(filter(None, [columns["tiles"][i], *spans]))
        arrays = [
            pa.array(columns[f.name], f.type) if f.name in columns else batch.column(f.name) for f in batch.schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return add


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    for block in benchmark_blocks(benchmark):
        docs = short_batches(docs).mapInArrow(_clean_rows(docs, block), docs.schema)
    return docs


def _clean_rows(docs: DataFrame, block: Benchmark):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                _, found = matches(part, shared.value)
                if found:
                    keep = np.ones(part.num_rows, bool)
                    keep[list(found)] = False
                    part = part.filter(pa.array(keep))
                yield part

    return run
