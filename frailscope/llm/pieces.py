"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text has an edge for every vocabulary piece that matches at a byte position and,
with a lower score, for every single byte. The best path comes from a forward Viterbi pass; its
scores are the exact heuristic of an A* search that runs backward from the end of the text, so the
search leaves the best path only where the next-best path does, and yields paths in order of score.

No piece crosses two neighbouring bytes that never stand side by side in a piece, so every path
passes through such places and the lattice falls into independent units, mostly words or parts of
them. Each batch computes the forward (and backward) scores of its distinct units with numpy. From
both, the loss of a unit's second-best path follows. The N best paths of a text can leave the best
path only in the N - 1 units of the smallest loss, so A* runs in those alone, and their paths are
merged by score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.llm.tokens import (
    Text,
    bytes_hash,
    gather,
    map_text,
    mix,
    prefix_hashes,
    segments,
    signed,
    span_hashes,
    text_bytes,
)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
_FALLBACK_PENALTY = 10.0
_BITS = 20
_EDGES_AT_ONCE = 1_000_000
_SPACE_MARK = "▁"
_LONG_UNIT = 1024
_MEMO_UNITS = 100_000
_SOLVED_UNITS = 500_000


class Vocabulary(NamedTuple):
    """Pieces as bytes, with a space for the model's space mark."""

    pieces: dict[bytes, tuple[int, float]]
    bytes_of: list[bytes]  # by id; empty for control pieces
    byte_ids: np.ndarray  # id of each single-byte fallback piece
    fallback: float
    hashes: np.ndarray  # sorted, with id and score of each
    ids: np.ndarray
    scores: np.ndarray
    filter: np.ndarray
    lengths: list[int]
    joined: np.ndarray  # 256 x 256: the two bytes are neighbours in some piece


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The pieces of a SentencePiece model file with byte fallback. Runs on the driver; about 1 MB."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        kind = "byte" if model.is_byte(i) else "" if model.is_control(i) or model.is_unknown(i) else "piece"
        entries.append((piece, model.get_score(i), kind))
    return make_vocabulary(entries)


def make_vocabulary(entries: list[tuple[str, float, str]]) -> Vocabulary:
    """From (piece, score, kind) in the order of ids; kind is ``piece``, ``byte`` (as <0x41>) or empty."""
    pieces: dict[bytes, tuple[int, float]] = {}
    bytes_of, byte_ids = [], np.full(256, -1, np.int64)
    for i, (piece, score, kind) in enumerate(entries):
        raw = b""
        if kind == "byte":
            byte_ids[int(piece[3:5], 16)] = i
            raw = bytes([int(piece[3:5], 16)])
        elif kind == "piece":
            raw = piece.replace(_SPACE_MARK, " ").encode()
            pieces[raw] = (i, float(score))
        bytes_of.append(raw)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback, so not every text can be encoded")
    lowest = min((s for p, (_, s) in pieces.items() if len(p.decode()) == 1), default=0.0)
    joined = np.zeros((256, 256), bool)
    for raw in pieces:
        for x, y in zip(raw, raw[1:]):
            joined[x, y] = True
    names = list(pieces)
    hashes = np.array([bytes_hash(p, fold=False) for p in names], np.uint64)
    order = np.argsort(hashes)
    marks = np.zeros(1 << _BITS, bool)
    marks[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return Vocabulary(
        pieces,
        bytes_of,
        byte_ids,
        lowest - _FALLBACK_PENALTY,
        hashes[order],
        np.array([pieces[names[i]][0] for i in order], np.int64),
        np.array([pieces[names[i]][1] for i in order]),
        marks,
        sorted({len(p) for p in pieces}),
        joined,
    )


def _find(vocabulary: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and id of the pieces with these hashes; minus infinity and -1 where there is none."""
    scores, ids = np.full(len(hashes), -np.inf), np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(vocabulary.filter[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    if len(maybe):
        at = np.minimum(np.searchsorted(vocabulary.hashes, hashes[maybe]), len(vocabulary.hashes) - 1)
        hit = vocabulary.hashes[at] == hashes[maybe]
        scores[maybe[hit]] = vocabulary.scores[at[hit]]
        ids[maybe[hit]] = vocabulary.ids[at[hit]]
    return scores, ids


class Units(NamedTuple):
    """Distinct units of a batch, in one order: best score, loss of the second-best path, pieces."""

    best: np.ndarray
    loss: np.ndarray
    counts: np.ndarray
    ids: np.ndarray  # all units' piece ids end to end
    first: np.ndarray


def _viterbi(vocabulary: Vocabulary, data: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: int):
    """Units of one length: (best, loss, whether a piece of the path starts at a byte, its id)."""
    n = len(start)
    # Edges by the byte where they end, longer pieces first and the single byte last: of equal
    # scores the path with the longer last piece is taken.
    edges: list[tuple[int, int]] = []
    ending = [0]
    fallback = []
    for t in range(1, size + 1):
        edges += [(t - length, t) for length in reversed(vocabulary.lengths) if length <= t]
        fallback.append(len(edges))
        edges.append((t - 1, t))
        ending.append(len(edges))
    source, target = np.array(edges).T
    score, ids = _find(
        vocabulary, span_hashes(prefix, (start + source[:, None]).ravel(), (start + target[:, None]).ravel())
    )
    score, ids = score.reshape(-1, n), ids.reshape(-1, n)
    score[fallback] = vocabulary.fallback
    ids[fallback] = vocabulary.byte_ids[data[start + np.arange(size)[:, None]]]

    every = np.arange(n)
    forward = np.zeros((size + 1, n))
    choice = np.zeros((size + 1, n), np.int64)
    for t in range(1, size + 1):
        own = slice(ending[t - 1], ending[t])
        through = forward[source[own]] + score[own]
        pick = through.argmax(axis=0)
        choice[t] = ending[t - 1] + pick
        forward[t] = through[pick, every]
    backward = np.zeros((size + 1, n))
    leaving = [np.flatnonzero(source == s) for s in range(size)]
    for s in range(size - 1, -1, -1):
        backward[s] = (score[leaving[s]] + backward[target[leaving[s]]]).max(axis=0)

    through = forward[source] + score + backward[target]
    begins, path = np.zeros((n, size), bool), np.zeros((n, size), np.int64)
    at, live = np.full(n, size), every
    while len(live):
        edge = choice[at[live], live]
        through[edge, live] = -np.inf
        at[live] = source[edge]
        begins[live, at[live]] = True
        path[live, at[live]] = ids[edge, live]
        live = live[at[live] > 0]
    # Any other path has an edge off the best one, so the best of those edges gives the second-best path.
    return forward[size], forward[size] - through.max(axis=0), begins, path


def _long_unit(vocabulary: Vocabulary, raw: bytes) -> tuple[float, float, list[int]]:
    """(best, loss, ids) of one unit, with memory in proportion to its length."""
    size = len(raw)
    forward, choice = [0.0] + [0.0] * size, [(0, 0)] * (size + 1)

    def arriving(t: int) -> Iterator[tuple[int, int, float]]:
        for length in reversed(vocabulary.lengths):
            entry = vocabulary.pieces.get(raw[t - length : t]) if length <= t else None
            if entry is not None:
                yield t - length, *entry
        yield t - 1, int(vocabulary.byte_ids[raw[t - 1]]), vocabulary.fallback

    for t in range(1, size + 1):
        best = max(arriving(t), key=lambda e: forward[e[0]] + e[2])
        forward[t] = forward[best[0]] + best[2]
        choice[t] = best[:2]
    ids, path, t = [], {}, size
    while t:
        path[t] = choice[t]
        ids.append(choice[t][1])
        t = choice[t][0]
    backward, other = [float("-inf")] * size + [0.0], float("-inf")
    for t in range(size, 0, -1):
        for s, piece, score in arriving(t):
            backward[s] = max(backward[s], score + backward[t])
            if path.get(t) != (s, piece):
                other = max(other, forward[s] + score + backward[t])
    return forward[size], forward[size] - other, ids[::-1]


def solve_units(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Units:
    prefix = prefix_hashes(data, fold=False)
    n = len(start)
    best, loss, counts = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    size = end - start
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for row in order[size[order] > _LONG_UNIT]:
        best[row], loss[row], ids = _long_unit(vocabulary, data[start[row] : end[row]].tobytes())
        counts[row] = len(ids)
        found.append((np.array([row]), np.array(ids), counts[[row]]))
    for same in np.split(order, cuts):
        if len(same) and size[same[0]] > _LONG_UNIT:
            continue
        # Long units have many edges, so fewer of them are worked on at once.
        at_once = max(1, _EDGES_AT_ONCE // (int(size[same[0]]) * (len(vocabulary.lengths) + 1))) if len(same) else 1
        for i in range(0, len(same), at_once):
            rows = same[i : i + at_once]
            if not len(rows):
                continue
            best[rows], loss[rows], used, ids = _viterbi(vocabulary, data, prefix, start[rows], int(size[rows[0]]))
            counts[rows] = used.sum(axis=1)
            found.append((rows, ids[used], counts[rows]))
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(first[-1], np.int64)
    for rows, ids, own in found:
        flat[np.arange(len(ids)) + np.repeat(first[rows] - np.concatenate([[0], np.cumsum(own)[:-1]]), own)] = ids
    return Units(best, loss, counts, flat, first)


class SolvedUnits:
    """Units solved so far, by hash; forgotten all at once when there are too many."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.units = Units(np.zeros(0), np.zeros(0), none, none, np.zeros(1, np.int64))
        self.hashes, self.rows = np.zeros(0, np.uint64), none

    def look_up(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of ``units`` for distinct ``hashes`` in ascending order, solving those that are new."""
        if len(self.hashes) > _SOLVED_UNITS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            old, more = self.units, solve_units(self.vocabulary, data, start[new], end[new])
            joined = [np.concatenate([a, b]) for a, b in zip(old[:4], more[:4], strict=True)]
            self.units = Units(*joined, np.concatenate([old.first, old.first[-1] + more.first[1:]]))
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.rows = np.insert(self.rows, at[new], np.arange(len(new)) + len(old.counts))
            at = np.searchsorted(self.hashes, hashes)
        return self.rows[at]


def unit_paths(vocabulary: Vocabulary, raw: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of ``raw`` as (score, ids), best first; fewer if there are no more.

    Forward Viterbi scores are the exact heuristic of the backward A* search. Of equal scores, the
    one that takes longer pieces from the end comes first.
    """
    size, longest = len(raw), vocabulary.lengths[-1] if vocabulary.lengths else 1
    arriving: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    forward = [0.0] + [float("-inf")] * size
    for t in range(1, size + 1):
        for s in range(max(0, t - longest), t):
            entry = vocabulary.pieces.get(raw[s:t])
            if entry is not None:
                arriving[t].append((s, *entry))
        arriving[t].append((t - 1, int(vocabulary.byte_ids[raw[t - 1]]), vocabulary.fallback))
        forward[t] = max(forward[s] + score for s, _, score in arriving[t])
    found: list[tuple[float, list[int]]] = []
    queue: list = [(-forward[size], 0, size, 0.0, None)]
    number = 0
    while queue and len(found) < n:
        _, _, t, behind, path = heapq.heappop(queue)
        if t == 0:
            ids = []
            while path is not None:
                ids.append(path[0])
                path = path[1]
            found.append((behind, ids))
            continue
        for s, piece, score in arriving[t]:
            number += 1
            heapq.heappush(queue, (-(forward[s] + score + behind), number, s, score + behind, (piece, path)))
    return found


def split_units(vocabulary: Vocabulary, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space before each text, unit starts, unit ends, first unit of each text)."""
    sizes = np.diff(text.bounds)
    used = sizes > 0
    shift = np.cumsum(used)
    data = np.full(len(text.data) + int(shift[-1] if len(shift) else 0), 32, np.uint8)
    data[np.arange(len(text.data)) + np.repeat(shift, sizes)] = text.data
    bounds = text.bounds + np.concatenate([[0], shift])
    cut = np.ones(len(data) + 1, bool)
    if len(data) > 1:
        cut[1:-1] = ~vocabulary.joined[data[:-1], data[1:]]
    cut[bounds] = True
    places = np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)
    start, end = places[:-1], places[1:]
    return data, start, end, np.searchsorted(start, bounds)


class Pieces:
    """Encoder and decoder for Arrow columns of texts."""

    def __init__(self, vocabulary: Vocabulary, n_best: int = N_BEST) -> None:
        self.vocabulary = vocabulary
        self.n_best = n_best
        sizes = [len(b) for b in vocabulary.bytes_of]
        self._sizes = np.array(sizes, np.int64)
        self._starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self._bytes = np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)
        self.solved = SolvedUnits(vocabulary)
        self._memo: dict[bytes, list[tuple[float, list[int]]]] = {}

    def paths(self, raw: bytes) -> list[tuple[float, list[int]]]:
        found = self._memo.get(raw)
        if found is None:
            if len(self._memo) >= _MEMO_UNITS:
                self._memo.clear()
            found = self._memo[raw] = unit_paths(self.vocabulary, raw, self.n_best)
        return found

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        """(piece ids end to end, first id of each text, N best scores of each text)."""
        ids, first, scores, _ = self.encode_n_best(text)
        return ids, first, scores

    def encode_n_best(self, text: Text, with_paths: bool = False) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[np.ndarray]]]:
        """:meth:`encode`, and with ``with_paths`` the ids of the N best segmentations of each text, the best one first."""
        data, start, end, first = split_units(self.vocabulary, text)
        hashes = span_hashes(prefix_hashes(data, fold=False), start, end)
        distinct, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
        which = self.solved.look_up(distinct, data, start[lead], end[lead])[which]
        units = self.solved.units
        ids = gather(units.ids, units.first[which], units.counts[which])
        unit_ids = np.concatenate([[0], np.cumsum(units.counts[which])]).astype(np.int64)
        counts = segments(units.counts[which], first)
        best = segments(units.best[which], first)
        loss = units.loss[which]
        scores: list[list[float]] = []
        found: list[list[np.ndarray]] = []
        for i in range(len(first) - 1):
            # What a segmentation loses against the best one, and where it leaves it: units and their other ids.
            kept: list[tuple[float, tuple[tuple[int, list[int]], ...]]] = [(0.0, ())]
            own = loss[first[i] : first[i + 1]]
            if self.n_best > 1 and len(own):
                few = self.n_best - 1
                near = np.argpartition(own, few - 1)[:few] if len(own) > few else np.arange(len(own))
                for k in near[np.isfinite(own[near])]:
                    unit = first[i] + k
                    paths = self.paths(data[start[unit] : end[unit]].tobytes())
                    usual = ids[unit_ids[unit] : unit_ids[unit + 1]].tolist()
                    others = [(paths[0][0] - score, ((unit, path),)) for score, path in paths if path != usual]
                    choices = [(0.0, ()), *others[:few]]
                    kept = sorted(((a + b, x + y) for a, x in kept for b, y in choices), key=lambda p: p[0])[: self.n_best]
            scores.append([float(best[i]) - drop for drop, _ in kept])
            if with_paths:
                ends = unit_ids[first[i]], unit_ids[first[i + 1]]
                found.append([_spliced(ids, *ends, unit_ids, changes) for _, changes in kept])
        return ids, np.concatenate([[0], np.cumsum(counts)]), scores, found

    def n_best_ids(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of one text in full."""
        data, start, end, _ = split_units(self.vocabulary, text_bytes(pa.array([text])))
        kept: list[tuple[float, list[int]]] = [(0.0, [])]
        for s, e in zip(start, end, strict=True):
            choices = self.paths(data[s:e].tobytes())
            kept = sorted(((a + b, x + y) for a, x in kept for b, y in choices), key=lambda p: -p[0])[: self.n_best]
        return kept

    def decode(self, ids: np.ndarray, first: np.ndarray) -> Text:
        """The texts of the piece ids; the space put before each text is taken away again."""
        sizes = self._sizes[ids]
        data = gather(self._bytes, self._starts[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[first]
        lead = ends[:-1][np.diff(ends) > 0]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return Text(data[keep], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)]))


def _spliced(ids: np.ndarray, start: int, end: int, unit_ids: np.ndarray, changes: tuple[tuple[int, list[int]], ...]) -> np.ndarray:
    """``ids`` from ``start`` to ``end`` with other ids for the units of ``changes``."""
    parts = []
    for unit, path in sorted(changes):
        parts += [ids[start : unit_ids[unit]], np.array(path, ids.dtype)]
        start = unit_ids[unit + 1]
    return np.concatenate([*parts, ids[start:end]]).astype(np.int32)


def same_texts(a: Text, b: Text) -> np.ndarray:
    """Per text whether the bytes are equal."""
    equal = np.diff(a.bounds) == np.diff(b.bounds)
    if equal.all():
        return segments((a.data != b.data).astype(np.int64), a.bounds) == 0
    for i in np.flatnonzero(equal):
        x, y = a.data[a.bounds[i] : a.bounds[i + 1]], b.data[b.bounds[i] : b.bounds[i + 1]]
        equal[i] = bool((x == y).all())
    return equal


_SCHEMA = "doc_id long, n_pieces long, ids_hash long, nbest_scores array<double>, round_trip boolean"


def encode(
    docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, with_ids: bool = True, with_paths: bool = False
) -> DataFrame:
    """(doc_id, n_pieces, ids_hash, nbest_scores, round_trip[, ids][, nbest_ids]) for every row of ``docs`` (doc_id, text).

    ``ids`` is the best segmentation, ``ids_hash`` a hash of it, ``nbest_scores`` the scores of the
    ``n_best`` best segmentations in falling order (fewer if the text has fewer), ``nbest_ids`` these segmentations
    in the same order, the first of them equal to ``ids``, and ``round_trip`` says whether decoding the ids gives the text back. A text is encoded with a space before it, a
    null or empty one has no pieces and one segmentation of score 0. Rows are worked on one by one,
    so repeated rows and ids do not matter.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    coders: list[Pieces] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not coders:
            coders.append(Pieces(vocabulary.value, n_best))
        coder = coders[0]
        text = text_bytes(batch.column("text"))
        ids, first, scores, paths = coder.encode_n_best(text, with_paths)
        same = same_texts(coder.decode(ids, first), text)
        place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        marks = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(place.astype(np.uint64)))
        arrays = [
            batch.column("doc_id"),
            pa.array(np.diff(first)),
            signed(segments(marks, first)),
            pa.array(scores, pa.list_(pa.float64())),
            pa.array(same),
        ]
        names = ["doc_id", "n_pieces", "ids_hash", "nbest_scores", "round_trip"]
        if with_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
            names.append("ids")
        if with_paths:
            flat = [path for own in paths for path in own]
            inner = np.concatenate([[0], np.cumsum([len(path) for path in flat])]).astype(np.int32)
            outer = np.concatenate([[0], np.cumsum([len(own) for own in paths])]).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            arrays.append(pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), values)))
            names.append("nbest_ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    more = (", ids array<int>" if with_ids else "") + (", nbest_ids array<array<int>>" if with_paths else "")
    return map_text(plain, run, _SCHEMA + more)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``text`` decoded from its piece ids; null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    schema = encoded.withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Pieces(vocabulary.value, 1)
        for batch in batches:
            column = batch.column(ids)
            counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = coder.decode(flat, np.concatenate([[0], np.cumsum(counts)]))
            raw = text.data.tobytes()
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(text.bounds[:-1], text.bounds[1:])]
            columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], [f.name for f in schema])

    return encoded.mapInArrow(run, schema)
