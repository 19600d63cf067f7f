"""Alignment of the tokens of two tokenizers over the same bytes, by whitespace-token anchors.

Every text is encoded in full by both tokenizers. An anchor is a byte place where a token of each
ends and the next token of each starts with a space (or the text ends); both sides are checked, so
a split at an anchor never cuts a token. Anchors cut a text into windows of token ids, mostly one word
long. What happens inside a window depends on its ids alone, so windows are aligned once and
remembered under their two id tuples. How often a pair of ids is linked in the corpus is counted
in Spark, and so is what the counts say about each text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import lookup_join
from frailscope.llm.tokens import gather, map_text, segments
from frailscope.sources.scratch import store

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Texts beyond this many characters are encoded in parts, cut where neither tokenizer joins tokens.
PART_CHARS = 1 << 18
_MOST_WINDOWS = 200_000
_LONG_WINDOW = 256
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ID_BITS = 32
# Fixed value: how byte-level files split a text into words before merging.
_BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every token id, laid end to end."""

    def __init__(self, tokens: Sequence[bytes]) -> None:
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.starts[ids], self.lengths[ids])


def _ranked(file: dict) -> dict[bytes, int] | None:
    """Ids by bytes if the ids follow the merges, so that merging by the least id is what the file says; else None."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = file.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout")
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids, shown = model["vocab"], byte_level_bytes()
    in_order = all(ids.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    if not (plain and usual and in_order and all(ids.get(c, 256) < 256 for c in shown)):
        return None
    return {bytes(shown[c] for c in token): i for token, i in ids.items() if i < 256 + len(merges)}


class Encoders:
    """Both tokenizers, without special tokens: every text is encoded with a space before it.

    A byte-level file whose ids follow its merges is encoded by rank, which is several times faster and gives the same
    ids; any other file by its own library.
    """

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        file = json.loads(byte_level)
        ranks = _ranked(file)
        if ranks is not None:
            import tiktoken

            self._a = tiktoken.Encoding("byte_level", pat_str=_BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
            self._encode_a = self._a.encode_ordinary
        else:
            from tokenizers import Tokenizer

            self._a = Tokenizer.from_buffer(byte_level)
            self._a.encode_special_tokens = True
            self._encode_a = lambda text: self._a.encode(text, add_special_tokens=False).ids
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        shown = byte_level_bytes()
        spelled = file["model"]["vocab"] | {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        tokens = [b""] * (max(spelled.values()) + 1)
        for token, i in spelled.items():
            tokens[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.a = Vocabulary(tokens)
        names = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b = Vocabulary(
            [
                bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(names)
            ]
        )
        # With a space inside a piece, tokens could reach over a cut.
        self._whole = any("▁" in p.lstrip("▁") for p in names)

    def _parts(self, text: str) -> list[str]:
        if len(text) <= PART_CHARS or self._whole:
            return [text]
        cuts, at = [], 0
        while found := _CUT.search(text, at + PART_CHARS):
            cuts.append(text[at : found.start()])
            at = found.end()
        return [*cuts, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens of A per text, ids of B, tokens of B per text); empty texts have no tokens."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                parts.append(part)
                owner.append(i)
        found = []
        for lists in ([self._encode_a(f" {p}") for p in parts], self._b.encode(parts, num_threads=1) if parts else []):
            counts = np.zeros(len(texts), np.int64)
            np.add.at(counts, np.array(owner, np.int64), [len(x) for x in lists])
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
            found += [flat, counts]
        return tuple(found)


class Windows:
    """What is known about windows: their groups in writing and the id pairs they link."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self._a, self._b = a, b
        self._forget()

    def _forget(self) -> None:
        self._known: dict[tuple[bytes, bytes], int] = {}
        self.written: list[str] = []
        self.n_groups = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def look_up(self, ids_a: np.ndarray, cuts_a: np.ndarray, ids_b: np.ndarray, cuts_b: np.ndarray) -> np.ndarray:
        """The number of each window between neighbouring cuts, for use until the next call."""
        if len(self._known) > _MOST_WINDOWS:
            self._forget()
        raw_a, raw_b = ids_a.astype(np.uint32).tobytes(), ids_b.astype(np.uint32).tobytes()
        known, new = self._known, []
        out = np.empty(len(cuts_a) - 1, np.int64)
        number = len(self.written)
        places_a, places_b = (4 * cuts_a).tolist(), (4 * cuts_b).tolist()
        for k, (s, e, t, u) in enumerate(zip(places_a, places_a[1:], places_b, places_b[1:])):
            key = (raw_a[s:e], raw_b[t:u])
            found = known.get(key)
            if found is None:
                found = number
                number += 1
                new.append(k)
                if e - s < 4 * _LONG_WINDOW:
                    known[key] = found
            out[k] = found
        if new:
            at = np.array(new)
            sizes_a, sizes_b = cuts_a[at + 1] - cuts_a[at], cuts_b[at + 1] - cuts_b[at]
            self._align(gather(ids_a, cuts_a[at], sizes_a), sizes_a, gather(ids_b, cuts_b[at], sizes_b), sizes_b)
        return out

    def _align(self, ids_a: np.ndarray, sizes_a: np.ndarray, ids_b: np.ndarray, sizes_b: np.ndarray) -> None:
        """Add windows, laid end to end: both sides of a window spell the same bytes, so they stay in step."""
        ends_a, ends_b = np.cumsum(self._a.lengths[ids_a]), np.cumsum(self._b.lengths[ids_b])
        # Each token is linked with those from the one its first byte lies in to the one of its last byte.
        first = np.searchsorted(ends_b, ends_a - self._a.lengths[ids_a], side="right")
        counts = np.searchsorted(ends_b, ends_a, side="left") - first + 1
        links = np.repeat(ids_a << _ID_BITS, counts) | gather(ids_b, first, counts)
        n_links = segments(counts, np.concatenate([[0], np.cumsum(sizes_a)]))
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts_a = [0, *(np.searchsorted(ends_a, shared) + 1).tolist()]
        cuts_b = [0, *(np.searchsorted(ends_b, shared) + 1).tolist()]
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups = [
            f"{a[s]}|{b[t]}" if e - s == u - t == 1 else f"{','.join(a[s:e])}|{','.join(b[t:u])}"
            for s, e, t, u in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        upto = np.searchsorted(shared, ends_a[np.cumsum(sizes_a) - 1]) + 1
        places = [0, *upto.tolist()]
        self.written += [";".join(groups[s:e]) for s, e in zip(places, places[1:])]
        self.n_groups = np.concatenate([self.n_groups, np.diff(places)])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.counts = np.concatenate([self.counts, n_links])
        self.pairs = np.concatenate([self.pairs, links])


def _without(ids: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, counts)], np.where(keep, counts, 0)


def align_texts(texts: list[str], coder: Encoders, windows: Windows) -> dict[str, list | np.ndarray]:
    """Per text: token numbers, groups (in writing), links, and its distinct linked pairs with their numbers."""
    ids_a, n_a, ids_b, n_b = coder.encode(texts)
    raw = [b" " + t.encode() if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    for ids, counts, vocabulary in ((ids_a, n_a, coder.a), (ids_b, n_b, coder.b)):
        lengths = segments(vocabulary.lengths[ids], np.concatenate([[0], np.cumsum(counts)]))
        good = lengths == sizes
        joined = vocabulary.bytes_of(_without(ids, counts, good)[0])
        wanted = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])
        good &= segments((joined != wanted).astype(np.int64), bounds) == 0
        ids_a, n_a = _without(ids_a, n_a, good)
        ids_b, n_b = _without(ids_b, n_b, good)
        sizes = np.where(good, sizes, 0)
        raw = [r if g else b"" for r, g in zip(raw, good)]
    full = sizes > 0
    ends = np.cumsum(sizes[full])

    def anchors(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        token_ends = np.cumsum(vocabulary.lengths[ids])
        before_space = np.ones(len(ids), bool)
        before_space[:-1] = vocabulary.spaced[ids[1:]]
        return token_ends, token_ends[before_space | np.isin(token_ends, ends)]

    ends_a, marked_a = anchors(ids_a, coder.a)
    ends_b, marked_b = anchors(ids_b, coder.b)
    cuts = np.intersect1d(marked_a, marked_b)
    cuts_a = np.concatenate([[0], np.searchsorted(ends_a, cuts) + 1])
    cuts_b = np.concatenate([[0], np.searchsorted(ends_b, cuts) + 1])
    number = windows.look_up(ids_a, cuts_a, ids_b, cuts_b)

    # Windows per text; texts without tokens have none.
    upto = np.zeros(len(texts), np.int64)
    upto[full] = np.searchsorted(cuts, ends) + 1
    last = np.maximum.accumulate(upto) if len(texts) else upto
    first = np.concatenate([[0], last]).astype(np.int64)
    places = first.tolist()
    written = windows.written
    listed = number.tolist()
    groups = [";".join([written[w] for w in listed[s:e]]) for s, e in zip(places, places[1:])]

    link_counts = windows.counts[number]
    pairs = gather(windows.pairs, windows.starts[number], link_counts)
    names, codes = np.unique(pairs, return_inverse=True)
    owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(first)), link_counts)
    keys, times = np.unique(owner * max(len(names), 1) + codes, return_counts=True)
    per_text = np.bincount(keys // max(len(names), 1), minlength=len(texts)) if len(keys) else np.zeros(len(texts), np.int64)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": segments(windows.n_groups[number], first),
        "n_links": segments(link_counts, first),
        "groups": groups,
        "pair_bounds": np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32),
        "pairs": names[keys % max(len(names), 1)] if len(keys) else np.zeros(0, np.int64),
        "times": times.astype(np.int32),
    }


def read_file(df: DataFrame, path: str) -> bytes:
    """The file of a tokenizer, read by the driver; such files have a few megabytes at most."""
    with open(path, "rb") as file:
        return file.read()


_DIGESTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align(
    docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, with_groups: bool = True
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): how its tokens of both tokenizers lie over each other.

    (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]); ``row`` names
    the row in the stored result. ``groups`` lists the stretches between places where a token of
    each tokenizer ends, as ``a1,a2|b1;a3|b2,b3``. A link is a token of each whose bytes overlap;
    ``pairs`` are the distinct linked ids (that of A shifted left by 32, or that of B) and
    ``times`` how many links have them.

    Null and empty texts, and texts that the tokens of one tokenizer do not spell, have no tokens:
    zeros, empty lists and an empty ``groups_sha256``. Rows are worked on one by one, so null or
    repeated ids and repeated rows do not matter; other columns are ignored. Long texts are encoded
    in parts, with the same tokens.
    """
    files = docs.sparkSession.sparkContext.broadcast(
        tuple(zlib.compress(read_file(docs, p), 1) for p in (byte_level, pieces))
    )
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        task = TaskContext.get()
        if not state:
            coder = Encoders(*map(zlib.decompress, files.value))
            state.extend([coder, Windows(coder.a, coder.b), 0])
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        found = align_texts(texts, state[0], state[1])
        start = (task.partitionId() << 40) + state[2]
        state[2] += len(texts)
        bounds = pa.array(found["pair_bounds"])
        columns = {
            "row": pa.array(np.arange(start, start + len(texts))),
            "doc_id": batch.column("doc_id"),
            **{c: pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")},
            "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]),
            "pairs": pa.ListArray.from_arrays(bounds, pa.array(found["pairs"])),
            "times": pa.ListArray.from_arrays(bounds, pa.array(found["times"])),
        }
        if with_groups:
            columns["groups"] = pa.array(found["groups"], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _DIGESTS + ", pairs array<long>, times array<int>" + (", groups string" if with_groups else "")
    return map_text(plain, run, schema)


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): links of each id pair in the corpus, and whether its id of B has no pair with more.

    There are at most as many rows as pairs of ids, and at most one row per id of B is broadcast.
    """
    counts = store(_links(aligned).groupBy("pair").agg(F.sum("times").alias("links")), "pair_counts")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    most = counts.groupBy(id_b.alias("id_b")).agg(F.max("links").alias("most"))
    return counts.withColumn("id_b", id_b).join(F.broadcast(most), "id_b").select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best")
    )


def count_links(aligned: DataFrame) -> DataFrame:
    """The stored ``aligned`` with ``n_best`` and ``count_sum``, from the corpus-wide counts of its pairs."""
    counted = lookup_join(_links(aligned), pair_counts(aligned), "pair")
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    )
    return aligned.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def cross_tokenizer_alignment(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    aligned = store(align(docs, byte_level, pieces, with_groups=False), "aligned")
    return count_links(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
