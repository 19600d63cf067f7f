"""Words of Arrow text batches as hash arrays, and small helpers shared by the operators.

A word is a maximal run of characters other than space and the control characters 9 to 13. Letters
A-Z count as a-z. Hashing is done on the UTF-8 bytes with numpy: the hash of a word is a difference
of two prefix sums, so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The same words as a regular expression, for use in Spark SQL and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 1 << 64, 256, dtype=_U)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Marks every ASCII character but letters and digits, for matching that ignores punctuation.
PUNCTUATION_BREAKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_POSITION_FACTORS = _rng.integers(1 << 62, 1 << 64, 64, dtype=_U) | _U(1)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 20)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Text(NamedTuple):
    """The texts of a batch laid end to end; nulls are empty. ``bounds`` has one entry more than texts."""

    data: np.ndarray
    bounds: np.ndarray


def text_bytes(column: pa.Array) -> Text:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return Text(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def prefix_hashes(data: np.ndarray, fold: bool = True) -> np.ndarray:
    """``h`` with one entry more than ``data``; see :func:`span_hashes`."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_FOLDED_VALUES if fold else _BYTE_VALUES)[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def bytes_hash(value: bytes, fold: bool = True) -> int:
    data = np.frombuffer(value, np.uint8)
    return int(span_hashes(prefix_hashes(data, fold), np.array([0]), np.array([len(data)]))[0])


class Words(NamedTuple):
    start: np.ndarray  # byte position in the batch
    end: np.ndarray
    first: np.ndarray  # per text the index of its first word, and one entry more
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(text: Text, fold: bool = True, breaks: np.ndarray = _IS_SPACE) -> Words:
    """The words between the bytes marked in ``breaks``, by default white space."""
    data, bounds = text
    inside = ~breaks[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    hashes = span_hashes(prefix_hashes(data, fold), start, end)
    return Words(start, end, first, hashes)


def grams(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and per text the index of its first window.

    With ``short``, a text of fewer words has its whole sequence as one window.
    """
    n = len(words.hashes)
    counts = words.counts
    windows = np.maximum(counts - size + 1, 0)
    total = np.zeros(max(n - size + 1, 0), _U)
    for k in range(size):
        total += words.hashes[k : k + len(total)] * _POSITION_FACTORS[k]
    skip = np.concatenate([[0], np.cumsum(counts - windows)])
    first = np.concatenate([[0], np.cumsum(windows)])
    take = np.arange(first[-1]) + np.repeat(skip[:-1], windows)
    hashes = mix(total[take])
    small = np.flatnonzero((counts > 0) & (counts < size)) if short else []
    if len(small):
        own = [
            mix(
                np.array(
                    [
                        sum(
                            int(h) * int(f)
                            for h, f in zip(words.hashes[words.first[i] : words.first[i + 1]], _POSITION_FACTORS)
                        )
                        % (1 << 64)
                    ],
                    _U,
                )
                + _U(counts[i])
            )[0]
            for i in small
        ]
        hashes = np.insert(hashes, first[small], own)
        windows = windows.copy()
        windows[small] = 1
        first = np.concatenate([[0], np.cumsum(windows)])
    return hashes, first


def segments(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring entries of ``first``; empty stretches give 0."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def gather(values: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``start``, end to end."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return values[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], counts)]


class Remembered:
    """Rows of numbers computed once per hash; all are forgotten when there are more than ``most``."""

    def __init__(self, width: int, most: int = 2_000_000) -> None:
        self.width, self.most = width, most
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, _U), np.zeros((0, self.width))

    def look_up(self, hashes: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Rows for distinct ascending ``hashes``; ``compute`` gets the indexes of the new ones."""
        if len(self.hashes) > self.most:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self.rows = np.insert(self.rows, at[new], compute(new), axis=0)
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        return self.rows[at]


def pieces_of(batch: pa.RecordBatch, text: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of text, so that numpy buffers stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        floor = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, floor + most_bytes, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``rows`` rows unless the user has chosen a number.

    Spark's ten thousand rows are meant for numbers; with texts they take tens of megabytes in every task, on both sides.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_ARROW_ROWS)) == 10_000:
        conf.set(_ARROW_ROWS, str(rows))
    return df


def give_back() -> None:
    """Return freed memory to the system at the end of a task; Spark uses its Python workers again and again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not with this C library
        pass


def map_text(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text"
) -> DataFrame:
    """Apply ``function`` to bounded slices of the rows, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, text):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return short_batches(df).mapInArrow(run, schema)


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(values.view(np.int64))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the decimal text modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def is_held_out(column: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(crc_remainder(column, modulus) == remainder, F.lit(False))
