"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step hashes; bounds a task's temporary arrays.
STEP_BYTES = 500_000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory_returned() -> None:
    """Give what a task has freed back to the system: Python workers are used again, and beside them runs the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, STEP_BYTES) + 1
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def byte_values(fold_case: bool = True) -> np.ndarray:
    """A 64-bit value for each byte; A-Z share those of a-z when case is folded."""
    values = mix64(np.arange(1, 257, dtype=U64) * U64(_ODD))
    if fold_case:
        values[65:91] = values[97:123]
    return values


#: ASCII white space: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Everything in ASCII but letters and digits, for token streams that ignore punctuation.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

VALUES = byte_values()


class Words:
    """The words of several texts, hashed together.

    ``first[d]:first[d + 1]`` are the words of text d; ``hash`` holds a 64-bit
    hash of each word, a function of its case-folded bytes alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        n = len(data)
        inside = ~separators[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word ends with its text
        begins[edges] = inside[edges]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = edges_end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] = inside[edges_end]
        self.end = np.flatnonzero(ends) + 1
        up, down = _powers(n)
        with np.errstate(over="ignore"):
            self._sums = np.zeros(n + 1, U64)
            np.cumsum(VALUES[data] * up[:n], out=self._sums[1:], dtype=U64)
            self._down = down
            self.hash = self.of(self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start:end, for arrays of spans."""
        with np.errstate(over="ignore"):
            return mix64((self._sums[end] - self._sums[start]) * self._down[start] + U64(1))


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow string column in runs of about ``limit`` bytes.

    Yields (first row, row after the last, bytes, offsets into the bytes).
    Nulls are empty texts. A text above the limit makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def hashed(column: pa.Array, separators: np.ndarray = SPACES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) over a column, in bounded steps."""
    for at, to, data, offsets in steps(column):
        yield at, to, Words(data, offsets, separators)
