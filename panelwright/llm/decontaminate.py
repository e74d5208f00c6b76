"""Benchmark passages in documents, found by spaced seeds.

A seed is a mask over consecutive words: the words under a 1 are hashed, those
under a 0 may be anything, so a replaced word breaks only the seeds that read
it. Seeds of the benchmark are looked up for every position of every document.
A hit fixes an alignment of document and item; the words around it are then
compared one by one, and the stretch with the most equal words counts among
those whose equal share is high enough. An overlap that no seed hits is missed.

The benchmark goes to the tasks in blocks of a bounded number of words, and
every block meets every document: memory is bounded by a block, a batch and
the longest single text. Documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import NON_WORD, U64, Words, memory_returned, mix64, steps

#: Words under a 1 are read. The first has no gap and serves short items too.
MASKS = ("11111111", "110110101101", "101101110011", "111001101011")
#: Words of a benchmark block; a longer item is a block of its own.
BLOCK_WORDS = 250_000
#: Fewer words than this make no item.
LEAST_WORDS = 8
_FILTER_BITS = 20


@dataclass
class Block:
    """Some benchmark items: their words' hashes, and their seeds sorted by hash."""

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    seeds: np.ndarray
    at: np.ndarray
    quick: np.ndarray


def _lowered(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column.cast(pa.string()) if pa.types.is_null(column.type) else column)


def seed_hashes(words: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask number, places, hashes) of all seeds that end within their text; ``last`` is the text end of each word."""
    places = np.arange(len(words))
    for m, mask in enumerate(MASKS):
        ok = places[places + len(mask) <= last]
        total = np.full(len(ok), m + 1, U64)
        with np.errstate(over="ignore"):
            for i, c in enumerate(mask):
                if c == "1":
                    total = total * U64(0x9FB21C651E98DF25) + words[ok + i]
        yield m, ok, mix64(total)


def _make_block(ids: list[int], hashes: list[np.ndarray]) -> Block:
    first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
    words = np.concatenate(hashes)
    last = np.repeat(first[1:], np.diff(first))
    found = list(seed_hashes(words, last))
    seeds = np.concatenate([h for _, _, h in found])
    at = np.concatenate([p for _, p, _ in found])
    order = np.argsort(seeds, kind="stable")
    quick = np.zeros(1 << _FILTER_BITS, bool)
    quick[(seeds >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Block(np.array(ids, np.int64), first, words, seeds[order], at[order], quick)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Benchmark items in blocks. Null ids or texts and items under ``LEAST_WORDS`` words are left out; repeats count once."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    ids, hashes, n = [], [], 0
    for row in items.dropna().distinct().toLocalIterator():
        for _, _, data, offsets in steps(_lowered(pa.array([row.t]))):
            h = Words(data, offsets, NON_WORD).hash
            if len(h) < LEAST_WORDS:
                continue
            if ids and n + len(h) > block_words:
                yield _make_block(ids, hashes)
                ids, hashes, n = [], [], 0
            ids.append(row.i), hashes.append(h)
            n += len(h)
    if ids:
        yield _make_block(ids, hashes)


def _stretch(equal: np.ndarray, percent: int) -> tuple[int, int, int]:
    """(start, end, agreeing words) of the stretch with the most agreements of those where at least ``percent`` % agree.

    A stretch qualifies if the balance of its ends does not fall, with ``100 - percent`` for an agreement and ``-percent`` for a
    difference; the longest one for each end starts at the first balance that is low enough.
    """
    count = np.concatenate([[0], np.cumsum(equal)])
    total = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int((count - count[begin]).argmax())
    inside = np.flatnonzero(equal[begin[end] : end])
    if not len(inside):
        return 0, 0, 0
    return int(begin[end] + inside[0]), int(begin[end] + inside[-1] + 1), len(inside)


def _overlaps(block: Block, words: Words, least: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, first word, words, agreeing words): the best overlap of each text and item."""
    hashes, first = words.hash, words.first
    last = np.repeat(first[1:], np.diff(first))
    lines = []
    for _, places, seeds in seed_hashes(hashes, last):
        maybe = block.quick[(seeds >> U64(64 - _FILTER_BITS)).astype(np.int64)]
        places, seeds = places[maybe], seeds[maybe]
        lo = np.searchsorted(block.seeds, seeds, "left")
        count = np.searchsorted(block.seeds, seeds, "right") - lo
        hit = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lines.append(np.stack([np.repeat(places, count), block.at[hit]], 1))
    lines = np.concatenate(lines)
    if not len(lines):
        return []
    text = np.searchsorted(first, lines[:, 0], "right") - 1
    item = np.searchsorted(block.first, lines[:, 1], "right") - 1
    diagonal = lines[:, 0] - (lines[:, 1] - block.first[item])  # where the item's first word would lie
    best: dict[tuple[int, int], tuple] = {}
    for d, i, at in np.unique(np.stack([text, item, diagonal], 1), axis=0):
        size = block.first[i + 1] - block.first[i]
        lo, hi = max(at, first[d]), min(at + size, first[d + 1])
        own = block.words[block.first[i] + lo - at : block.first[i] + hi - at]
        start, end, same = _stretch(hashes[lo:hi] == own, percent)
        if same >= max(LEAST_WORDS, min(least, -(-size * percent // 100))):
            rank = (-same, lo + start)
            if (d, i) not in best or rank < best[d, i][0]:
                best[d, i] = (rank, int(lo + start - first[d]), end - start, same)
    return [(int(d), int(block.ids[i]), *v[1:]) for (d, i), v in sorted(best.items())]


def _found(block: Block, texts: pa.Array, least: int, percent: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``_overlaps`` of a column, with its row numbers; texts are lowered and hashed in bounded steps."""
    for at, to, _, _ in steps(texts.cast(pa.string()) if pa.types.is_null(texts.type) else texts):
        for near, _, data, offsets in steps(_lowered(texts.slice(at, to - at))):
            for row in _overlaps(block, Words(data, offsets, NON_WORD), least, percent):
                yield (at + near + row[0], *row[1:])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least: int = 13, percent: int = 80, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows (``id_col``, item_id, first_word, n_words, n_equal): the best overlap of each document row and item.

    An overlap has at least ``least`` equal words (or ``percent`` % of a
    shorter item), and at least ``percent`` % of its words are equal. Case and ASCII punctuation do not count. Null and empty
    texts have none; repeated rows repeat their results; a null id stays null.
    """
    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` long, item_id long, first_word long, n_words long, n_equal long"

    def search(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(_found(block, b.column(1), least, percent))
                ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=[id_col, "item_id", "first_word", "n_words", "n_equal"])
            memory_returned()

        return own.mapInArrow(run, schema)

    out = None
    for block in blocks(benchmark, block_words=block_words):
        part = search(block)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = 13, percent: int = 80, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` without the rows that overlap an item; all columns and clean rows unchanged."""
    text_at = [c.lower() for c in docs.columns].index(text_col.lower())

    def keep(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for row in _found(block, b.column(text_at), least, percent):
                    clean[row[0]] = False
                yield b.filter(pa.array(clean))
            memory_returned()

        return run

    schema, out = docs.schema, docs
    for block in blocks(benchmark, block_words=block_words):
        out = out.mapInArrow(keep(block), schema)
    return out
