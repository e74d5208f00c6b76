"""Alignment of two tokenizers' ids over the same bytes, by anchors at space-marked tokens.

Both tokenizers encode a whole text. Where a token of either ends at the same
byte, the two streams share an end. Shared ends before tokens that start with
a space in both streams are anchors; they cut a document into windows, short
tuples of ids. A window's alignment (its groups, its links) depends on its
two tuples alone, so it is worked out once and looked up afterwards.

Counts over the corpus use the links at the shared ends. Documents are read
in chunks; a chunk numbers the distinct pairs of ids that are linked in it and
keeps, for each document, which ones it holds and how often. A pair is a row of
its chunk, however many windows and documents hold it: these rows give the
count of every pair over the corpus, and the counts go back to the chunks that
numbered the pair, packed as arrays. No token and no window leaves its task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.common import mix64
from panelwright.llm.tokens import ID, ByteLevel, Memo, Parted, Pieces, gathered, loaded, packed_between, text_steps
from panelwright.semantics import BROADCAST_BYTES, broadcast_if_small, persisted

#: A chunk ends above these: distinct windows, their links (and distinct pairs), and pairs named by documents. They bound a task's memory.
CHUNK_WINDOWS, CHUNK_IDS, CHUNK_NAMES = 300_000, 6_000_000, 5_000_000

#: Bytes of text aligned at once; a step holds some twenty numbers for each of its tokens.
STEP = 1_000_000

#: Parts remembered in a generation.
PARTS = 240_000


class Aligner:
    """Two tokenizers with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = loaded(ByteLevel, path_a, special=False), loaded(Pieces, path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.width_a, self.width_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.marked_a, self.marked_b = (np.array([t[:1] == b" " for t in v], bool) for v in (self.bytes_a, self.bytes_b))
        #: ids as text with the sign after them: "," inside a group, "|" after A's last, ";" after B's last
        self.written = [f"{i}{c}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for i in range(n) for c in (",", last)]
        #: part -> (ids of A, ids of B, whether both give its bytes back)
        self._parts = Memo(self._both, PARTS)

    def _same(self, ids: bytes, table: list[bytes], whole: bytes) -> bool:
        return b"".join(map(table.__getitem__, array("I", ids))) == whole

    def _both(self, texts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        a, b = self.a.after_spaces(texts), self.b.whole(texts)
        whole = [(" " + t).encode() for t in texts]
        same = np.ones(len(texts), bool)
        for coded, widths, table in ((a, self.width_a, self.bytes_a), (b, self.width_b, self.bytes_b)):
            flat = np.frombuffer(b"".join(coded), ID)
            stops = np.cumsum([len(c) // ID.itemsize for c in coded], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(widths[flat])])[stops]
            # all at once; one by one only where something differs
            if (ends != np.cumsum([len(w) for w in whole])).any() or b"".join(map(table.__getitem__, flat.tolist())) != b"".join(whole):
                same &= [self._same(c, table, w) for c, w in zip(coded, whole)]
        return list(zip(a, b, same.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both for a space and each text; both empty where a text is empty or its bytes do not come back."""
        if not texts:
            return []
        divisible = self.a.divisible and self.b.divisible
        # a text that starts with white space, or that B reads differently as a whole, is no union of parts
        cuts = Parted(texts, lambda t: not divisible or "\u2581" in t or t[:1].isspace())
        values = self._parts(cuts.parts)
        wrong = np.array([not v[2] for v in values], bool)
        odd = np.add.reduceat(wrong[cuts.numbers].astype(np.int64), cuts.bounds[:-1])
        streams = []
        for i in (0, 1):
            flat, stops = gathered(cuts.numbers, [v[i] for v in values])
            streams.append(packed_between(flat, stops[cuts.bounds[1:] - 1]))
        out = list(zip(*streams))
        for i in np.flatnonzero((odd > 0) | np.array([not t for t in texts])).tolist():
            whole = (" " + texts[i]).encode()
            if not texts[i] or not all(self._same(ids, t, whole) for ids, t in zip(out[i], (self.bytes_a, self.bytes_b))):
                out[i] = (b"", b"")
        return out

    def shared_ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``a`` and in ``b`` of the tokens that end together, in order."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        at = np.searchsorted(ends_b, ends_a)
        at[at == len(ends_b)] = 0
        hit = ends_b[at] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
        return np.flatnonzero(hit), at[hit]

    def windows(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
        """Which shared ends close a window: those before space-marked tokens, and the last one.

        Texts may stand one after the other: each starts with a space, and its
        end is shared, so no window goes on in the next text.
        """
        if not len(end_a):
            return np.zeros(0, np.int64)
        next_a, next_b = np.minimum(end_a + 1, len(a) - 1), np.minimum(end_b + 1, len(b) - 1)
        anchor = self.marked_a[a[next_a]] & self.marked_b[b[next_b]]
        anchor[-1] = True
        return np.flatnonzero(anchor)

    def distinct(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a window of each kind, kind of each window): windows with equal id tuples are one kind.

        Windows are brought together by a hash of their tuples and then
        compared id by id; should two different ones ever share a hash, every
        window counts as its own kind, which the id tuples set right later.
        """
        n = len(stop_a)
        mixed = np.zeros(n, np.uint64)
        streams = [(v, s, np.concatenate([[0], s[:-1]])) for v, s in ((a, stop_a), (b, stop_b))] if n else []
        with np.errstate(over="ignore"):
            for ids, stop, start in streams:
                place = np.arange(len(ids)) - np.repeat(start, stop - start)
                value = mix64(ids.astype(np.uint64) + place.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(1))
                mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + np.add.reduceat(value, start) + (stop - start).astype(np.uint64))
        _, kinds, group = np.unique(mixed, return_index=True, return_inverse=True)
        for ids, stop, start in streams:
            like = kinds[group]
            same = (stop - start) == (stop - start)[like]
            if not same.all() or (ids != ids[_spans(start[like], stop[like])]).any():
                return np.arange(n), np.arange(n)
        return kinds, group

    def described(self, a, b, end_a, end_b, first, stop, from_a, from_b) -> list[str]:
        """Group texts of windows, from the groups ``first:stop`` of each."""
        groups = _spans(first, stop)
        # a group starts where the one before ends, the first of a window at the window's start
        begin_a, begin_b = (np.where(groups > 0, e[groups - 1] + 1, 0) for e in (end_a, end_b))
        lead = np.cumsum(stop - first) - (stop - first)
        begin_a[lead], begin_b[lead] = from_a, from_b
        n_a, n_b = end_a[groups] + 1 - begin_a, end_b[groups] + 1 - begin_b
        # A's tokens of a group, then B's; each with the sign that follows it
        both = np.cumsum(n_a + n_b)
        out = np.empty(both[-1], np.int64)
        base = 2 * len(self.bytes_a)
        start = both - n_a - n_b
        out[_spans(start, start + n_a)] = 2 * a[_spans(begin_a, begin_a + n_a)].astype(np.int64)
        out[_spans(start + n_a, both)] = base + 2 * b[_spans(begin_b, begin_b + n_b)].astype(np.int64)
        out[start + n_a - 1] += 1
        out[both - 1] += 1
        signs, cuts = out.tolist(), both[np.cumsum(stop - first) - 1].tolist()
        written = self.written
        return ["".join([written[c] for c in signs[i:j]])[:-1] for i, j in zip([0, *cuts], cuts)]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): ids of each text and, for every group, the positions after its last tokens.

    Null and empty texts, and texts whose bytes do not come back from either
    stream, have empty arrays. A text is held whole by its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = loaded(Aligner, path_a, path_b=path_b)
        for batch in batches:
            for step in text_steps(batch, 1, STEP):
                rows = []
                for a, b in one.encode([t or "" for t in step.column(1).to_pylist()]):
                    a, b = np.frombuffer(a, ID), np.frombuffer(b, ID)
                    rows.append((a, b, *(e + 1 for e in one.shared_ends(a, b))))
                cols = [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in range(4)]
                yield pa.RecordBatch.from_arrays([step.column(0), *cols], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


# ---- statistics over the corpus -------------------------------------------

_CHUNKS = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "names array<int>, times array<int>, name int, n long, a_id int, b_id int"
)


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0], ..., stop[0] - 1, start[1], ..."""
    n = stop - start
    upto = np.cumsum(n)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + n, n)


class _Chunk:
    """Distinct windows by their id tuples with their group text, and the linked pairs with how often they came."""

    def __init__(self, number: int):
        self.number = number
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.n_links = 0
        #: pair (one number for both ids) -> its name in this chunk
        self.pairs: dict[int, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.named = 0

    def full(self) -> bool:
        return len(self.texts) > CHUNK_WINDOWS or max(self.n_links, len(self.pairs)) > CHUNK_IDS or self.named > CHUNK_NAMES

    def learn(self, key: tuple[bytes, bytes], text: str) -> int:
        code = self.known[key] = len(self.texts)
        self.texts.append(text)
        return code

    def names(self, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Names of pairs that came so many times; equal pairs may stand several times."""
        distinct, place = np.unique(pairs, return_inverse=True)
        pairs_known = self.pairs
        names = np.array([pairs_known.setdefault(p, len(pairs_known)) for p in distinct.tolist()], np.int64)[place]
        if len(self.counts) < len(pairs_known):
            self.counts = np.concatenate([self.counts, np.zeros(max(len(pairs_known), 1 << 12), np.int64)])
        np.add.at(self.counts, names, times)
        return names


def _chunks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """A row for each document and one for each pair of ids that a chunk links; memory is bounded by a chunk and a text."""
    one = loaded(Aligner, path_a, path_b=path_b)
    base = TaskContext.get().partitionId() << 32
    ints = pa.list_(pa.int32())
    kinds = [("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]
    kinds += [("names", ints), ("times", ints), ("name", pa.int32()), ("n", pa.int64()), ("a_id", pa.int32()), ("b_id", pa.int32())]
    schema = pa.schema(kinds)
    size = ID.itemsize
    ids_b = len(one.bytes_b)
    all_pairs = len(one.bytes_a) * ids_b
    chunk = _Chunk(base)

    def table(rows: int, cols: dict) -> pa.RecordBatch:
        filled = [cols[f.name].cast(f.type) if f.name in cols else pa.nulls(rows, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(filled, schema=schema)

    def lists(offsets: np.ndarray, values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(values, np.int32)))

    def close() -> pa.RecordBatch:
        n, pairs = len(chunk.pairs), np.fromiter(chunk.pairs, np.int64, len(chunk.pairs))
        cols = {"chunk": pa.array(np.full(n, chunk.number)), "name": pa.array(np.arange(n, dtype=np.int32)), "n": pa.array(chunk.counts[:n])}
        return table(n, cols | {"a_id": pa.array(pairs // ids_b), "b_id": pa.array(pairs % ids_b)})

    for batch in batches:
        for step in text_steps(batch, 1, STEP):
            coded = one.encode([t or "" for t in step.column(1).to_pylist()])
            flat_a, flat_b = b"".join(a for a, _ in coded), b"".join(b for _, b in coded)
            a, b = np.frombuffer(flat_a, ID), np.frombuffer(flat_b, ID)
            n_a, n_b = (np.array([len(c[i]) // size for c in coded], np.int64) for i in (0, 1))
            end_a, end_b = one.shared_ends(a, b)
            last = one.windows(a, b, end_a, end_b)
            stop_a, stop_b = end_a[last] + 1, end_b[last] + 1
            kinds_of, group = one.distinct(a, b, stop_a, stop_b)
            first = np.concatenate([[0], last + 1])
            from_a, from_b = np.concatenate([[0], stop_a]), np.concatenate([[0], stop_b])
            cuts = zip(*((size * v[kinds_of]).tolist() for v in (from_a[:-1], stop_a, from_b[:-1], stop_b)))
            keys = [(flat_a[i:j], flat_b[k:m]) for i, j, k, m in cuts]
            found = list(map(chunk.known.get, keys))
            fresh = [i for i, code in enumerate(found) if code is None]
            if fresh:
                new = kinds_of[fresh]
                texts = one.described(a, b, end_a, end_b, first[new], last[new] + 1, from_a[new], from_b[new])
                for i, text in zip(fresh, texts):
                    found[i] = chunk.learn(keys[i], text)
                chunk.n_links += int((last[new] + 1 - first[new]).sum())
            codes = np.array(found, np.int64)[group].tolist()
            # the windows of each document: up to the one that ends with its last token
            bounds = [0, *np.searchsorted(stop_a, np.cumsum(n_a), "right").tolist()]
            # a shared end links the two tokens before it; the links of each document likewise
            links = np.diff(np.concatenate([[0], np.searchsorted(end_a, np.cumsum(n_a), "left")]))
            doc = np.repeat(np.arange(len(coded)), links)
            pairs, times = np.unique(doc * all_pairs + a[end_a].astype(np.int64) * ids_b + b[end_b], return_counts=True)
            held = np.concatenate([[0], np.cumsum(np.bincount(pairs // all_pairs, minlength=len(coded)))])
            names = chunk.names(pairs % all_pairs, times)
            texts = chunk.texts
            shas = [
                hashlib.sha256(";".join([texts[c] for c in codes[i:j]]).encode()).hexdigest() if j > i else ""
                for i, j in zip(bounds, bounds[1:])
            ]
            cols = {"chunk": pa.array(np.full(len(coded), chunk.number)), "doc_id": step.column(0), "n_a": pa.array(n_a), "n_b": pa.array(n_b)}
            # no token is empty, so a group ends with exactly one link
            cols |= {"n_groups": pa.array(links), "n_links": pa.array(links), "groups_sha256": pa.array(shas, pa.string())}
            yield table(len(coded), cols | {"names": lists(held, names), "times": lists(held, times)})
            chunk.named += len(pairs)
            if chunk.full():
                yield close()
                chunk = _Chunk(chunk.number + 1)
    if chunk.pairs:
        yield close()


def _link_rows(chunks: DataFrame) -> DataFrame:
    return chunks.where("name is not null").select("chunk", "name", "n", "a_id", "b_id")


def link_counts(chunks: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best): how often each pair is linked, and whether no other A id is linked more often to that B id."""
    counts = _link_rows(chunks).groupBy("a_id", "b_id").agg(F.sum("n").alias("links"))
    # a B id has at most as many rows as A has ids
    most = F.max("links").over(Window.partitionBy("b_id"))
    return counts.select("a_id", "b_id", "links", (F.col("links") == most).alias("best"))


def statistics(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, against counts over all documents.

    Texts that are null or empty, or whose bytes do not come back, have
    zeros and ''. Every row is a document, equal ids and repeated rows
    included; an empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = persisted(rows.mapInArrow(lambda it: _chunks(it, path_a, path_b), _CHUNKS), "windows")
    pairs = persisted(link_counts(chunks), "links")
    # the two sides of the cogroup come from one table: the key gets a name of its own
    links = _link_rows(chunks).select(F.col("chunk").alias("of_chunk"), "name", "a_id", "b_id")
    # a pair is held once by a chunk; broadcast, the pairs of a chunk stay in the task that read them, one after the other
    met = links.join(broadcast_if_small(pairs, BROADCAST_BYTES), ["a_id", "b_id"])
    sums = met.select("of_chunk", "name", "links", F.col("best").cast("long").alias("best")).mapInArrow(_packed, _SUMS)
    whole = chunks.where("name is null").drop("name", "n", "a_id", "b_id")
    return whole.groupBy("chunk").cogroup(sums.groupBy("of_chunk")).applyInArrow(
        _summed,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )


_SUMS = "of_chunk long, names array<int>, bests array<long>, counts array<long>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of a name, a row of arrays for each chunk of a batch; a name may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, name, links, best = (batch.column(c).to_numpy() for c in ("of_chunk", "name", "links", "best"))
        order = np.argsort(chunk, kind="stable")
        chunk, name, links, best = (v[order] for v in (chunk, name, links, best))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(chunk) != 0) | (np.diff(name) != 0)]))
        chunk, name, links, best = chunk[first], name[first], np.add.reduceat(links, first), np.add.reduceat(best, first)
        start = np.flatnonzero(np.concatenate([[True], np.diff(chunk) != 0]))
        bounds = pa.array(np.append(start, len(chunk)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (name, best, links)]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[start]), *lists], names=["of_chunk", "names", "bests", "counts"])


def _summed(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Sums of a chunk's names to its documents; both sides are bounded by what makes a chunk."""
    name, own_best, own_total = (sums[c].combine_chunks().flatten().to_numpy() for c in ("names", "bests", "counts"))
    n = int(name.max()) + 1 if len(name) else 0
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(best, name, own_best)
    np.add.at(total, name, own_total)
    names, times = (docs[c].combine_chunks() for c in ("names", "times"))
    lengths = np.diff(names.offsets.to_numpy()) if len(docs) else np.zeros(0, np.int64)
    flat, often = names.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(lengths)])

    def per_doc(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values[flat] * often)])
        return sums[upto[1:]] - sums[upto[:-1]]

    cols = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*cols, pa.array(per_doc(best)), pa.array(per_doc(total)), docs["groups_sha256"]],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
