"""Token ids in files of independent zstandard frames, readable a document at a time.

A file holds the ids of whole documents, in the order of their ids, as
little-endian unsigned 32-bit integers. Every document is a frame of its own
(several, above ``FRAME_IDS`` ids); then come two skippable frames::

    frame of document 1 | frame of document 2 | ... | documents | seek table

The seek table is that of the published seekable format: for each frame its
compressed size, its size and the low half of the XXH64 of its content, then
the number of frames, a descriptor byte and a mark. Any zstandard reader
decodes such a file as one stream. ``documents`` lists the document ids and
how many frames each has. A reader takes the tables at the end, seeks to the
frames it wants, and checks each against its checksum.

Files carry names that no other attempt of a task uses. What belongs to the
data set is what the manifest lists; Spark commits it when all tasks are
done, so a lost executor leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.llm.tokens import ID, ByteLevel, loaded, text_steps
from panelwright.semantics import persisted, scratch_dir

# Marks of skippable frames and of the seek table, flag for checksums.
DOCUMENTS_MARK, SEEK_MARK, FOOTER_MARK, WITH_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: Ids in a frame at most; a longer document has several frames.
FRAME_IDS = 1 << 20
#: Compressed bytes after which a file ends at the next document.
FILE_BYTES = 256_000_000
LEVEL = 1
#: Tasks that files are dealt over at most when all are read.
READ_TASKS = 10_000

_HEAD, _ENTRY, _FOOTER = struct.Struct("<II"), np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")


class Damaged(ValueError):
    """A file that is not whole."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """One file. ``add`` takes a document's packed ids; ``close`` writes the tables."""

    def __init__(self, path: str, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        fs, where = _open(path)
        fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
        self._out = fs.open_output_stream(where, compression=None)
        self._zip = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self._step = frame_ids * ID.itemsize
        self._entries: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, bool, int]] = []
        self.bytes = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frames = 0
        for at in range(0, max(len(ids), 1), self._step):
            data = ids[at : at + self._step]
            packed = self._zip.compress(data)
            self._out.write(packed)
            self._entries.append((len(packed), len(data), checksum(data)))
            self.bytes += len(packed)
            frames += 1
        self.ids += len(ids) // ID.itemsize
        self._docs.append((doc_id or 0, doc_id is None, frames))

    def close(self) -> None:
        ids, nulls, frames = (np.array(c, t) for c, t in zip(zip(*self._docs), ("<i8", "u1", "<u4")))
        body = self._zip.compress(struct.pack("<Q", len(ids)) + ids.tobytes() + nulls.tobytes() + frames.tobytes())
        self._out.write(_HEAD.pack(DOCUMENTS_MARK, len(body)) + body)
        # the seek table has an entry for every frame before it, so that the sizes add up to its place
        entries = np.array([*self._entries, (_HEAD.size + len(body), 0, checksum(b""))], _ENTRY)
        table = entries.tobytes() + _FOOTER.pack(len(entries), WITH_CHECKSUM, FOOTER_MARK)
        self._out.write(_HEAD.pack(SEEK_MARK, len(table)) + table)
        self._out.close()

    @property
    def n_docs(self) -> int:
        return len(self._docs)


class Reader:
    """One file. The tables are read when it is opened, frames when they are asked for."""

    def __init__(self, path: str):
        fs, where = _open(path)
        self._in = fs.open_input_file(where)
        self._unzip = zstandard.ZstdDecompressor()
        end = self._in.size()
        n, flags, mark = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if mark != FOOTER_MARK or not flags & WITH_CHECKSUM:
            raise Damaged(f"{path} has no seek table")
        start = end - _FOOTER.size - n * _ENTRY.itemsize
        if _HEAD.unpack(self._read(start - _HEAD.size, _HEAD.size)) != (SEEK_MARK, n * _ENTRY.itemsize + _FOOTER.size):
            raise Damaged(f"{path} has a wrong seek table")
        self._entries = np.frombuffer(self._read(start, n * _ENTRY.itemsize), _ENTRY)
        self._at = np.concatenate([[0], np.cumsum(self._entries["packed"].astype(np.int64))])
        body = self._read(int(self._at[-2]) + _HEAD.size, int(self._entries["packed"][-1]) - _HEAD.size)
        body = self._unzip.decompress(body)
        (docs,) = struct.unpack_from("<Q", body)
        self.doc_ids = np.frombuffer(body, "<i8", docs, 8)
        self.nulls = np.frombuffer(body, "u1", docs, 8 + 8 * docs).astype(bool)
        self._frames = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u4", docs, 8 + 9 * docs).astype(np.int64))])
        sizes = np.concatenate([[0], np.cumsum(self._entries["size"].astype(np.int64))]) // ID.itemsize
        #: Ids of the file before each document, and of all.
        self.starts = sizes[self._frames]

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def frames(self, i: int) -> Iterator[bytes]:
        """The checked frames of document number ``i``; no other frame is decompressed."""
        for f in range(self._frames[i], self._frames[i + 1]):
            packed, size, check = (int(v) for v in self._entries[f])
            data = self._unzip.decompress(self._read(int(self._at[f]), packed), max_output_size=size) if size else b""
            if len(data) != size or checksum(data) != check:
                raise Damaged(f"frame {f} differs from its checksum")
            yield data

    def close(self) -> None:
        self._in.close()


# ---- writing with Spark ---------------------------------------------------


MANIFEST = "path string, first_id long, first_mark long, last_id long, n_docs long, n_ids long, n_bytes long"


def _write_part(batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, end_id: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, mark, text) rows to files and their manifest rows; a step of texts is held at a time."""
    encoder, end = loaded(ByteLevel, tokenizer), np.array([end_id], ID).tobytes()
    out, path, first, last, done = None, "", (None, 0), None, []

    def close():
        out.close()
        done.append((path, *first, last, out.n_docs, out.ids, out.bytes))

    for batch in batches:
        for step in text_steps(batch, 2, 10_000_000):
            ids, marks, texts = (c.to_pylist() for c in step.columns)
            for doc_id, mark, packed in zip(ids, marks, encoder.encode([t or "" for t in texts])):
                if out is None:
                    path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    out, first = Writer(path), (doc_id, mark)
                out.add(doc_id, packed + end)
                last = doc_id
                if out.bytes >= file_bytes:
                    close()
                    out = None
    if out is not None:
        close()
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6]
    cols = list(zip(*done)) if done else [[]] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def write(
    docs: DataFrame,
    tokenizer: str,
    root: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the ids of all texts below ``root``; returns the manifest, one row per file, with ``file_start`` (ids in earlier files).

    Texts move once, to the range of their document id; they are encoded
    where they are written, so no token crosses the network. Rows of one id
    follow a hash of their text: many rows with one id (or none, which come
    first) still spread over files. A null text is empty; every document gets
    ``end_id`` at its end. Equal rows are separate documents; no rows, no
    files. Further columns are not read. ``root`` must be a folder that all
    executors reach; by default it lies in the session's shared scratch space.
    """
    root = root or scratch_dir(docs.sparkSession, "tokens")
    if root.startswith("/"):
        # a path without a scheme lies where Spark would put it
        default = docs.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = root if default.startswith("file:") else default.rstrip("/") + root
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("doc_id"), "mark"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = persisted(placed.mapInArrow(lambda it: _write_part(it, root, tokenizer, end_id, file_bytes), MANIFEST), "manifest")
    # one row per file: a window over all of them is small
    before = Window.orderBy(F.asc_nulls_first("first_id"), "first_mark", F.asc_nulls_first("last_id"), "path").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


# ---- reading with Spark ---------------------------------------------------


def _documents(path: str, file_start: int, chosen: Sequence[int] | None = None) -> Iterator[tuple]:
    """(doc_id, start, n_tokens, crc, frames) of a file's documents, all or those with the numbers ``chosen``."""
    reader = Reader(path)
    try:
        for i in range(len(reader.doc_ids)) if chosen is None else chosen:
            doc_id = None if reader.nulls[i] else int(reader.doc_ids[i])
            n, crc, frames = 0, 0, []
            for data in reader.frames(i):
                n, crc = n + len(data) // ID.itemsize, zlib.crc32(data, crc)
                if chosen is not None:
                    frames.append(data)
            yield doc_id, file_start + int(reader.starts[i]), n, crc, b"".join(frames)
    finally:
        reader.close()


def _batches(rows: Iterator[tuple], fields: Sequence[tuple[str, pa.DataType]], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, fields)
            held = []
    yield _batch(held, fields)


def _batch(rows: list[tuple], fields: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def summaries(manifest: DataFrame) -> DataFrame:
    """Every document of the files with its place, length and CRC-32, from its frames; a frame is held at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((p, s) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        return _batches((d[:4] for f in files for d in _documents(*f)), _FIELDS)

    # a file is read by one task; a stated number of tasks is not merged into fewer
    dealt = manifest.select("path", "file_start").repartition(min(max(manifest.count(), 1), READ_TASKS), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of the documents asked for; other documents of their files are not decompressed.

    Ids that no file holds give no row, a repeated id gives the document once,
    null asks for nothing. The first and last id of every file say where an
    id may be; they are joined as ranges of whole numbers, one row per file.
    """
    files = manifest.where(F.col("last_id").isNotNull()).select("path", "file_start", F.coalesce("first_id", F.lit(-(2**63))).alias("lo"), F.col("last_id").alias("hi"))
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # the bounds of the files in order: two numbers per file
    bounds = sorted((r.lo, r.hi, r.path, r.file_start) for r in files.collect())
    lo, hi = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
    upto = np.maximum.accumulate(hi) if len(hi) else hi

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(0).to_numpy(zero_copy_only=False)
            first, stop = np.searchsorted(upto, asked, "left"), np.searchsorted(lo, asked, "right")
            yield _batch([(bounds[j][2], bounds[j][3], int(d)) for d, i, k in zip(asked, first, stop) for j in range(i, k)], [("path", pa.string()), ("file_start", pa.int64()), ("doc_id", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for path, start, asked in zip(*(c.to_pylist() for c in b.columns)):
                    reader = Reader(path)
                    here = np.flatnonzero(np.isin(reader.doc_ids, asked) & ~reader.nulls).tolist()
                    reader.close()
                    for doc_id, at, _, _, data in _documents(path, start, here):
                        yield doc_id, at, np.frombuffer(data, ID).astype(np.int64)

        return _batches(rows(), [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))], 100)

    placed = ids.mapInArrow(place, "path string, file_start long, doc_id long")
    asked = placed.groupBy("path", "file_start").agg(F.collect_list("doc_id").alias("asked"))
    return asked.mapInArrow(read, "doc_id long, start long, ids array<long>")
