"""Prefix trie of conversations: a node for every distinct sequence of first turns.

A prefix is named by a chained 128-bit digest. Written one after the other,
the digests of a conversation are its path; sorted paths put every subtree in
one run of rows. The rows are dealt over shards in that order, so a first
turn, or a whole conversation, that a third of all rows share still spreads.

A shard enumerates its distinct digests and gives each a slot by a minimal
perfect hash, verified against the digest stored there. Counts are scattered
into flat arrays by slot and accumulated through an array of parent slots
from the deepest nodes up. All nodes but those on the path of the shard's
first and last conversation lie wholly in the shard. Those few are added up
over the shards, and the same accumulation runs once over them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import mix64
from panelwright.semantics import broadcast_if_small, persisted

#: Bytes of a prefix digest.
WIDTH = 16
DIGEST = np.dtype([("hi", "<u8"), ("lo", "<u8")])
ROOT = bytes(WIDTH)

#: Turns of a shard; bounds the arrays of a task.
SHARD_TURNS = 2_000_000

#: Conversations that share the first turns of their first one, and the largest number of turns they take from it.
FAMILY, BORROW = 5, 9


def borrowed(conv_id: int) -> int:
    """How many first turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % BORROW


def extend(parent: bytes, role: str, text: str) -> bytes:
    """Digest of a prefix and one more turn."""
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(parent + len(r).to_bytes(8, "little") + r + t, digest_size=WIDTH).digest()


# ---- minimal perfect hash ------------------------------------------------


class Slots:
    """A slot from 0 to n - 1 for each of n distinct digests.

    Level by level, keys are hashed to twice as many cells as there are keys
    left; a key alone in its cell stays there, the others go on to the next
    level. A key's slot is the rank of its cell. The digest stored at a slot
    tells whether a looked-up digest is really the one that owns it.
    """

    def __init__(self, keys: np.ndarray):
        left, self._levels, base = keys, [], 0
        while len(left):
            m = 2 * len(left) + 1
            cells = self._cells(left, len(self._levels), m)
            alone = np.bincount(cells, minlength=m) == 1
            rank = base + np.cumsum(alone) - 1
            self._levels.append((m, alone, rank))
            base = int(rank[-1]) + 1
            left = left[~alone[cells]]
        self.owner = np.zeros(base, DIGEST)
        self.owner[self._find(keys)] = keys

    @staticmethod
    def _cells(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys["hi"] ^ mix64(keys["lo"] + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))) % np.uint64(m)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, alone, rank) in enumerate(self._levels):
            cells = self._cells(keys[todo], level, m)
            here = alone[cells]
            out[todo[here]] = rank[cells[here]]
            todo = todo[~here]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of digests; -1 for one that owns none."""
        out = self._find(keys)
        known = out >= 0
        known[known] = self.owner[out[known]] == keys[known]
        return np.where(known, out, -1)


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Adds every node's values to its parent's, deepest nodes first, so that each ends as its subtree's sum; parent -1: none."""
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1))
    for i, j in zip(edges, edges[1:]):
        level = order[i:j]
        level = level[parent[level] >= 0]
        for v in values:
            np.add.at(v, parent[level], v[level])


# ---- paths ---------------------------------------------------------------


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, its first conversation in front, and turn, to a path for each rebuilt conversation.

    Held at a time: the path of one conversation and the first turns of its family's first one.
    """
    ready: list[tuple] = []
    head: list[tuple[str, str, int]] = []
    family = conv = None
    turns: list[tuple[str, str, int]] = []
    path, sizes, tip, seen = [], [], ROOT, 0

    def add(role: str, text: str) -> None:
        nonlocal tip
        tip = extend(tip, role, text)
        path.append(tip)
        sizes.append(len(text.encode()))

    def flush() -> pa.RecordBatch:
        c, p, s = zip(*ready) if ready else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()), pa.array(p, pa.binary()), pa.array(s, pa.list_(pa.int64()))], names=["conv_id", "path", "sizes"]
        )

    for b in batches:
        for fam, cid, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if cid != conv:
                if conv is not None:
                    ready.append((conv, b"".join(path), sizes))
                if fam != family:
                    family, head = fam, []
                conv, path, sizes, tip, seen = cid, [], [], ROOT, 0
                skip = borrowed(cid)
                first = cid == fam
                if not first:
                    for r, t in head[:skip]:
                        add(r, t)
            if first and len(head) < BORROW:
                head.append((role, text))
            # the first of a family takes its first turns from itself
            if first or seen >= skip:
                add(role, text)
            seen += 1
        if sum(len(r[1]) for r in ready) > 8_000_000:
            yield flush()
            ready = []
    if conv is not None:
        ready.append((conv, b"".join(path), sizes))
    yield flush()


def paths(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, path, sizes) of each rebuilt conversation: digests of its prefixes in one value, UTF-8 bytes of its texts.

    Turns are ordered by number, null first, then role and text. A null role
    or text is empty; rows without a conversation id take no part. The five
    conversations of a family meet in one shuffle; nothing is joined.
    """
    c = F.col(conv_col).cast("long")
    rows = conversations.where(c.isNotNull()).select(
        (c - c % FAMILY).alias("family"),
        c.alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["family", F.desc(F.col("conv_id") == F.col("family")), "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    placed = rows.repartition("family").sortWithinPartitions(*order).select("family", "conv_id", "role", "text")
    return placed.mapInArrow(_paths, "conv_id long, path binary, sizes array<long>")


# ---- shards --------------------------------------------------------------

_NODES = (
    "digest binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, open boolean, first_end long, ends string, parent_conv_id long"
)
_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digests(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, DIGEST)


def _packed(keys: np.ndarray) -> pa.Array:
    return pa.array([k.tobytes() for k in keys], pa.binary())


def _shard(convs: list[int], keys: list[bytes], sizes: list[list[int]]) -> pa.RecordBatch:
    """Nodes of a run of sorted paths. ``open`` nodes may go on in other shards and hold what this one knows of them."""
    lengths = np.array([len(k) // WIDTH for k in keys], np.int64)
    member = np.repeat(np.arange(len(convs)), lengths + 1)
    start = np.cumsum(lengths + 1) - (lengths + 1)
    depth = np.arange(len(member)) - start[member]
    flat = np.zeros(len(member), DIGEST)
    flat[depth > 0] = _digests(b"".join(keys))
    bytes_of = np.zeros(len(member), np.int64)
    bytes_of[depth > 0] = np.array([s for row in sizes for s in row], np.int64)

    distinct, first = np.unique(flat, return_index=True)
    table = Slots(distinct)
    n = len(distinct)
    slot = table.of(flat)
    at = np.empty(n, np.int64)
    at[table.of(distinct)] = first  # a row of each node
    level, size = depth[at], bytes_of[at]
    parent = np.where(level > 0, slot[np.maximum(at - 1, 0)], -1)
    ids = np.array(convs, np.int64)
    n_convs = np.bincount(slot, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, ids[member])

    border = np.zeros(n, bool)
    for row in (0, len(convs) - 1):
        border[slot[start[row] : start[row] + lengths[row] + 1]] = True
    whole_child = (parent >= 0) & ~border
    children = np.bincount(parent[whole_child], minlength=n)
    leaves = ((children == 0) & ~border).astype(np.int64)
    saved = np.where(border, 0, (n_convs - 1) * size)
    accumulate(parent, level, leaves, saved)
    # an open node is to hold what its whole children add, not what other open nodes hold
    held = [v.copy() for v in (leaves, saved)]
    deeper = np.flatnonzero(border & (parent >= 0))
    for v, total in zip(held, (leaves, saved)):
        np.subtract.at(v, parent[deeper], total[deeper])

    # rows are in path order and then by id: the members that end in a node stand together
    last = slot[start + lengths]
    cut = np.flatnonzero(np.diff(last, prepend=-1))
    text: dict[int, str] = {int(last[i]): ",".join(map(str, convs[i:j])) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(convs)])}
    first_end = {int(last[i]): convs[i] for i in cut.tolist()}
    parents = np.where(parent >= 0, least[parent], 0)
    known = (parent >= 0) & ~border[parent]
    is_open = border.tolist()
    cols = [
        _packed(table.owner),
        pa.array([None if p < 0 else table.owner[p].tobytes() for p in parent.tolist()], pa.binary()),
        level, least, n_convs, children,
        np.where(border, held[0], leaves), np.where(border, held[1], saved),
        [None if o else hashlib.sha256(text[s].encode()).hexdigest() if s in text else _EMPTY for s, o in enumerate(is_open)],
        border,
        [first_end.get(s) if o else None for s, o in enumerate(is_open)],
        [text.get(s) if o else None for s, o in enumerate(is_open)],
        pa.array(parents, pa.int64(), mask=~known),
    ]
    sized = pa.array(size, pa.int64())
    names = [f.split()[0] for f in _NODES.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, _KINDS)]
    return pa.RecordBatch.from_arrays([*arrays, sized], names=[*names, "size"])


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, path, sizes) rows in runs of about ``limit`` turns; a run is held at a time."""
    convs, keys, sizes, turns = [], [], [], 0
    for b in batches:
        for c, k, s in zip(*(col.to_pylist() for col in b.columns)):
            if convs and turns + len(s) > limit:
                yield _shard(convs, keys, sizes)
                convs, keys, sizes, turns = [], [], [], 0
            convs.append(c)
            keys.append(k)
            sizes.append(s)
            turns += len(s) + 1
    if convs:
        yield _shard(convs, keys, sizes)


def _open_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the open nodes, which form a trie of their own below the root; one task."""
    names = ["digest", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size"]
    held = [b for b in batches if b.num_rows]
    if held:
        out = dict(zip(names, pa.Table.from_batches(held).columns))
        keys = _digests(b"".join(out["digest"].to_pylist()))
        table = Slots(keys)
        slot = table.of(keys)
        place = np.empty(len(keys), np.int64)  # the row of each slot
        place[slot] = np.arange(len(keys))
        depth, least, n_convs, children, leaves, saved, size = (out[c].to_numpy()[place] for c in names[2:])
        above = out["parent"].to_pylist()
        up = np.array([-1 if p is None else 0 for p in above], np.int64)
        up[up == 0] = table.of(_digests(b"".join(p for p in above if p is not None)))
        parent = up[place]
        children = children + np.bincount(parent[parent >= 0], minlength=len(keys))
        leaves = leaves + (children == 0)
        saved = saved + (n_convs - 1) * size
        accumulate(parent, depth, leaves, saved)
        above_id = pa.array(np.where(parent >= 0, least[parent], 0), pa.int64(), mask=parent < 0)
        made = [_packed(table.owner), depth, least, n_convs, children, leaves, saved, above_id]
    else:
        made = [[]] * 8
    kinds = [pa.binary(), *[pa.int64()] * 7]
    cols = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(made, kinds)]
    yield pa.RecordBatch.from_arrays(cols, names=["digest", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id"])


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists sorted by node and first id to one hash per node, piece by piece."""
    now, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        d, h = zip(*done) if done else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(h, pa.string())], names=["digest", "ends_sha256"])

    for b in batches:
        for digest, piece in zip(*(c.to_pylist() for c in b.columns)):
            if digest != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if now is not None:
        done.append((now, state.hexdigest()))
    yield flush()


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, **columns: str) -> DataFrame:
    """Nodes of the prefix trie over the rebuilt conversations, one row each.

    Columns: digest, conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. A conversation that is
    left without turns is a member of the root alone. Repeated rows are turns
    of their own; an empty table has no node; further columns are not read.

    Open nodes are at most twice the depth for each shard; their sums are added
    up map-side and by digest, and one task accumulates over them. The list
    behind ``ends_sha256`` of an open node is hashed piece after piece, as the
    hash has to see it in order; pieces are made in the shards.
    """
    lines = persisted(paths(conversations, **columns), "paths")
    placed = lines.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = persisted(placed.mapInArrow(lambda it: _shards(it, shard_turns), _NODES + ", size long"), "nodes")

    parts = nodes.where("open")
    added = parts.groupBy("digest").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.any_value("size").alias("size"),
    )
    fields = "digest binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"
    summed = persisted(added.coalesce(1).mapInArrow(_open_sums, fields), "open")
    pieces = parts.where("ends is not null").select("digest", "first_end", "ends").repartition("digest").sortWithinPartitions("digest", "first_end")
    hashes = pieces.select("digest", "ends").mapInArrow(_end_hashes, "digest binary, ends_sha256 string")

    out = ["digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = summed.select(F.col("digest").alias("parent"), F.col("conv_id").alias("__above"))
    whole = nodes.where("not open").join(broadcast_if_small(above), "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "__above")
    )
    opened = summed.join(hashes, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return whole.select(*out).unionByName(opened.select(*out))
