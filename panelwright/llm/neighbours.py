"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors are centred, projected on their principal directions and rotated so
that signs lose little (iterative quantisation, learnt on a bounded sample);
the signs are the code. A code is cut into substrings, each with an index of
its own. If two codes differ in at most r of their bits, then by the pigeonhole
principle some substring differs in at most r / substrings: probing all values
that near in every index finds each code within r. Those candidates are ranked
by distance on the original vectors.

Every row is indexed, in the task that reads it; query vectors visit all tasks
in bounded blocks, and a task returns its best rows of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelwright.semantics import persisted

#: Bits of a substring; its index has 2**PART entries.
PART = 16
#: Vectors of a query block.
QUERY_BLOCK = 4096
#: Rows one index is built over inside a task.
INDEX_ROWS = 50_000


@dataclass
class Codes:
    """Learnt code: ``sign((v - centre) @ directions)``; ``radius`` is the Hamming radius that is probed."""

    centre: np.ndarray
    directions: np.ndarray
    radius: int

    @property
    def parts(self) -> int:
        return -(-self.directions.shape[1] // PART)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, substrings) of uint16; missing bits are zero."""
        signs = ((vectors - self.centre) @ self.directions) > 0
        wide = np.zeros((len(vectors), self.parts * PART), bool)
        wide[:, : signs.shape[1]] = signs
        weights = (1 << np.arange(PART)).astype(np.uint32)
        return (wide.reshape(len(vectors), self.parts, PART) @ weights).astype(np.uint16)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def learn(sample: np.ndarray, bits: int = 64, recall: float = 0.97, k: int = 10, rounds: int = 30, seed: int = 3) -> Codes:
    """Codes from a sample (rows, dims). The radius covers ``recall`` of the ``k`` nearest pairs inside the sample,

    which lie farther apart than those of the whole table, so that the whole table does no worse.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    bits = min(bits, dims)
    if not len(sample):
        return Codes(np.zeros(dims), np.zeros((dims, bits)), 0)
    centre = sample.mean(0)
    x = sample - centre
    _, vectors = np.linalg.eigh(x.T @ x)
    main = vectors[:, ::-1][:, :bits]
    y = x @ main
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (u @ vt).T
    codes = Codes(centre, main @ turn, 0)
    probe = x[rng.permutation(len(x))[:300]]
    own = codes.of(sample)
    far = []
    for q, c in zip(probe, codes.of(probe + centre)):
        d = ((x - q) ** 2).sum(1)
        near = np.argsort(d, kind="stable")[1 : k + 1]
        far.append(_hamming(own[near], c))
    if far:
        codes.radius = int(np.quantile(np.concatenate(far), recall)) if sum(map(len, far)) else 0
    return codes


def _flips(radius: int) -> np.ndarray:
    """All substrings with at most ``radius`` bits set."""
    return np.array(
        [sum(1 << b for b in c) for n in range(min(radius, PART) + 1) for c in combinations(range(PART), n)], np.uint16
    )


class Index:
    """Rows grouped by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.begin = [], []
        for p in range(codes.shape[1]):
            self.order.append(np.argsort(codes[:, p], kind="stable"))
            self.begin.append(np.searchsorted(codes[:, p][self.order[-1]], np.arange((1 << PART) + 1)))

    def within(self, code: np.ndarray, radius: int, flips: np.ndarray) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``."""
        found = np.zeros(len(self.codes), bool)
        for p, value in enumerate(code):
            values = (value ^ flips).astype(np.int64)
            lo, hi = self.begin[p][values], self.begin[p][values + 1]
            some = hi > lo
            lo, n = lo[some], hi[some] - lo[some]
            if len(lo):
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found[self.order[p][at]] = True
        rows = np.flatnonzero(found)
        return rows[_hamming(self.codes[rows], code) <= radius]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a finite, non-zero vector without nulls."""
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _block(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r.id for r in rows], np.int64), np.array([r.vec for r in rows], np.float64)


def _search(codes: Codes, ids: np.ndarray, queries: np.ndarray, k: int, radius: int):
    flips = _flips(radius // codes.parts)
    wanted = codes.of(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def take(rows: np.ndarray, vecs: np.ndarray) -> None:
            index = Index(codes.of(vecs)) if radius < PART * codes.parts else None
            for i, q in enumerate(queries):
                near = index.within(wanted[i], radius, flips) if index else np.arange(len(rows))
                near = near[rows[near] != ids[i]]
                if not len(near):
                    continue
                d = np.sqrt(((vecs[near] - q) ** 2).sum(1))
                got = rows[near]
                if i in best:
                    d, got = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], got])
                top = np.lexsort((got, d))
                fresh = np.unique(got[top], return_index=True)[1]  # a repeated id counts once
                top = top[np.sort(fresh)][:k]
                best[i] = (d[top], got[top])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), _matrix(b.column(1))))
            n += b.num_rows
            if n >= INDEX_ROWS:
                take(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held, n = [], 0
        if n:
            take(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        for i, (d, got) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(got), ids[i])), pa.array(got), pa.array(d)], names=["query_id", "vec_id", "score"]
            )

    return run


def nearest(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
    bits: int = 64, sample_rows: int = 20_000, recall: float = 0.97, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` nearest to each row of ``queries``, but the query's own id.

    Euclidean distance in double precision, ties to the smaller id. The code is
    learnt on at most ``sample_rows`` vectors chosen by a hash of their ids.
    Rows with a null id, or a vector that is null, empty, zero or not finite
    throughout, take no part, nor do vectors of another length than the most
    frequent one. A query for which the index finds fewer than ``k`` rows is
    searched again over all rows. Ids should be unique; of rows that repeat an
    id the nearest counts. Empty in, empty out.
    """
    schema = "query_id long, vec_id long, score double"
    rows = usable(df, id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == lengths.n)
    asked = usable(queries, id_col, vec_col).where(F.size("vec") == lengths.n).groupBy("id").agg(F.min("vec").alias("vec"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    codes = learn(_block(sample)[1], bits, recall, k)

    def passes(of: DataFrame, radius: int) -> DataFrame | None:
        out, held = None, []

        def flush():
            nonlocal out, held
            part = rows.mapInArrow(_search(codes, *_block(held), k, radius), schema)
            out, held = part if out is None else out.union(part), []

        for r in of.toLocalIterator():
            held.append(r)
            if len(held) == block:
                flush()
        if held:
            flush()
        return out

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = passes(asked, codes.radius)
    if first is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    done = persisted(ranked(first), "nearest")
    full = done.groupBy("query_id").count().where(F.col("count") >= k)
    short = persisted(asked.join(full, asked["id"] == full["query_id"], "left_anti"), "short")
    second = passes(short, PART * codes.parts)
    if second is not None:
        done = done.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(ranked(second))
    return done
