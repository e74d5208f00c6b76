"""Near-duplicate documents by one-permutation MinHash.

A document is its set of distinct word shingles. One hash of each shingle
chooses a bin and a value; the least value of every bin is the signature.
Empty bins borrow from a filled bin that a hash of the bin number picks
(optimal densification), alike in every document. Runs of bins make bands;
documents that share a band meet in a bucket.

A bucket proposes a star, not all pairs: each member with one pivot, and links
are confirmed on the full sets. If the other members then lie in several
components, two of them may still be linked. Let such a pair have sizes n and
m, and share c and d shingles with the pivot. It needs percent * (n + m) /
(100 + percent) common shingles, of which min(c, d) at most lie in the pivot.
What both have beyond the pivot is bounded by bitmaps: a bit that only one of
them sets stands for a shingle that the other lacks. Only pairs that this
cannot rule out leave the join, and they are confirmed like the others. So
each pair that shares a band is compared, lies in one component already, or is
ruled out by counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import U64, Words, hashed, memory_returned, mix64
from panelwright.llm.components import components
from panelwright.semantics import persisted

SHINGLE = 5
#: Bands times rows are the bins. A pair at similarity .75 shares a band with probability 1 - (1 - .75**4)**32.
BANDS, ROWS = 32, 4
#: Words of 64 bits in a bitmap of what a set has beyond its pivot.
BITMAP = 16


def shingles(words: Words, d: int, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of text ``d``: the whole sequence if it has fewer than ``k`` words."""
    h = words.hash[words.first[d] : words.first[d + 1]]
    if not len(h):
        return h
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - width + 1, U64(width))
        for i in range(width):
            total = mix64(total * U64(0x9FB21C651E98DF25) + h[i : i + len(total)])
    total.sort()
    keep = np.ones(len(total), bool)
    keep[1:] = total[1:] != total[:-1]
    return total[keep]


def _donors(bins: int, tries: int) -> np.ndarray:
    """Bin number and attempt to the bin it borrows from."""
    at = np.arange(bins * tries, dtype=U64).reshape(bins, tries)
    return (mix64(at + U64(0x51ED270B)) % U64(bins)).astype(np.int64)


def signature(own: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Least hash of each bin (bins: a power of two) of a non-empty sorted set, empty bins borrowed."""
    bins = len(donors)
    shift = U64(64 - bins.bit_length() + 1)
    at = np.searchsorted(own, np.arange(bins, dtype=U64) << shift)
    safe = np.minimum(at, len(own) - 1)
    filled = (at < len(own)) & ((own[safe] >> shift) == np.arange(bins, dtype=U64))
    source = np.arange(bins)
    open_bins = np.flatnonzero(~filled)
    for lo in range(0, donors.shape[1], 64):
        if not len(open_bins):
            break
        tried = donors[open_bins, lo : lo + 64]
        hit = filled[tried]
        got = hit.any(axis=1)
        source[open_bins[got]] = tried[got, hit[got].argmax(axis=1)]
        open_bins = open_bins[~got]
    if len(open_bins):  # beyond all tries: the next filled bin around the ring
        ring = np.flatnonzero(filled)
        source[open_bins] = ring[np.searchsorted(ring, open_bins) % len(ring)]
    return own[safe[source]]


def _sketch(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    bins = bands * rows
    donors = _donors(bins, 1024)
    salt = mix64(np.arange(1, bands + 1, dtype=U64))
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at, to, words in hashed(texts):
            size, one, two, keys = [], [], [], []
            for d in range(to - at):
                own = shingles(words, d, k)
                size.append(len(own))
                if not len(own):
                    one.append(None), two.append(None), keys.append(None)
                    continue
                with np.errstate(over="ignore"):
                    one.append(int(mix64(own).sum(dtype=U64).view(np.int64)))
                    two.append(int(mix64(own ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64).view(np.int64)))
                    sig = signature(own, donors).reshape(bands, rows)
                    key = salt.copy()
                    for r in range(rows):
                        key = mix64(key * U64(0x9FB21C651E98DF25) + sig[:, r])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, to - at),
                    pa.array(size, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n", "d1", "d2", "bands"],
            )
    memory_returned()


_SEEN = "a long, b long, same boolean, n long, c long, " + ", ".join(f"w{i} long" for i in range(BITMAP))


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of pivot ``a`` and member ``b`` with both texts, sorted by ``a``.

    Gives whether their full sets are similar, the size of b's set, what it
    shares with the pivot, and the bitmap of what it has beyond the pivot.
    """
    last, held = None, None
    for batch in batches:
        a, b, ta, tb = (batch.column(i) for i in range(4))
        out, maps = [], np.zeros((batch.num_rows, BITMAP * 64), bool)
        for at, to, words in hashed(tb):
            for d in range(to - at):
                i = at + d
                if (node := a[i].as_py()) != last:
                    last, held = node, shingles(next(hashed(ta.slice(i, 1)))[2], 0, k)
                own = shingles(words, d, k)
                place = np.minimum(np.searchsorted(held, own), len(held) - 1)
                shared = held[place] == own
                n, c = len(own), int(shared.sum())
                maps[i, own[~shared] % U64(BITMAP * 64)] = True
                out.append((node, b[i].as_py(), 100 * c >= percent * (len(held) + n - c), n, c))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        cols = list(zip(*out)) if out else [[]] * len(kinds)
        bits = np.packbits(maps, axis=1).view(np.int64)
        arrays = [pa.array(x, t) for x, t in zip(cols, kinds)] + [pa.array(bits[:, i]) for i in range(BITMAP)]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "same", "n", "c", *(f"w{i}" for i in range(BITMAP))])
    memory_returned()


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) with what ``_compare`` says. Texts travel, being smaller than their sets; a hot pivot is split by the join."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").sortWithinPartitions("a")
    return both.mapInArrow(lambda it: _compare(it, k, percent), _SEEN)


def sketches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """id, set size ``n``, 128-bit digest of the set (d1, d2) and band keys of each document; null if empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _sketch(it, k, bands, rows), "id long, n long, d1 long, d2 long, bands array<long>"
    )


def _open_pairs(stars: DataFrame, seen: DataFrame, labels: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a bucket, not its pivot, that lie in different components and that counting does not rule out.

    ``stars`` has (key, a, b), ``bands`` (node, bands). The condition is part of the join, so what leaves it is what must be
    compared. A pair that shares several bands is looked at in the one with the smallest key; if one of the two is the pivot
    there, they have been compared.
    """
    bits = [f"w{i}" for i in range(BITMAP)]
    own = stars.join(seen.drop("same"), ["a", "b"]).drop("a").withColumnRenamed("b", "node")
    own = own.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    several = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    own = persisted(own.join(several.select("key"), "key").join(bands, "node"), "open")
    other = own.select("key", *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "c", "comp", "bands", *bits)))
    alone = lambda x, y: sum((F.bit_count(F.col(f"{w}{x}").bitwiseAND(F.bitwise_not(f"{w}{y}"))) for w in bits), F.lit(0))
    beyond = F.least(F.col("n") - F.col("c") - alone("", "_y"), F.col("n_y") - F.col("c_y") - alone("_y", ""))
    enough = (F.least("c", "c_y") + beyond) * (100 + percent) >= percent * (F.col("n") + F.col("n_y"))
    near = F.least("n", "n_y") * 100 >= F.greatest("n", "n_y") * percent
    here = F.array_min(F.array_intersect("bands", "bands_y")) == F.col("key")
    pairs = own.join(other, "key").where(
        (F.col("node") < F.col("node_y")) & (F.col("comp") != F.col("comp_y")) & near & enough & here
    )
    return pairs.select(F.col("node").alias("a"), F.col("node_y").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if 100 * |A and B| >= percent * |A or B| on their
    full shingle sets; ``component_id`` is the smallest id reachable over links
    and ``kept`` marks it. Null or blank texts have an empty set and are alone.
    Rows with equal ids are one document and carry equal results. A row without
    an id cannot name a component: it takes no part, its component is null and
    it is kept. An empty table gives an empty result. Further columns are not
    read.
    """
    drawn = persisted(sketches(docs, id_col, text_col, k, bands, rows), "sketches")
    alive = drawn.where("id is not null and n > 0")
    sets = persisted(
        alive.groupBy("d1", "d2").agg(
            F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ),
        "sets",
    )
    spread = sets.select("node", "n", F.explode("bands").alias("key"))
    crowd = spread.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    crowded = persisted(spread.join(crowd, "key"), "buckets")
    degree = crowded.groupBy("node").agg(F.sum("cnt").alias("deg"))
    members = persisted(crowded.drop("cnt").join(degree, "node"), "members")
    texts = persisted(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(degree.select(F.col("node").alias("id")), "id", "left_semi")
        .groupBy("id")
        .agg(F.min("text").alias("text")),
        "texts",
    )
    about = members.groupBy("key").agg(F.max(F.struct("deg", -F.col("node"))).alias("top"))
    stars = members.join(about.select("key", (-F.col("top.col2")).alias("a")), "key").where("node != a")
    stars = persisted(stars.select("key", "a", F.col("node").alias("b")), "stars")
    seen = persisted(_compared(stars.select("a", "b").distinct(), texts, k, percent), "seen")
    links = seen.where("same").select("a", "b")
    labels = persisted(components(links), "labels")
    rest = persisted(_compared(_open_pairs(stars, seen, labels, sets.select("node", "bands"), percent), texts, k, percent), "rest").where("same").select("a", "b")
    if not rest.isEmpty():
        labels = persisted(components(links.union(rest)), "labels")
    whole = sets.select("d1", "d2", "node").join(labels, "node", "left")
    whole = whole.select("d1", "d2", F.coalesce("label", "node").alias("component"))
    own = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return (
        drawn.select("id", "n", "d1", "d2")
        .join(whole, ["d1", "d2"], "left")
        .select("id", "n", F.when(F.col("id").isNotNull(), own).alias("component_id"))
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
