"""Recall against brute force, the pigeonhole guarantee, odd rows."""

import numpy as np
import pyarrow.parquet as pq

from panelwright.llm import neighbours as nn
from panelwright.llm.queries import QUERIES


def exact(ids, vecs, q, k=10):
    d = np.sqrt(((vecs - vecs[ids == q][0]) ** 2).sum(1))
    rows = sorted((x, i) for x, i in zip(d, ids) if i != q)[:k]
    return [(i, x) for x, i in rows]


def test_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    ids, vecs = np.array(t["vec_id"]), np.array(t["embedding"], np.float64)
    got = {}
    for r in QUERIES["op8_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q: exact(ids, vecs, q) for q in ids[ids % 100 == 0]}
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        for _, v, s in rows:
            assert s == np.sqrt(((vecs[ids == v][0] - vecs[ids == q][0]) ** 2).sum())
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    for i in range(300):  # near codes
        codes[i] = codes[3]
        for b in rng.choice(64, rng.integers(0, 20), replace=False):
            codes[i, b // 16] ^= 1 << (b % 16)
    index = nn.Index(codes)
    for radius in (0, 3, 11):
        flips = nn._flips(radius // 4)
        for q in codes[:20]:
            assert list(index.within(q, radius, flips)) == list(np.flatnonzero(nn._hamming(codes, q) <= radius))


def test_blocks_ties_and_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(1, 40)] + [(100, v), (101, v), (200, v), (200, v)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [1.0, float("nan"), 2.0]), (305, [1.0, float("inf"), 0.0]), (306, [1.0]), (None, v)]
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<double>, query_id string")
    got = {}
    for r in nn.nearest(df, df.where("vec_id in (100, 200, 300, 302)"), block=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {100, 200} and all(len(x) == 10 for x in got.values())
    assert got[100][:2] == [(101, 0.0), (200, 0.0)] and got[200][:2] == [(100, 0.0), (101, 0.0)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nn.nearest(few, few).count() == 6
    assert nn.nearest(few.limit(0), few).count() == 0 and nn.nearest(few, few.limit(0)).count() == 0
