"""Mixing against plain arithmetic, and odd rows."""

import duckdb
import pytest

from panelwright.llm import mixing
from panelwright.llm.queries import ORACLES, QUERIES
from tools.check import compare

from . import brute


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, room = {}, set(order), float(sum(sizes.values()))
    while free:
        share = sum(w[s] for s in free)
        over = {s for s in free if w[s] * room / share > most * sizes[s]}
        if not over:
            target |= {s: w[s] * room / share for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        room -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_sql_and_arithmetic_agree_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert compare(QUERIES["op3_mixing"](spark, sf), con, ORACLES["op3_mixing"]) is None
    docs = {i: (t, s) for i, t, s in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    sizes, taken = {}, {}
    for t, s in docs.values():
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = water(sizes)
    for r in QUERIES["op3_mixing"](spark, sf).collect():
        t, s = docs[r.doc_id]
        assert r.size == len(brute.words(t)) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        longest = max(len(brute.words(t)) for t, o in docs.values() if o == s)
        assert abs(taken[s] - want[s]) <= max(longest / 2 + 1, 0.01 * want[s])


def test_full_sources_pass_their_excess_on(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1000), ("b", 5), ("B", 3), (None, 2), ("é", 10), ("z", 0)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r.mix_target for r in mixing.counted(df).collect()}
    assert got == pytest.approx(water({s: n for s, n in [("a", 1000), ("b", 5), ("B", 3), (None, 2), ("é", 10), ("z", 0)]}))


def test_copies_are_emitted_as_counted(spark):
    rows = [(i, f"word{i} " * (i % 50), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.doc_id: r.mix_copies for r in mixing.counted(df).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert mixing.mixed(df).columns == df.columns


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (None, "a b", None, 2), (1, "", "x", 3), (2, "a b\vc", "x", 4), (2, "a b\vc", "x", 5), (3, "w " * 100_000, "y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int")
    out = mixing.counted(df).collect()
    assert sorted(r.mix_size for r in out) == [0, 0, 2, 2, 2, 100_000]
    assert len({r.mix_copies for r in out if r.doc_id == 2}) == 1
    assert all(r.mix_copies == 0 or r.mix_source_size > 0 for r in out)
    assert mixing.counted(df.limit(0)).count() == 0 and mixing.mixed(df.where("doc_id = 1")).count() == 0
