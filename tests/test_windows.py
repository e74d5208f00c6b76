"""Panel windows: cutting of heavy entities, leaks, order, nulls."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import windows as W
from panelwright.operators.windows import Expanding, FillPrior, Lag, Panel, Rolling, add_prior

FEATS = [
    Rolling("x", 3, "r3"),
    Rolling("x", 10, "r10", min_count=3),
    Rolling("x", 5, "s5", agg="sum", default=0.0),
    Lag("x", "lag1"),
    Lag("x", "lag4", k=4, default=-1.0),
    FillPrior("x", "seen"),
    Expanding("x", "total"),
    Expanding("x", "mean", "avg"),
    Expanding("x", "n", "count", default=0),
    Expanding(None, "i", "rows"),
]


def frame(spark, seed=1, n=160):
    rnd = random.Random(seed)
    rows = [
        # entity 'a' holds most rows; periods differ widely in size
        ("a" if rnd.random() < 0.7 else rnd.choice("bc"), min(int(rnd.expovariate(0.3)), 9), i, rnd.choice([None, *range(8)]))
        for i in range(n)
    ]
    rows = [(e, p, i, None if x is None else float(x)) for e, p, i, x in rows]
    return spark.createDataFrame(rows, "e string, p int, id int, x double")


def result(df, cols=None):
    return sorted(tuple(r) for r in df.select("e", "p", "id", *(cols or [f.out for f in FEATS])).collect())


@pytest.mark.parametrize("block_rows", [1, 4, 25])
@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_single_pass(spark, block_rows, seed):
    df = frame(spark, seed)
    plain = add_prior(df, Panel(("e",), ("p", "id")), FEATS)
    cut = add_prior(df, Panel(("e",), ("p", "id"), ("p",), block_rows), FEATS)
    assert result(plain) == result(cut)
    assert cut.columns == plain.columns


@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_finer_windows_in_one_call(spark, block_rows):
    df = frame(spark)
    panel = Panel(("e",), ("p", "id"), ("p",), block_rows)
    inner = [Expanding("x", "season_total", within=("p",)), Rolling("x", 2, "season_r2", within=("p",))]
    both = add_prior(df, panel, [*FEATS, *inner], sizes=df.select("e", "p"))
    cols = [f.out for f in [*FEATS, *inner]]
    twice = add_prior(add_prior(df, Panel(("e",), ("p", "id")), FEATS), Panel(("e", "p"), ("p", "id")), [Expanding("x", "season_total"), Rolling("x", 2, "season_r2")])
    assert result(both, cols) == result(twice, cols)


def test_python_reference(spark):
    rows = sorted((r.e, r.p, r.id, r.x) for r in frame(spark).collect())
    want = {}
    for _, grp in itertools.groupby(rows, key=lambda r: r[0]):
        past = []
        for e, p, i, x in grp:
            recent = [v for v in past[-3:] if v is not None]
            want[i] = (sum(recent) / len(recent) if recent else None, past[-1] if past else None, len(past))
            past.append(x)
    out = add_prior(frame(spark), Panel(("e",), ("p", "id")), FEATS)
    got = {r.id: (r.r3, r.lag1, r.i) for r in out.collect()}
    assert got == want


def test_no_leak(spark):
    df = frame(spark)
    changed = df.withColumn("x", F.when(F.col("id") == 80, 999.0).otherwise(F.col("x")))
    key = [(r.e, r.p, r.id) for r in df.where("id = 80").collect()][0]
    panel = Panel(("e",), ("p", "id"))
    a, b = result(add_prior(df, panel, FEATS)), result(add_prior(changed, panel, FEATS))
    for x, y in zip(a, b):
        if x[0] != key[0] or x[:3] <= key:
            assert x == y


def test_partitioning_does_not_matter(spark):
    df = frame(spark)
    panel = Panel(("e",), ("p", "id"))
    assert result(add_prior(df.repartition(7), panel, FEATS)) == result(add_prior(df.coalesce(1), panel, FEATS))


def test_one_shuffle_one_sort(spark):
    plan = add_prior(frame(spark), Panel(("e",), ("p", "id")), FEATS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") <= 2


def test_ewm_with_long_null_run(spark):
    xs = [4.0, None, 2.0] + [None] * 150 + [1.0, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "e string, i int, x double")
    got = {r.i: r.m for r in _ewm(df).collect()}
    for t in range(len(xs)):
        past = [(t - 1 - j, x) for j, x in enumerate(xs[:t]) if x is not None]
        if not past:
            assert got[t] is None
            continue
        base = min(k for k, _ in past)
        num = sum((2 / 3) ** (k - base) * x for k, x in past)
        den = sum((2 / 3) ** (k - base) for k, _ in past)
        assert got[t] == pytest.approx(num / den, rel=1e-12)


@pytest.mark.parametrize("span", [5, 60])
def test_weighted_mean_of_a_long_history(spark, span):
    """10,000 rows of one entity against the recurrence; divided into blocks the result is the same."""
    rng = random.Random(span)
    rows, i = [], 0
    while len(rows) < 10_000:
        i += rng.choice([1, 1, 1, 400])
        rows.append(("a", i, i // 50, None if rng.random() < 0.2 or 3000 < len(rows) < 6000 else rng.uniform(-5, 5)))
    df = spark.createDataFrame(rows + [("b", 1, 0, None), ("b", 2, 0, 4.0), ("b", 3, 0, None)], "e string, i int, p int, x double")
    keep, num, den, mean, want = 1 - 2 / (span + 1), 0.0, 0.0, None, {}
    for _, t, _, x in rows:
        want[t] = mean
        num, den = num * keep, den * keep
        if x is not None:
            num, den = num + x, den + 1
            mean = num / den
    for size in (5_000_000, 3000):
        panel = Panel(("e",), ("i",), ("p",), block_rows=size)
        got = {(r.e, r.i): r.m for r in W.ewm_prior(df, panel, "x", span, "m").collect()}
        assert len(got) == len(rows) + 3 and got["b", 2] is None and got["b", 3] == 4.0
        for t, m in want.items():
            assert (got["a", t] is None) == (m is None) and (m is None or abs(got["a", t] - m) < 1e-9)


def _ewm(df):
    return W.ewm_prior(df, Panel(("e",), ("i",)), "x", 5, "m")


def test_tier_award_ties(spark):
    rows = [("m", i, float(v)) for i, v in enumerate([9, 9, 7, 7, 5, 3, 0, -1])] + [("z", 9, 0.0)]
    df = spark.createDataFrame(rows, "m string, id int, v double")
    got = {r.id: r.a for r in W.tier_award(df, ["m"], "v", "a").collect()}
    assert got == {0: 3, 1: 3, 2: 2, 3: 2, 4: 1, 5: 0, 6: 0, 7: 0, 9: 0}


def test_densify_fills_gaps(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 2, 1), ("a", 5, 3), (None, 1, 1), ("b", None, 1)], "e string, p int, x int")
    got = sorted(tuple(r) for r in W.densify(df, ["e"], "p", ["x"], []).collect())
    assert got == [("a", 2, 6), ("a", 3, 0), ("a", 4, 0), ("a", 5, 3)]
