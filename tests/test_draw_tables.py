"""Draw tables: exact percentiles by ranks, density by binned moments, awards by thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import draws as X
from panelwright.operators.windows import tier_award


@pytest.fixture(scope="module")
def totals(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v)) for v in np.round(rng.normal(6, 4, 4000), 3)]
    rows += [("b", float(v)) for v in rng.poisson(5, 2000)] + [("c", 4.0)] * 7 + [("d", 1.0), ("d", 2.5), (None, 3.0), (None, 9.0), ("e", None)]
    return rows, spark.createDataFrame(rows, "who string, total double").cache()


def of(rows, who):
    return np.array([v for w, v in rows if w == who and v is not None])


@pytest.mark.parametrize("part_values", [1_000_000, 50])
def test_percentiles_are_exact(totals, part_values):
    rows, df = totals
    got = {r.who: r for r in X.percentiles(df, ["who"], "total", {"median": 0.5, "p10": 0.1, "top": 1.0}, [5, 10], part_values).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for who, r in got.items():
        v = of(rows, who)
        assert (r.median, r.p10, r.top) == pytest.approx((np.percentile(v, 50), np.percentile(v, 10), v.max()), abs=1e-12)
        assert (r.p_5plus, r.p_10plus) == pytest.approx(((v >= 5).mean(), (v >= 10).mean()))


def test_density_equals_the_plain_sum(totals):
    rows, df = totals
    got = {}
    for r in X.density(df, ["who"], "total", points=60).collect():
        got.setdefault(r.who, {})[r.i] = (r.x, r.density)
    assert set(got) == {"a", "b", "d", None}
    for who, cells in got.items():
        v = of(rows, who)
        h = 0.35 * v.std(ddof=1)
        lo, hi = v.min() - 1, min(v.max() + 1, 30.0)
        for i, (x, p) in cells.items():
            assert x == pytest.approx(lo + (hi - lo) * i / 59)
            plain = np.exp(-(((x - v) / h) ** 2) / 2).sum() / (len(v) * h * (2 * np.pi) ** 0.5)
            assert p == pytest.approx(plain, abs=1e-11 / h)


def test_density_has_as_many_rows_as_bins(spark):
    """200,000 distinct values of one entity meet the grid as a few hundred bins."""
    df = spark.range(200_000).select(F.lit("x").alias("who"), (F.randn(3) * 4).alias("total"))
    plan = X.density(df, ["who"], "total")
    assert plan.count() == 200
    assert plan.agg(F.sum("density") * (F.max("x") - F.min("x")) / 199).first()[0] == pytest.approx(1, abs=0.02)


def test_awards_do_not_join_by_value(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") % 13).cast("double").alias("v"))
    out = tier_award(df, ["g"], "v", "a")
    assert {r.v: r.a for r in out.where("g = 0").collect()} == {float(v): {12: 3, 11: 2, 10: 1}.get(v, 0) for v in range(13)}
    assert out.count() == 1000


def test_rows_do_not_move_to_their_thresholds(spark):
    """Whatever the planner guesses about the rows: the thresholds are small when they are counted."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(500).select((F.col("id") % 7).alias("g"), (F.col("id") % 13).cast("double").alias("v"))
        out = tier_award(df.unionByName(spark.createDataFrame([(None, 20.0), (3, None)], df.schema)), ["g"], "v", "a")
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.g, r.v): r.a for r in out.collect()} == {
            **{(g, float(v)): {12: 3, 11: 2, 10: 1}.get(v, 0) for g in range(7) for v in range(13)}, (None, 20.0): 0, (3, None): 0
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_counts_need_no_pass_over_all_steps(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 4.0), (4, 12.0), (5, 1200.0), (6, None)], "k int, lam double")
    out = X.draws(df, 300, "k", rates={"g": "lam"})
    assert "CASE WHEN (__u_g" in out._jdf.queryExecution().optimizedPlan().toString()
    plain = out.select("k", "g", X.uniform(7, "g", "k", "draw_id").alias("u"), X.poisson_steps("lam").alias("s")).where("k <> 5").collect()
    assert all(r.g == sum(c <= r.u for c in r.s) for r in plain) and max(r.g for r in plain) > X.FIRST_STEPS
    assert out.where("k = 5").agg(F.avg("g")).first()[0] == pytest.approx(1200, rel=0.01)


def test_only_draws_that_reach_a_floor_are_ranked(spark, monkeypatch):
    """Awards are those of a ranking of all draws, but what is staged for it is a small part of them."""
    rng = np.random.default_rng(4)
    labels = ["GK", "DEF", "MID", "FWD"]
    rows = [(i, 1 + i % 2, labels[i % 4], bool(i % 9), float(rng.normal(10, 6)), float(rng.gamma(1, 0.4)), 0.2) for i in range(600)]
    rows += [(None, 1, "FWD", True, 30.0, 0.5, 0.1), (7, 2, "MID", True, 12.0, 0.3, 0.2), (900, None, "FWD", True, 50.0, 1.0, 0.0), (901, 3, "DEF", True, 4.0, 0.1, 0.5)]
    rows += [(902, 3, "MID", True, -4.0, 0.0, 0.5), (903, 4, None, True, None, 0.1, 0.5), (904, 1, "FWD", True, float("nan"), 0.1, 0.5)]
    df = spark.createDataFrame(rows, "k int, match_id int, fpl_position string, playing boolean, baseline double, lam double, p double")
    drawn = X.draws(df, 40, "k", {"goals": "lam", "assists": "lam"}, {"yellow": "p", "clean_sheet": "p"}).cache()
    staged, stage = {}, X.persisted

    def noted(d, label):
        staged[label] = stage(d, label)
        return staged[label]

    monkeypatch.setattr(X, "persisted", noted)
    got = {r.k: r.mean_award for r in X.award_over_draws(drawn, "k").collect()}
    score = (
        F.col("baseline") + F.col("goals") * X.by_class("fpl_position", X.AWARD_SCORE["goal"], 18) + F.col("assists") * X.AWARD_SCORE["assist"]
        + F.col("clean_sheet") * X.by_class("fpl_position", X.AWARD_SCORE["clean_sheet"], 0) + F.col("yellow") * X.AWARD_SCORE["yellow"]
    )
    plain = drawn.withColumn("s", F.when(F.col("playing"), score).otherwise(0.0))
    plain = tier_award(plain, ["draw_id", "match_id"], "s", "a").groupBy("k").agg(F.avg("a").alias("m"))
    assert got == {r.k: r.m for r in plain.collect()} and len(got) == 606
    assert got[904] == 3 and got[900] == 0 and got[902] == 0 and got[903] == 0
    assert 0 < staged["reached"].count() < drawn.count() / 4


def test_few_rows_are_drawn_by_as_many_tasks_as_many(spark):
    df = spark.range(20).select("id", F.lit(0.5).alias("lam"))
    assert X.draws(df, 10, "id", {"goals": "lam"}).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
