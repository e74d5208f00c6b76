"""Null periods, moved keys, repeated aliases, large rates and thresholds."""

import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import probability as M, text as T
from panelwright.operators import clean as C, draws as X, learning as L
from panelwright.operators.ordering import global_row_index, time_folds
from panelwright.operators.windows import Expanding, FillPrior, Lag, Panel, Rolling, add_prior
from panelwright.semantics import broadcast_if_small
from panelwright.sources import sinks


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def with_nulls(spark):
    rows = [(i % 2, None if i % 4 == 1 else i // 6, i, float(i * i % 7)) for i in range(60)]
    return spark.createDataFrame(rows, "e int, p int, o int, x double")


def test_cut_equals_uncut_with_null_periods(with_nulls):
    feats = [Rolling("x", 3, "r"), Expanding("x", "s"), Expanding("x", "n", agg="count"), Lag("x", k=2, out="l"), FillPrior("x", out="f")]
    whole = Panel(("e",), ("p", "o"), ("p",))
    cut = Panel(("e",), ("p", "o"), ("p",), block_rows=4)
    a, b = (sorted(map(tuple, add_prior(with_nulls, q, feats).collect()), key=str) for q in (whole, cut))
    assert a == b


def test_order_keeps_rows_without_a_period(with_nulls):
    rows = global_row_index(with_nulls, ["p"], ["o"], heavy_rows=5).orderBy("row_index").collect()
    assert [r.row_index for r in rows] == list(range(60))
    assert [(r.p is not None, r.p or 0, r.o) for r in rows] == sorted((r.p is not None, r.p or 0, r.o) for r in rows)
    assert time_folds(with_nulls, ["p"], ["o"]).count() == 60


def test_holdout_trains_on_rows_without_a_season(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (2, 3), (2, None)], "season int, gw int")
    train, test = C.holdout(df, "season", 2)
    assert train.count() == 2 and test.count() == 2
    train, test = C.holdout(df, "season", 2, ("gw", 1))
    assert train.count() == 3 and test.count() == 1


def test_repeated_lookups_take_the_smallest(spark):
    df = spark.createDataFrame([("Ann Lee",)], "n string")
    names = spark.createDataFrame([("ann lee", "MID"), ("ann lee", "DEF")], "name string, label string")
    df = df.withColumn("code", F.lit("9"))
    assert C.resolve_label(df, "n", names, "code", {0: "GK"}, "X", "out").first().out == "DEF"
    al = spark.createDataFrame([("ann_lee", "b"), ("ann_lee", "a")], "alias string, canonical string")
    assert T.canonical(df, "n", al, "out").first().out == "a"


def test_large_rates_and_thresholds(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 800.0), (2, 2000.0), (3, None)], "k int, lam double")
    rows = X.draws(df, 2000, "k", {"y": "lam"}).groupBy("k").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v")).collect()
    for r in rows:
        lam = {0: 3.0, 1: 800.0, 2: 2000.0}.get(r.k)
        if lam:
            assert abs(r.m - lam) < 5 * math.sqrt(lam / 2000) and 0.85 < r.v / lam < 1.15
    bars = spark.createDataFrame([(t, 4.0) for t in (1, 12, 13, 20)], "t int, mu double")
    got = {r.t: r.p for r in bars.select("t", M.nb_tail(F.col("t"), F.lit(None).cast("double"), "mu").alias("p")).collect()}
    for t, p in got.items():
        assert p == pytest.approx(1 - sum(math.exp(-4) * 4**i / math.factorial(i) for i in range(t)), abs=1e-12)


def test_moved_key_and_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a", 1, 1.0), (2, "a", 1, 2.0), (3, "b", 1, 3.0), (4, "c", 1, 4.0)], "k int, part string, seq int, v double")
    sinks.write_partitions(old, path, ["part"])
    new = spark.createDataFrame([(1, "b", 2, 9.0), (5, "b", 2, 5.0)], "k int, part string, seq int, v double")
    sinks.upsert_table(spark, path, old.schema, new, ["k"], "seq", ["part"])
    got = sorted((r.k, r.part, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, "b", 9.0), (2, "a", 2.0), (3, "b", 3.0), (4, "c", 4.0), (5, "b", 5.0)]
    scan = plan(spark.read.schema(old.schema).parquet(path).where(sinks._partition_filter(new, ["part"])))
    assert "PartitionFilters: [isnotnull(part" in scan and "(part" in scan and "= b)" in scan
    last = spark.createDataFrame([(4, "b", 3, 0.0)], "k int, part string, seq int, v double")
    # the partition that loses its only row is gone, not left behind
    sinks.upsert_table(spark, path, old.schema, last, ["k"], "seq", ["part"])
    got = sorted((r.k, r.part, r.v) for r in spark.read.schema(old.schema).parquet(path).collect())
    assert got == [(1, "b", 9.0), (2, "a", 2.0), (3, "b", 3.0), (4, "b", 0.0), (5, "b", 5.0)]


def test_upsert_of_null_and_emptied_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v double, seq int, part string, week int"
    rows = lambda df: sorted(((r.k, r.part or "", r.week or 0, r.v) for r in df.collect()))
    old = spark.createDataFrame([(1, 1.0, 1, None, 1), (2, 2.0, 1, "x/ y=é", 1), (3, 3.0, 1, "x/ y=é", None), (4, 4.0, 1, "z", 2)], schema)
    sinks.write_partitions(old, path, ["part", "week"])
    read = lambda: spark.read.schema(schema).parquet(path)
    # out of the null partition, into it, and out of a partition whose name needs escapes
    new = spark.createDataFrame([(1, 9.0, 2, "z", 2), (4, 8.0, 2, None, 1), (2, 7.0, 2, "n", 5)], schema)
    sinks.upsert_table(spark, path, read().schema, new, ["k"], "seq", ["part", "week"])
    assert rows(read()) == [(1, "z", 2, 9.0), (2, "n", 5, 7.0), (3, "x/ y=é", 0, 3.0), (4, "", 1, 8.0)]
    again = spark.createDataFrame([(3, 6.0, 3, "n", 5), (4, 5.0, 3, "n", 5)], schema)
    sinks.upsert_table(spark, path, read().schema, again, ["k"], "seq", ["part", "week"])
    assert rows(read()) == [(1, "z", 2, 9.0), (2, "n", 5, 7.0), (3, "n", 5, 6.0), (4, "n", 5, 5.0)]


def test_size_checks_do_not_gather_rows(spark):
    small = broadcast_if_small(spark.range(10))
    assert "broadcast" in plan(small).lower()
    assert "broadcast" not in plan(broadcast_if_small(spark.range(10), limit=100)).lower()


def test_start_label_is_not_weighed_by_minutes(spark):
    rows = [(90.0 if i % 2 else 10.0, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "minutes double, f double")
    p = L.fit_minutes(df, ["f"], rounds=2).starter.predict(df, "p").agg(F.avg("p")).first()[0]
    assert abs(p - 0.5) < 0.02


def test_feature_table_moves_no_window_columns(spark, tmp_path):
    """The calendar features join the facts before the windows: no hash shuffle stands above a window of players."""
    from panelwright.plans.features import player_features
    from panelwright.plans.standins import PLAYER, TEAM, player_match

    ts = F.timestamp_seconds(F.col("id") * 7200 + 1704067200)
    spark.range(300).select(
        F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 23).alias("user_id"),
        F.element_at(F.array(F.lit("view"), F.lit("purchase"), F.lit("click")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 97).cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    names = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "true")
        spark.conf.set(names[1], "-1")
        pm = player_match(spark, str(tmp_path))
        out = player_features(pm, PLAYER, TEAM)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Window") < plan.index("Exchange hashpartitioning")
        assert len(set(out.columns)) == len(out.columns)
        rows = out.select("match_row", "last_minutes", "minutes_roll3").collect()
        assert sorted(r.match_row for r in rows) == list(range(300))
        assert any(r.last_minutes for r in rows) and any(r.minutes_roll3 for r in rows)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
