"""Grouped aggregates over panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.probability import POINTS, appearance_points, by_class, expected_floor, nb_tail
from panelwright.functions.text import concat_group
from panelwright.semantics import with_keys


def team_totals(df: DataFrame, keys: Sequence[str], team: str, opp: str, cols: Sequence[str], own: str = "own_goal"):
    """Sums per side and period; own goals of the other side are credited."""
    src = with_keys(df, [team, *keys])
    totals = src.groupBy(team, *keys).agg(*(F.sum(c).alias(f"team_{c}") for c in cols))
    gifts = (
        with_keys(df, [opp, *keys])
        .groupBy(F.col(opp).alias(team), *keys)
        .agg(F.sum(own).alias("__gift"))
    )
    out = totals.join(gifts, [team, *keys], "left")
    return out.withColumn("team_goals", F.col("team_goals") + F.coalesce("__gift", F.lit(0))).drop("__gift")


def collapse(df: DataFrame, keys: Sequence[str], sums: Sequence[str], maxes: Sequence[str]) -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxes)
    )


def team_match(df: DataFrame, keys: Sequence[str], sums: Sequence[str], firsts: Sequence[str], order: str) -> DataFrame:
    """Wide team-match aggregate; carried columns take the first non-null value."""
    first = (F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts)
    return with_keys(df, keys).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *first)


def opponent_side(tm: DataFrame, cols: Sequence[str], match="match_id", team="team_no", opp="opp_no", prefix="opp_"):
    """The other side's totals of the same match; null when it has no rows."""
    other = tm.select(match, F.col(team).alias(opp), *(F.col(c).alias(f"{prefix}{c}") for c in cols))
    return tm.join(other, [match, opp], "left")


def goals_conceded(tm: DataFrame, match="match_id", team="team_no", opp="opp_no") -> DataFrame:
    """Opponent's goals plus own own-goals, and expected goals against."""
    out = opponent_side(tm, ["goals", "xg"], match, team, opp)
    conceded = F.col("opp_goals") + F.col("own_goal")
    return out.withColumn("goals_conceded", conceded).withColumnRenamed("opp_xg", "xga").drop("opp_goals")


def goals_for_against(sides: DataFrame, totals: DataFrame, match="match_id", team="team_no") -> DataFrame:
    """GF and GA with own goals for each listed side; null when no rows exist at all."""
    mine = totals.select(match, team, F.col("goals").alias("gf_self"), F.col("own_goal").alias("og_self"))
    rival = totals.select(
        match, F.col(team).alias("__rival"), F.col("goals").alias("opp_goals"), F.col("own_goal").alias("opp_og")
    )
    out = sides.join(mine, [match, team], "left").alias("s")
    out = out.join(rival.alias("r"), (F.col(f"s.{match}") == F.col(f"r.{match}")) & (F.col(f"s.{team}") != F.col("__rival")), "left")
    out = out.drop(F.col(f"r.{match}"))
    known = F.col("gf_self").isNotNull() | F.col("opp_goals").isNotNull()
    z = F.lit(0)
    return out.select(
        *sides.columns,
        F.when(known, F.coalesce("gf_self", z) + F.coalesce("opp_og", z)).alias("gf"),
        F.when(known, F.coalesce("opp_goals", z) + F.coalesce("og_self", z)).alias("ga"),
    )


def distribution_profile(df: DataFrame, keys: Sequence[str], value: str, top: int = 11, full: float = 89) -> DataFrame:
    """Shape of the positive values of a group.

    Built on (group, value) counts, so equal values are combined before the
    shuffle and no list of a group's rows is ever held.
    """
    ks = list(keys)
    counts = with_keys(df, ks).where(F.col(value) > 0).groupBy(*ks, value).agg(F.count(F.lit(1)).alias("__n"))
    v, n = F.col(value), F.col("__n")
    up = Window.partitionBy(*ks).orderBy(value)
    down = Window.partitionBy(*ks).orderBy(F.desc(value))
    everything = Window.partitionBy(*ks)
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    staged = counts.select(
        *ks,
        v.alias("v"),
        n.alias("n"),
        before(up).alias("below"),
        before(down).alias("above"),
        F.sum("__n").over(everything).alias("cnt"),
        F.sum(v * n).over(everything).alias("total"),
    )
    v, n = F.col("v"), F.col("n")
    # zero-based positions of the two middle values
    lo, hi = F.floor((F.col("cnt") - 1) / 2), F.floor(F.col("cnt") / 2)
    holds = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + n)
    mean = F.col("total") / F.col("cnt")
    share = v / F.col("total")
    return staged.groupBy(*ks).agg(
        F.max(mean).alias("mins_mean"),
        ((F.max(F.when(holds(lo), v)) + F.max(F.when(holds(hi), v))) / 2).alias("mins_median"),
        F.sqrt(F.sum(n * F.pow(v - mean, F.lit(2))) / F.sum(n)).alias("mins_std"),
        F.max(v).alias("mins_max"),
        F.sum(n).alias("num_players_used"),
        F.sum(F.when(v >= full, n).otherwise(0)).alias("num_full_90"),
        F.greatest(F.sum(n) - top, F.lit(0)).alias("num_subs_made"),
        (F.sum(v * F.greatest(F.least(n, top - F.col("above")), F.lit(0))) / F.max("total")).alias(
            "mins_concentration_top11"
        ),
        (-F.sum(n * share * F.log(share + 1e-12))).alias("mins_entropy"),
    )


def bounds(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(period).alias(f"{period}_min"), F.max(period).alias(f"{period}_max"))


def season_rates(tm: DataFrame, team: str, season: Column, cols: Sequence[str]) -> DataFrame:
    """Season-to-date averages per team; ``season`` is the row condition."""
    return tm.where(season).groupBy(team).agg(*(F.avg(c).alias(f"season_{c}_per_game") for c in cols))


def league_mean(df: DataFrame, col: str, floor: float = 0.5, fallback: float = 1.3) -> DataFrame:
    """One row: overall mean, replaced by a fallback when implausibly small."""
    m = F.avg(col)
    return df.agg(F.when(m < floor, fallback).otherwise(F.coalesce(m, F.lit(fallback))).alias("league_mean"))


def aggregate_multi(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    sums: Sequence[str],
    means: Sequence[str],
    firsts: Sequence[str],
    concats: Sequence[str],
    lists: Sequence[str] = (),
) -> DataFrame:
    """Several fixtures of an entity as one row; single fixtures pass through unchanged.

    The collected texts hold one entry per fixture of the period.
    """
    listed = (
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda p: p["v"]
        ).alias(c)
        for c in lists
    )
    return df.groupBy(*key).agg(
        *(F.sum(c).alias(c) for c in sums),
        *(F.avg(c).alias(c) for c in means),
        *(F.min_by(c, order).alias(c) for c in firsts),
        *(concat_group(c, order).alias(c) for c in concats),
        *listed,
        F.count(F.lit(1)).alias("fixture_num"),
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def match_report(df: DataFrame, matched: Column, positive: Column) -> DataFrame:
    """Match quality: matched, total, unmatched, positives among the matched."""
    return df.agg(
        F.count_if(matched).alias("matched"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~matched).alias("unmatched"),
        F.count_if(matched & positive).alias("positives"),
    )


def compare_runs(
    results: DataFrame, runs: DataFrame, n: int, run: str = "run_id", started: str = "started", model: str = "model", score: str = "score"
) -> DataFrame:
    """Model by run table of scores for the ``n`` latest runs: columns run_1 (newest) to run_n.

    Finding the latest runs is a top-k; only those are numbered and joined.
    """
    latest = runs.select(run, started).distinct().orderBy(F.desc(started), F.desc(run)).limit(n)
    numbered = latest.withColumn("__k", F.row_number().over(Window.orderBy(F.desc(started), F.desc(run)))).select(run, "__k")
    chosen = results.join(numbered, run).groupBy(model)
    return chosen.agg(*(F.min(F.when(F.col("__k") == i, F.col(score))).alias(f"run_{i}") for i in range(1, n + 1)))


def points_breakdown(df: DataFrame, label: str = "fpl_position", dispersion: Column | None = None) -> DataFrame:
    """Average predicted against actual value and points per category, plus TOTAL.

    Points are averaged over all rows. The values of three categories are
    averaged over the rows the category applies to.
    """
    pos, mins, pm = F.col(label), F.col("minutes"), F.col("pred_minutes")
    d = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    goal, clean = by_class(label, POINTS["goal"], 5), by_class(label, POINTS["clean_sheet"], 0)
    gc = F.coalesce(F.col("goals_conceded"), F.lit(1))
    back = pos.isin("GK", "DEF") & (mins >= 60)
    keeper = pos == "GK"
    mid = pos.isin("DEF", "MID") & (pm >= 60)
    kept = ((mins >= 60) & (gc == 0)).cast("double")
    saves = F.col("pred_saves") * (pm / 90)
    r = dispersion if dispersion is not None else F.lit(None).cast("double")
    back_bar, other_bar = 10, 12
    hit = nb_tail(F.when(pos == "DEF", back_bar).otherwise(other_bar), r, "pred_defcon", most=max(back_bar, other_bar))
    every = F.lit(True)
    zero = F.lit(0.0)
    rows = [
        ("Appearance", every, pm, appearance_points("pred_minutes"), mins, appearance_points("minutes")),
        ("Goals", every, F.col("pred_goals"), F.col("pred_goals") * goal, F.col("goals"), F.col("goals") * goal),
        (
            "Assists",
            every,
            F.col("pred_assists"),
            F.col("pred_assists") * POINTS["assist"],
            F.col("assists"),
            F.col("assists") * POINTS["assist"],
        ),
        ("Clean Sheet", every, F.col("pred_cs_prob"), F.when(pm >= 60, F.col("pred_cs_prob") * clean).otherwise(zero), kept, kept * clean),
        (
            "Goals Conceded",
            back,
            F.col("pred_goals_against"),
            F.when(back, expected_floor("pred_goals_against")).otherwise(zero),
            gc,
            F.when(back, -F.floor(gc / 2)).otherwise(F.lit(0)),
        ),
        (
            "Saves",
            keeper,
            saves,
            F.when(keeper, saves / 3 * POINTS["saves_triple"]).otherwise(zero),
            F.col("saves"),
            F.when(keeper, F.floor(F.col("saves") / 3)).otherwise(F.lit(0)),
        ),
        (
            "Defcon",
            mid,
            hit,
            F.when(mid, hit * POINTS["defcon"]).otherwise(zero),
            F.col("hit_threshold"),
            F.when(mid, F.col("hit_threshold") * POINTS["defcon"]).otherwise(F.lit(0)),
        ),
        (
            "Yellow Cards",
            every,
            F.col("pred_yellow"),
            F.col("pred_yellow") * POINTS["yellow"],
            F.col("yellow"),
            F.col("yellow") * POINTS["yellow"],
        ),
        ("Red Cards", every, F.col("pred_red"), F.col("pred_red") * POINTS["red"], F.col("red"), F.col("red") * POINTS["red"]),
        ("Bonus", every, F.col("pred_bonus"), F.col("pred_bonus"), F.col("bonus"), F.col("bonus")),
    ]
    # one row of averages for all categories, then a row for each: input rows are not multiplied
    values, cells = {}, []
    for i, (name, cond, pv, pp, av, ap) in enumerate(rows):
        for tag, value in (("pv", F.when(cond, d(pv))), ("pp", d(pp)), ("av", F.when(cond, d(av))), ("ap", d(ap))):
            values[f"{tag}{i}"] = value
        cells.append(
            F.struct(
                F.lit(name).alias("category"),
                F.coalesce(F.col(f"pv{i}"), F.lit(0.0)).alias("pred_value_avg"),
                F.col(f"pp{i}").alias("pred_pts_avg"),
                F.coalesce(F.col(f"av{i}"), F.lit(0.0)).alias("actual_value_avg"),
                F.col(f"ap{i}").alias("actual_pts_avg"),
            )
        )
    columns = df.where(mins >= 1).select(*(v.alias(c) for c, v in values.items()))
    whole = columns.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in values)).where("n > 0")
    per_category = whole.select(F.inline(F.array(*cells)))
    diff = F.col("pred_pts_avg") - F.col("actual_pts_avg")
    total = F.grouping("category") == 1
    return (
        per_category.rollup("category")
        .agg(
            F.when(total, F.lit(None)).otherwise(F.max("pred_value_avg")).alias("pred_value_avg"),
            F.sum("pred_pts_avg").alias("pred_pts_avg"),
            F.when(total, F.lit(None)).otherwise(F.max("actual_value_avg")).alias("actual_value_avg"),
            F.sum("actual_pts_avg").alias("actual_pts_avg"),
            F.sum(diff).alias("pts_diff"),
            F.sum(F.abs(diff)).alias("abs_pts_diff"),
        )
        .withColumn("category", F.coalesce("category", F.lit("TOTAL")))
    )
