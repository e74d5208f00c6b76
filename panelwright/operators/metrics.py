"""Evaluation queries: every one a grouped aggregate, none needs the rows on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.operators.ordering import average_rank, value_ranks
from panelwright.semantics import persisted


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _keep(where: Column | None, value: Column) -> Column:
    return value if where is None else F.when(where, value)


# Aggregate expressions. ``where`` limits a metric to part of the rows.


def mae(y, p, where: Column | None = None) -> Column:
    return F.avg(_keep(where, F.abs(_c(p) - _c(y))))


def rmse(y, p, where: Column | None = None) -> Column:
    return F.sqrt(F.avg(_keep(where, F.pow(_c(p) - _c(y), F.lit(2)))))


def bias(y, p, where: Column | None = None) -> Column:
    return F.avg(_keep(where, _c(p) - _c(y)))


def huber(y, p, delta: float = 10.0, where: Column | None = None) -> Column:
    e = F.abs(_c(p) - _c(y))
    loss = F.when(e <= delta, F.pow(e, F.lit(2)) / 2).otherwise(delta * (e - delta / 2))
    return F.avg(_keep(where, loss))


def poisson_deviance(y, p, least: float = 1e-8, where: Column | None = None) -> Column:
    yy, pp = F.greatest(_c(y).cast("double"), F.lit(0.0)), F.greatest(_c(p).cast("double"), F.lit(least))
    part = F.when(yy > 0, yy * F.log(yy / pp) - yy + pp).otherwise(pp)
    return 2 * F.avg(_keep(where, part))


def accuracy(y, p, cut: float = 0.5) -> Column:
    return F.avg(((_c(p) >= cut) == (_c(y) == 1)).cast("double"))


def log_loss(y, p, eps: float = 1e-15) -> Column:
    q = F.greatest(F.least(_c(p), F.lit(1 - eps)), F.lit(eps))
    return -F.avg(F.when(_c(y) == 1, F.log(q)).otherwise(F.log(1 - q)))


# Queries.


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(mae(y, p).alias("mae"), rmse(y, p).alias("rmse"), bias(y, p).alias("bias"), F.count(F.lit(1)).alias("n"))


def metrics_where(df: DataFrame, y: str, p: str, conds: Mapping[str, Column]) -> DataFrame:
    """MAE of named subsets in one pass."""
    return df.agg(*(mae(y, p, cond).alias(f"{name}_mae") for name, cond in conds.items()))


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: area under the ROC curve from average ranks of distinct scores."""
    pairs = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).alias("pos")
    )
    pairs = persisted(pairs, "scores")
    ranks = value_ranks(pairs, "value", weight="n")
    joined = pairs.select("value", "pos").join(ranks, "value")
    sums = joined.agg(
        F.sum(F.col("pos") * average_rank()).alias("rank_sum"), F.sum("pos").alias("np"), F.sum("n").alias("nt")
    )
    np_, nn = F.col("np"), F.col("nt") - F.col("np")
    return sums.select(F.when((np_ > 0) & (nn > 0), (F.col("rank_sum") - np_ * (np_ + 1) / 2) / (np_ * nn)).alias("auc"))


def binary_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """AUC, accuracy at one half and log loss."""
    plain = df.agg(accuracy(y, p).alias("accuracy"), log_loss(y, p).alias("log_loss"))
    return plain.select(auc(df, y, p).scalar().alias("auc"), "accuracy", "log_loss")


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: rank correlation with ties at their mean rank.

    Pairs of values are counted first; the mean rank is known, so the
    centred sums need one pass.
    """
    pairs = (
        df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
        .groupBy(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = persisted(pairs, "pairs")
    out = pairs
    for c in ("y", "p"):
        ranks = value_ranks(pairs, c, weight="n").select(F.col("value").alias(c), average_rank().alias(f"r{c}"))
        out = out.join(ranks, c)
    mid = (pairs.agg(F.sum("n")).scalar() + 1) / 2
    dy, dp, n = F.col("ry") - mid, F.col("rp") - mid, F.col("n")
    sums = out.agg(F.sum(n * dy * dp).alias("xy"), F.sum(n * dy * dy).alias("xx"), F.sum(n * dp * dp).alias("yy"))
    norm = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(F.when(norm > 0, F.col("xy") / norm).alias("spearman"))


def median(df: DataFrame, col: str) -> DataFrame:
    """One row: exact median by rank, on distinct values."""
    ranks = value_ranks(df, col)
    total = F.col("total")
    staged = ranks.select("value", "n", "n_below", ranks.agg(F.sum("n")).scalar().alias("total"))
    holds = lambda pos: (F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n"))
    lo, hi = F.floor((total - 1) / 2), F.floor(total / 2)
    return staged.agg(
        ((F.max(F.when(holds(lo), F.col("value"))) + F.max(F.when(holds(hi), F.col("value")))) / 2).alias("median")
    )


def naive_median(df: DataFrame, y: str, least: float = 1e-3) -> DataFrame:
    """Poisson deviance of giving everybody the median."""
    med = median(df, y).scalar()
    guess = F.greatest(F.col("__med"), F.lit(least))
    return df.select(y, med.alias("__med")).agg(
        F.max("__med").alias("median"), poisson_deviance(y, guess).alias("naive_deviance")
    )


# Edges of the twelve half-open prediction buckets.
CALIBRATION_EDGES = (1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 50)


def calibration(df: DataFrame, y: str, p: str, edges: Sequence[float] = CALIBRATION_EDGES, top: float = 50) -> DataFrame:
    """Mean predicted and actual per prediction bucket; empty buckets do not appear."""
    label = None
    for lo, hi in zip(edges, edges[1:]):
        name = f"{lo}-{hi}" if hi < top else f"{lo}+"
        cond = (F.col(p) >= lo) & (F.col(p) < hi)
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return (
        df.withColumn("bucket", label)
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred"), F.avg(y).alias("actual"))
    )


def points_metrics(df: DataFrame, actual: str = "actual_pts", pred: str = "pred_pts", bonus: str = "actual_bonus", pred_bonus: str = "pred_bonus") -> DataFrame:
    """Predicted against actual points of rows that were played, one row."""
    played = df.where((F.col("minutes") >= 1) & F.col(actual).isNotNull() & F.col(pred).isNotNull())
    full = played.select(
        F.col(actual).alias("a"),
        F.col(pred).alias("p"),
        F.col(bonus).alias("b"),
        F.col(pred_bonus).alias("pb"),
        (F.col(actual) + F.coalesce(F.col(bonus), F.lit(0))).alias("ai"),
        (F.col(pred) + F.coalesce(F.col(pred_bonus), F.lit(0))).alias("pi"),
    ).withColumn("an", F.greatest(F.col("ai"), F.lit(0)))
    # seven numbers per row, staged: the median, the ranks and the errors all read them
    full = persisted(full, "points")
    med = median(full, "an").scalar()
    guess = F.greatest(F.col("__med"), F.lit(1e-3))
    return full.withColumn("__med", med).agg(
        mae("a", "p").alias("mae_ex_bonus"),
        mae("ai", "pi").alias("mae_inc_bonus"),
        poisson_deviance("an", "pi", 1e-3).alias("poisson_dev_inc_bonus"),
        poisson_deviance("an", guess, 1e-3).alias("poisson_dev_naive_median"),
        F.max("__med").alias("naive_median_value"),
        mae("b", "pb").alias("bonus_mae"),
        F.count(F.lit(1)).alias("n_played"),
    ).withColumn("spearman_inc_bonus", spearman(full, "ai", "pi").scalar())


def evaluate_season(matched: DataFrame, gw: str = "gameweek", pos: str = "fpl_position") -> DataFrame:
    """Errors per gameweek, per position and overall, in one grouping-sets pass.

    Needs pred_pts, actual_pts, actual_minutes. Rows without an appearance
    count in ``matched`` and ``mae_all`` only.
    """
    played = F.col("actual_minutes") > 0
    return (
        matched.groupingSets([[F.col(gw)], [F.col(pos)], []], F.col(gw), F.col(pos))
        .agg(
            F.grouping_id().alias("__set"),
            F.count(F.lit(1)).alias("matched"),
            F.count_if(played).alias("played"),
            mae("actual_pts", "pred_pts", played).alias("mae"),
            mae("actual_pts", "pred_pts").alias("mae_all"),
            F.avg(F.when(played, F.col("pred_pts"))).alias("mean_pred"),
            F.avg(F.when(played, F.col("actual_pts"))).alias("mean_actual"),
            bias("actual_pts", "pred_pts", played).alias("bias"),
        )
        .withColumn("level", F.when(F.col("__set") == 1, gw).when(F.col("__set") == 2, pos).otherwise("overall"))
        .drop("__set")
    )


def metric_rows(wide: DataFrame, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """A wide row of metrics as (section, metric, value) rows."""
    cells = [
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for s, names in sections.items()
        for m in names
        if m in wide.columns
    ]
    return wide.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
