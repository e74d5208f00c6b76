"""Top-k, latest state and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(df: DataFrame, n: int, by: str, tie: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The n best rows, ties in key order; columns that do not exist are left out."""
    best = df.orderBy(F.desc_nulls_last(by), *tie).limit(n)
    return best if cols is None else best.select(*(c for c in cols if c in df.columns))


def top_k_per(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Best k rows per group; the row_number filter is applied before the shuffle too."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= k).drop("__rn")


def latest_before(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], cols: Sequence[str], cutoff: Column | None = None
) -> DataFrame:
    """Last known value per column (not per row) and entity before a cut-off."""
    src = df if cutoff is None else df.where(cutoff)
    key = F.struct(*order)
    return src.groupBy(*entity).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in cols))


def best_run(results: DataFrame, model: str = "model", score: str = "score", run: str = "run_id") -> DataFrame:
    """Lowest non-null score per model."""
    return (
        results.where(F.col(score).isNotNull())
        .groupBy(model)
        .agg(F.min_by(run, F.struct(score, run)).alias(run), F.min(score).alias(score))
    )


def lookup_predictions(df: DataFrame, by: str, tie: Sequence[str], **equal) -> DataFrame:
    """Optional equality filters (a column may also take ``like=``), best first."""
    from panelwright.functions.text import contains_ci

    out = df
    for col, value in equal.items():
        if value is None:
            continue
        out = out.where(contains_ci(col[:-9], value) if col.endswith("_contains") else F.col(col) == value)
    return out.orderBy(F.desc(by), *tie)
