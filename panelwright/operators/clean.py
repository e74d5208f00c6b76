"""Cleaning, filters and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.text import last_token
from panelwright.semantics import clip


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Names that do not exist are ignored."""
    return df.withColumnsRenamed(dict(mapping))


def coerce_numeric(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """Numbers from text, the default where it cannot be read or the column is absent."""
    present = set(df.columns)
    made = {
        c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")), F.lit(default))
        if c in present
        else F.lit(default)
        for c in cols
    }
    return df.withColumns(made)


def surrogate_key(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    return df if out in df.columns else df.withColumn(out, F.concat_ws("_", *cols))


def trim_lower(c: str) -> Column:
    return F.trim(F.lower(F.col(c).cast("string")))


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], normalise: Sequence[str] = (), keep: str = "first"
) -> DataFrame:
    """One row per key, compared after trim and lower for the ``normalise`` columns.

    The row_number = 1 filter runs before the shuffle as well, so a key with
    very many copies sends one row per input task.
    """
    by = [trim_lower(k) if k in set(normalise) else F.col(k) for k in keys]
    ordering = [F.asc(c) if keep == "first" else F.desc(c) for c in order]
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*ordering))
    return df.withColumn("__rn", rn).where(F.col("__rn") == 1).drop("__rn")


def since(df: DataFrame, col: str, floor) -> DataFrame:
    return df.where(F.col(col) >= F.lit(floor))


def latest_value(df: DataFrame, col: str) -> Column:
    """The maximum of a column as a scalar subquery."""
    return df.agg(F.max(col)).scalar()


def active_entities(df: DataFrame, entity: Sequence[str], season: str) -> DataFrame:
    """All rows of entities that appear in the latest season."""
    recent = df.where(F.col(season) == latest_value(df, season)).select(*entity).distinct()
    return df.join(recent, list(entity), "left_semi")


def resolve_label(
    df: DataFrame, name: str, lookup: DataFrame, code: str, by_code: Mapping[int, str], default: str, out: str
) -> DataFrame:
    """Label from a lookup by full name, then last word, then numeric code, then default.

    Of several labels for one name the smallest counts.
    """
    dim = lookup.groupBy(F.col("name").alias("__k")).agg(F.min("label").alias("__v"))
    src = df.withColumn("__full", F.lower(name)).withColumn("__last", F.lower(last_token(name)))
    a = dim.select(F.col("__k").alias("__full"), F.col("__v").alias("__v1"))
    b = dim.select(F.col("__k").alias("__last"), F.col("__v").alias("__v2"))
    number = F.col(code).try_cast("double").cast("int")
    coded = reduce(lambda acc, kv: acc.when(number == kv[0], kv[1]), by_code.items(), F.when(F.lit(False), ""))
    return (
        src.join(a, "__full", "left")
        .join(b, "__last", "left")
        .select(*df.columns, F.coalesce("__v1", "__v2", coded, F.lit(default)).alias(out))
    )


def one_hot(df: DataFrame, col: str, values: Mapping[int, str], default: int) -> DataFrame:
    code = F.coalesce(F.col(col).try_cast("double").cast("int"), F.lit(default))
    return df.select("*", *((code == v).cast("int").alias(n) for v, n in values.items()))


# Column name parts whose missing values become 0 at the end.
FILL_PATTERNS = ("roll", "lifetime", "last_", "trend", "overperformance", "_x_")
FILL_SPECIAL = {"is_home": 0, "starter_score": 0.5}


def fill_by_pattern(
    df: DataFrame, patterns: Sequence[str] = FILL_PATTERNS, value=0, special: Mapping[str, float] = FILL_SPECIAL
) -> DataFrame:
    """One projection; columns are chosen by name, with special defaults first."""

    def filled(c: str) -> Column:
        if c in special:
            return F.coalesce(F.col(c), F.lit(special[c])).alias(c)
        return F.coalesce(F.col(c), F.lit(value)).alias(c) if any(p in c for p in patterns) else F.col(c)

    return df.select(*(filled(c) for c in df.columns))


def clip_by_pattern(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Upper bound for every column whose name contains a stem; nulls stay."""

    def bounded(c: str) -> Column:
        hits = [cap for stem, cap in caps.items() if stem in c]
        return clip(F.col(c), high=min(hits)).alias(c) if hits else F.col(c)

    return df.select(*(bounded(c) for c in df.columns))


def holdout(
    df: DataFrame,
    season: str | None = None,
    value=None,
    start: tuple[str, int] | None = None,
    fraction: float | None = None,
    periods: Sequence[str] = (),
    order: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(train, test) split in time.

    By season, by season from a first gameweek on, or the last ``fraction`` of
    rows in the order ``periods`` then ``order``.
    """
    if fraction is None:
        test = F.col(season) == value
        if start is not None:
            test = test & (F.col(start[0]) >= start[1])
        test = F.coalesce(test, F.lit(False))  # a row without a season or gameweek trains
        return df.where(~test), df.where(test)
    from panelwright.operators.ordering import global_row_index

    numbered = global_row_index(df, periods, order, "__i", total="__total")
    is_test = F.col("__i") >= F.col("__total") - F.floor(F.col("__total") * fraction)
    return (
        numbered.where(~is_test).drop("__i", "__total"),
        numbered.where(is_test).drop("__i", "__total"),
    )


def availability_filter(df: DataFrame, name: str, avail: DataFrame, out: str = "chance_of_playing") -> DataFrame:
    """Adds the chance of playing and drops those who cannot play.

    ``avail`` holds name (lower case), status, chance. Out, suspended or away
    with chance 0 is dropped; no entry or no chance means 100.
    """
    chance = F.when(F.col("status").isin("i", "s", "u") & (F.col("chance") == 0), 0).otherwise(
        F.coalesce(F.col("chance"), F.lit(100))
    )
    dim = avail.select(F.col("name").alias("__k"), chance.alias("__v")).groupBy("__k").agg(F.min("__v").alias("__v"))
    src = df.withColumn("__full", F.lower(name)).withColumn("__last", F.lower(last_token(name)))
    a = dim.select(F.col("__k").alias("__full"), F.col("__v").alias("__v1"))
    b = dim.select(F.col("__k").alias("__last"), F.col("__v").alias("__v2"))
    out_col = F.coalesce("__v1", "__v2", F.lit(100)).alias(out)
    return src.join(a, "__full", "left").join(b, "__last", "left").select(*df.columns, out_col).where(F.col(out) > 0)


def feature_frame(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model input: absent column 0, null 0, everything double."""
    have = set(df.columns)
    return df.select(
        *keep,
        *(
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f)
            for f in features
        ),
    )
