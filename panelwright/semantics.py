"""Decisions every operator shares: null policy, order keys, scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Largest table, in bytes by its schema, that an operator may mark for broadcast after counting it.
BROADCAST_BYTES = 64_000_000


def as_list(value: str | Iterable[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Turn NaN into null once, at load: avg() skips null but propagates NaN."""
    floating = {n for n, t in df.dtypes if t in ("double", "float")}
    wanted = floating if cols is None else floating & set(cols)
    return df.select(
        *(F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in wanted else F.col(c) for c in df.columns)
    )


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows whose key is null: keyed aggregates ignore them."""
    return df.dropna(subset=list(keys))


def clip(c: Column, low=None, high=None) -> Column:
    """Bounded value that stays null when the input is null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def fill0(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def row_bytes(schema: T.StructType) -> int:
    """Bytes of a row in memory, with 64 for every value of open length."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    fixed = {"bigint", "double", "timestamp", "timestamp_ntz"}
    return 16 + sum(max(8, width.get(t, 8 if t in fixed else 64)) for t in (f.dataType.simpleString() for f in schema.fields))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a dimension for broadcast only after checking its size: rows times the width of its schema.

    The count sends one number per partition. A bigger table is returned as
    it is and the join shuffles both sides.
    """
    return F.broadcast(df) if df.count() * row_bytes(df.schema) <= limit else df


def null_safe_join(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null meets null; the columns of ``df``, then those of ``other`` without its keys."""
    renamed = other.select(
        *(F.col(k).alias(f"__ns{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in set(keys))
    )
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__ns{i}")) for i, k in enumerate(keys)))
    return df.join(renamed, on, how).drop(*(f"__ns{i}" for i in range(len(keys))))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared space the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets one below its warehouse folder;
    on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_dir(spark, label) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
