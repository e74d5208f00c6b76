"""Tables and their incremental maintenance.

Each operator exists as a frame operation (what the new table content is) and,
where it writes, as a writer that replaces only the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelwright.operators.clean import dedupe
from panelwright.semantics import null_safe_join, persisted

# ---- what the content should be ------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Union of both, one row per key, the highest ``seq`` wins."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return dedupe(both, keys, ["__new", seq], keep="last").drop("__new")


def missing_keys(candidates: DataFrame, stored: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Work list: keys not stored yet; ``force`` lists all."""
    wanted = candidates.select(*keys).distinct()
    return wanted if force else wanted.join(stored.select(*keys), list(keys), "left_anti")


def missing_keys_limited(
    candidates: DataFrame, stored: DataFrame, group: str, key: str, limit: int
) -> DataFrame:
    """The first ``limit`` missing keys in group then key order (a batch size).

    A top-k over the whole list: every task keeps its best ``limit`` rows, so
    the budget spills from one group into the next without a global sort.
    """
    todo = candidates.select(group, key).distinct().join(stored.select(key), key, "left_anti")
    return todo.select(group, key).orderBy(group, key).limit(limit)


def per_group(todo: DataFrame, group: str) -> DataFrame:
    return todo.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def append_missing_partitions(cached: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cached rows plus rows of the periods that are not cached."""
    fresh = new.join(cached.select(key).distinct(), key, "left_anti")
    return cached.unionByName(fresh, allowMissingColumns=True)


def replace_partition(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the key values present in ``new``, then insert ``new``."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


# Columns of the prediction log with type and default.
PREDICTION_LOG = {
    "timestamp": ("string", ""),
    "gameweek": ("int", 0),
    "season": ("string", ""),
    "player_id": ("string", ""),
    "player_name": ("string", ""),
    "team": ("string", ""),
    "opponent": ("string", ""),
    "is_home": ("array<int>", None),
    "fpl_position": ("string", "MID"),
    "pred_minutes": ("double", 0.0),
    "pred_exp_goals": ("double", 0.0),
    "pred_exp_assists": ("double", 0.0),
    "pred_cs_prob": ("double", 0.0),
    "pred_goals_against": ("double", 0.0),
    "pred_defcon_prob": ("double", 0.0),
    "pred_yellow_prob": ("double", 0.0),
    "pred_red_prob": ("double", 0.0),
    "pred_exp_saves": ("double", 0.0),
    "pred_bonus": ("double", 0.0),
    "exp_total_pts": ("double", 0.0),
}


def log_projection(df: DataFrame, columns: Mapping[str, tuple[str, object]] = PREDICTION_LOG) -> DataFrame:
    """Typed log columns; absent or null ones take their default."""

    def typed(name: str, kind: str, default):
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name)

    return df.select(*(typed(n, k, d) for n, (k, d) in columns.items()))


def log_run(header: DataFrame, params: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header, results): one result row per model that has params or metrics."""
    results = params.join(metrics, ["run_id", "model"], "full")
    return header, results


def eval_tables(evaluated: DataFrame, season: str) -> tuple[DataFrame, DataFrame]:
    """(summary, per gameweek) rows of a season evaluation."""
    tagged = evaluated.withColumn("season", F.lit(season))
    summary = tagged.where(F.col("level") == "overall").drop("level", "gameweek", "fpl_position")
    per_gw = tagged.where(F.col("level") == "gameweek").drop("level", "fpl_position")
    return summary, per_gw


# ---- writers -------------------------------------------------------------


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite the partitions present in ``df``, leave the others.

    Rows are spread over files by partition value and a size-driven split
    (rebalance), so one heavy partition is not one file.
    """
    (
        df.hint("rebalance", *(F.col(c) for c in by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def write_predictions(df: DataFrame, path: str) -> None:
    write_partitions(df, path, ["season", "gameweek"])


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_run(header: DataFrame, params: DataFrame, metrics: DataFrame, root: str) -> None:
    """Append a run to the tables ``runs`` and ``results`` below ``root``: results first, so that a listed run is whole."""
    rows, results = log_run(header, params, metrics)
    append_rows(results, f"{root}/results")
    append_rows(rows, f"{root}/runs")


def upsert_table(
    spark: SparkSession, path: str, schema: T.StructType, new: DataFrame, keys: Sequence[str], seq: str, by: Sequence[str]
) -> None:
    """Upsert into a partitioned table. A key that moves to another partition leaves its old one, the null partition too.

    The partition values of ``new`` become a filter, so only those partitions
    are scanned whole; elsewhere only the keys are read, to find moved ones.
    Partitions with a moved key are rewritten too; one that loses its last row
    is deleted after the rest is written. Should the job end between the two,
    a repeated call finds the moved keys again. The result is staged in
    shared storage first, as it reads what it will replace.
    """
    new = persisted(new, "batch")
    table = spark.read.schema(schema).parquet(path)
    touched = _partition_filter(new, by)
    # null is not in a list of values, but it is elsewhere
    elsewhere = table.where(~F.coalesce(touched, F.lit(False))).select(*keys, *by, F.col("_metadata.file_path").alias("__file"))
    moved = elsewhere.join(new.select(*keys).distinct(), list(keys), "left_semi")
    moved = persisted(moved, "moved")
    left_behind = _partition_filter(moved, by)
    here = persisted(upsert(table.where(touched), new, keys, seq), "upsert")
    emptied: list[str] = []
    if not moved.isEmpty():
        there = persisted(table.where(left_behind).join(new.select(*keys), list(keys), "left_anti"), "left-behind")
        gone = null_safe_join(moved, there.select(*by).distinct(), list(by), "left_anti")
        folder = F.regexp_replace("__file", "/[^/]*$", "")
        # folders of partitions, as few as the partition values above
        emptied = [r[0] for r in gone.select(folder).distinct().collect()]
        here = here.unionByName(there)
    write_partitions(here, path, by)
    for folder in emptied:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder named by an encoded URI, in the file system Spark reads it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _partition_filter(rows: DataFrame, by: Sequence[str]) -> Column:
    """Predicate on the partition values of ``rows``, as literals that prune the scan; the values of one column at a time are few. Null where a partition value is."""
    values = rows.select(*by).distinct().collect()
    out = F.lit(False)
    for r in values:
        one = F.lit(True)
        for c in by:
            one = one & (F.col(c).isNull() if r[c] is None else F.col(c) == F.lit(r[c]))
        out = out | one
    return out


def clear_table(spark: SparkSession, path: str) -> None:
    """Empty a table, keep its schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
