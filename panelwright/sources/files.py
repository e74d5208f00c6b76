"""Scans of landed files: facts, fixtures, files keyed by their name, payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelwright.operators.clean import dedupe, rename
from panelwright.semantics import nan_to_null

# Raw names of well-known columns.
FACT_NAMES = {
    "minutes_played": "minutes",
    "expected_goals_(xg)": "xg",
    "expected_assists_(xa)": "xa",
    "xg_non-penalty": "npxg",
    "total_shots": "shots",
    "chances_created": "key_passes",
}
FIXTURE_NAMES = {"round": "gameweek"}


def _csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header; lines that do not fit the schema are skipped.

    Column pruning is off in the parser: a line must be judged on all its
    fields, whatever the query selects.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .csv(path)
    )


def newest_snapshot(spark: SparkSession, glob: str, name_pattern: str) -> str | None:
    """Path of the snapshot with the greatest name.

    A listing only: the binary source does not open a file whose content is
    not selected, and one value comes back.
    """
    files = spark.read.format("binaryFile").load(glob)
    prefix = F.regexp_extract("path", f"^(.*/{name_pattern})", 1)
    return files.agg(F.max(F.when(prefix != "", prefix))).first()[0]


def read_facts(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    canonical: str | None = None,
    snapshots: str | None = None,
    pattern: str = r"[^/]+",
) -> DataFrame:
    """Player-match facts: the canonical file if given, else the newest snapshot."""
    target = f"{path}/{canonical}" if canonical else newest_snapshot(spark, f"{path}/{snapshots}", pattern)
    if target is None:
        raise FileNotFoundError(f"no snapshot under {path}")
    return nan_to_null(rename(_csv(spark, target, schema), FACT_NAMES))


def read_fixtures(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Fixtures, one row per match."""
    raw = rename(_csv(spark, path, schema), FIXTURE_NAMES)
    return dedupe(raw, ["match_id"], [c for c in raw.columns if c != "match_id"])


def read_partitioned_by_name(
    spark: SparkSession,
    glob: str,
    schema: T.StructType | str,
    pattern: str,
    names: Mapping[str, str],
    keys: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """All files of a glob, with key columns read from the path.

    ``names``: column -> type, one per group of ``pattern``. ``keys`` keeps
    given values only; the test is on the file path.
    """
    df = _csv(spark, glob, schema).withColumn("__path", F.col("_metadata.file_path"))
    for i, (name, kind) in enumerate(names.items(), start=1):
        df = df.withColumn(name, F.regexp_extract("__path", pattern, i).cast(kind))
    for name, values in (keys or {}).items():
        df = df.where(F.col(name).isin(list(values)))
    return df.drop("__path")


# The nested document of one match. Stat names are open, hence the maps.
_SIDE = "struct<name:string,score:int>"
_LINEUP = "struct<formation:string,coach:struct<id:bigint,name:string>>"
PAYLOAD_SCHEMA = (
    f"struct<general:struct<matchId:bigint,homeTeam:{_SIDE},awayTeam:{_SIDE},matchTimeUTCDate:string>,"
    "content:struct<playerStats:map<string,struct<name:string,teamName:string,usualPosition:int,shirtNumber:string,"
    "stats:array<struct<stats:map<string,struct<stat:struct<value:double>>>>>>>,"
    "shotmap:struct<shots:array<struct<id:bigint,playerId:bigint,playerName:string,teamId:bigint,min:int,x:double,y:double,"
    "expectedGoals:double,expectedGoalsOnTarget:double,eventType:string,shotType:string,situation:string,"
    "isOnTarget:boolean,isBlocked:boolean,isFromInsideBox:boolean>>>,"
    f"lineup:struct<homeTeam:{_LINEUP},awayTeam:{_LINEUP}>>>"
)


def parse_documents(text: DataFrame, schema: str = PAYLOAD_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """Column ``doc`` from JSON text. An unreadable text parses to all nulls and is dropped."""
    # exploded from an array of one: the filter below stays above it, and a text is parsed once, not once for each condition
    docs = text.select(F.explode(F.array(F.from_json("value", schema))).alias("doc"), *keep)
    fields = docs.schema["doc"].dataType.fieldNames()
    known = F.array(*(F.col(f"doc.{f}").isNotNull() for f in fields))
    return docs.where(F.col("doc").isNotNull() & F.array_contains(known, True))


def read_payloads(spark: SparkSession, path: str, schema: str = PAYLOAD_SCHEMA, one_per_file: bool = True) -> DataFrame:
    """Match documents (gzip or plain) as column ``doc``; unreadable ones are dropped.

    ``one_per_file=False`` reads landed files that hold one document per line.
    """
    text = spark.read.text(path, wholetext=one_per_file).withColumn("source_file", F.col("_metadata.file_path"))
    return parse_documents(text, schema, ["source_file"])


def read_runs(spark: SparkSession, glob: str, schema: T.StructType | str, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Catalogue of run directories: their JSON files as one table with the run's name."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(glob)
        .withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    )


def read_run_catalog(
    spark: SparkSession, globs: Mapping[str, str], schemas: Mapping[str, T.StructType | str], pattern: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """Runs with their model results: ``meta`` per run, ``metrics`` and ``params`` per run and model.

    A model that has only one of metrics and params keeps nulls for the other, and a run without models one row.
    """
    meta, metrics, params = (read_runs(spark, globs[k], schemas[k], pattern) for k in ("meta", "metrics", "params"))
    return meta.join(metrics.join(params, ["run", "model"], "full"), "run", "left")
