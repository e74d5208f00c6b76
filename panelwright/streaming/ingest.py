"""Incremental maintenance as a stream over a landing folder.

Landed match documents are picked up once (the checkpoint remembers files)
and upserted batch by batch. A replayed batch gives the same table, because
the upsert is keyed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from panelwright.operators.clean import dedupe
from panelwright.sources.files import parse_documents
from panelwright.sources.sinks import upsert_table, write_partitions


def landed_payloads(spark: SparkSession, landing: str, one_per_file: bool = True, files_per_batch: int = 1000) -> DataFrame:
    text = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing, wholetext=one_per_file)
    return parse_documents(text)


def maintain_table(
    stream: DataFrame,
    flatten: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    seq: str,
    by: Sequence[str],
) -> StreamingQuery:
    """Upsert every micro-batch of documents into a partitioned table, then stop when all are read."""

    def apply(batch: DataFrame, _epoch: int) -> None:
        rows = flatten(batch)
        spark = batch.sparkSession
        try:
            schema = spark.read.parquet(path).schema
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            # first batch: the table does not exist yet
            write_partitions(dedupe(rows, keys, [seq], keep="last"), path, by)
            return
        upsert_table(spark, path, schema, rows, keys, seq, by)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
