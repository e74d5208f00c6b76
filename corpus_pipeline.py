"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, in the
columns of ``docs``. Every stage's output is written and read again, so a lost
executor costs at most one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import decontaminate, dedup, mixing, pii, toxicity
from panelwright.llm.common import table
from panelwright.semantics import broadcast_if_small, persisted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("toxic")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without an id stay; of rows with equal ids one stays."""
    marks = persisted(dedup.near_duplicates(docs), "marks")
    # ids are broadcast after a count, so that no text moves
    gone = broadcast_if_small(marks.where(~F.col("kept")).select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = marks.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; ``n_chars`` follows the new text."""
    out = pii.sanitised(docs)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: The classifier, the shingle links and the disclosing terms are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that come out of all stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return docs
