"""Mixing sources to target weights by repeating documents.

Words are summed per source; a source's repetition rate is its target over its
size. Each document is emitted floor(rate) times, plus one more copy with a
probability equal to the fraction. The draw is a 16-bit hash of the document
against a cut of its source. The cut is the fraction measured in words: the
hash value below which that fraction of the source's words lies, so that a few
long documents cannot pull a source away from its target, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.common import word_count
from panelwright.semantics import broadcast_if_small, persisted

#: Hash values a draw can take.
DRAWS = 65536


def draw(id_col: Column, text: Column) -> Column:
    """0 to 65535, from the document alone."""
    own = F.concat(F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")))), F.lit("|mix"))
    return F.conv(F.substring(F.md5(own), 1, 4), 16, 10).cast("int")


def _placed(sizes: DataFrame) -> DataFrame:
    """Adds ``place``, the zero-based rank of a source in code point order, null last.

    Sources are dealt out by range and numbered within a part; only one count per part is seen as a whole.
    """
    parts = persisted(
        sizes.where("source is not null").repartitionByRange("source").withColumn("part", F.spark_partition_id()), "parts"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    named = parts.join(starts, "part").select("source", "source_size", (F.col("start") + rank - 1).cast("long").alias("place"))
    last = sizes.where("source is null").select("source", "source_size", F.lit(parts.count()).cast("long").alias("place"))
    return named.unionByName(last)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target for (source, source_size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the total size; what would lift a target above ``most`` times its source
    goes to the others by weight, until none is above. Only sums reach the
    driver: the level per weight rises until the set of full sources is stable.
    """
    placed = _placed(sizes)
    turn = F.array(*[F.lit(w) for w in weights])
    placed = persisted(
        placed.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).cast("long")), "sources"
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    room, share = total, placed.agg(F.sum("weight")).first()[0] or 1
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of word counts pass 64 bits
    while True:
        full = wide(F.col("weight")) * wide(F.lit(room)) > wide(most * F.col("source_size")) * wide(F.lit(share))
        capped, left = placed.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        after = (total - most * (capped or 0), left or 1)
        if after == (room, share):
            break
        room, share = after
    level = F.col("weight").cast("double") * F.lit(float(room)) / F.lit(float(share))
    return placed.select(
        "source", "source_size", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(level).alias("target")
    )


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies of each document) and cut (draws below get one more)."""
    own = docs.select(
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        draw(F.col(id_col), F.col(text_col)).alias("u"),
    )
    spread = persisted(own.groupBy("source", "u").agg(F.sum("size").alias("size")), "draws")
    rates = targets(spread.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = rates.withColumn("whole", F.floor("rate").cast("long"))
    rates = persisted(rates.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "rates")
    by_draw = Window.partitionBy("source").orderBy("u")
    upto = spread.withColumn("upto", F.sum("size").over(by_draw))
    near = upto.join(rates.select(F.col("source").alias("s"), "want"), F.col("source").eqNullSafe(F.col("s")))
    # taking all draws up to u gives `upto` words more: the cut whose sum is nearest to what is wanted, none being an option
    best = near.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("want")), "u")).alias("b"), F.first("want").alias("want")
    )
    cut = F.when(F.col("want") > F.col("b.col1"), F.col("b.u") + 1).otherwise(0)
    return rates.join(best.select(F.col("source").alias("s"), cut.alias("cut")), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", "whole", "cut"
    )


def counted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, rates: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``mix_size`` (words), ``mix_copies``, ``mix_source_size`` and ``mix_target``.

    Sizes count runs of non-space characters; null and empty texts have none,
    and a source without words gets no copies. A null source is a source of its
    own. Rows with equal ids share their draw; a null id draws by its text.
    Columns of ``docs`` with those names are replaced. Empty in, empty out.
    """
    rates = plan(docs, id_col, text_col, source_col, weights, most) if rates is None else rates
    mine = ("mix_size", "mix_copies", "mix_source_size", "mix_target")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine])
    named = rates.select(
        F.col("source").alias("__s"), F.col("whole").alias("__w"), F.col("cut").alias("__c"),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
    )
    extra = F.when(draw(F.col(id_col), F.col(text_col)) < F.col("__c"), 1).otherwise(0)
    # one row per source: broadcast if that is small, so that a hot source's documents stay where they are
    named = broadcast_if_small(persisted(named, "named"))
    return (
        kept.join(named, F.col(source_col).cast("string").eqNullSafe(F.col("__s")))
        .withColumn("mix_size", word_count(F.col(text_col)))
        .withColumn("mix_copies", (F.col("__w") + extra).cast("long"))
        .drop("__s", "__w", "__c")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    out = counted(docs, **options)
    return (
        out.where("mix_copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
