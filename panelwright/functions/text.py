"""Name and text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.semantics import broadcast_if_small


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: Column | str) -> Column:
    """Lower case, spaces to underscores, apostrophes dropped; null becomes ''."""
    low = F.replace(F.replace(F.lower(_c(c)), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))
    return F.coalesce(F.trim(low), F.lit(""))


def _fold_table() -> tuple[str, str]:
    """Accented letters and their base letter, generated from Unicode NFD."""
    src, dst = [], []
    for lo, hi in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for cp in range(lo, hi):
            base = "".join(ch for ch in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(ch))
            if len(base) == 1 and base != chr(cp):
                src.append(chr(cp))
                dst.append(base)
    marks = [chr(cp) for cp in range(0x0300, 0x0370) if unicodedata.combining(chr(cp))]
    # translate() deletes the characters beyond the end of the replacement
    return "".join(src + marks), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_table()


def strip_accents(c: Column | str) -> Column:
    return F.translate(_c(c), _FOLD_FROM, _FOLD_TO)


def fold_accents(c: Column | str) -> Column:
    """Comparison form of a name: no accents, lower case, trimmed."""
    return F.coalesce(F.trim(F.lower(strip_accents(c))), F.lit(""))


def last_token(c: Column | str) -> Column:
    """Last word if there is more than one, else null."""
    words = F.split(F.trim(_c(c)), r"\s+")
    return F.when(F.size(words) > 1, F.element_at(words, -1))


def parse_formation(c: Column | str) -> Column:
    """``'4-2-3-1'`` -> struct(def, mid, fwd) of doubles; nulls if unreadable."""
    nums = F.transform(F.split(F.trim(_c(c)), "-"), lambda p: p.try_cast("int"))
    bad = _c(c).isNull() | (F.size(nums) < 2) | F.exists(nums, lambda n: n.isNull())
    middle = F.aggregate(F.slice(nums, 2, F.greatest(F.size(nums) - 2, F.lit(0))), F.lit(0), lambda a, n: a + n)
    return F.struct(
        F.when(~bad, F.element_at(nums, 1)).cast("double").alias("form_def"),
        F.when(~bad, middle).cast("double").alias("form_mid"),
        F.when(~bad, F.element_at(nums, -1)).cast("double").alias("form_fwd"),
    )


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Key of a pair that does not depend on the order of its parts."""
    return F.array_join(F.array_sort(F.array(_c(a), _c(b))), "_vs_")


def concat_group(col: Column | str, order: Column | str, sep: str = ", ") -> Column:
    """Aggregate: values of a group as text, in row order."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(col).cast("string").alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def snake(c: Column | str) -> Column:
    return F.lower(F.replace(_c(c), F.lit(" "), F.lit("_")))


def parse_ts(c: Column | str) -> Column:
    return F.try_to_timestamp(_c(c))


def contains_ci(c: Column | str, part: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in ``part`` are plain text."""
    return F.contains(F.lower(_c(c)), F.lit(part.lower()))


def canonical(df: DataFrame, col: str, aliases: DataFrame, out: str, norm=norm_key) -> DataFrame:
    """Replace known spellings by their canonical name.

    ``aliases`` has columns ``alias`` (normalised) and ``canonical``; of
    several canonical names for one alias the smallest counts.
    """
    dim = aliases.groupBy(F.col("alias").alias("__alias")).agg(F.min("canonical").alias("__canon"))
    dim = broadcast_if_small(dim)
    keyed = df.withColumn("__key", norm(col))
    joined = keyed.join(dim, F.col("__key") == F.col("__alias"), "left")
    return joined.withColumn(out, F.coalesce("__canon", "__key")).drop("__key", "__alias", "__canon")


# First words of two-word names that stay whole.
KEEP_TWO = ("west", "man", "aston", "crystal", "leeds", "leicester")


def canonical_contains(col: Column | str, rules: Mapping[str, str], keep_two: Sequence[str] = KEEP_TWO) -> Column:
    """Exact rule, else the first rule contained in the name, else its first word.

    Two-word names that start with a word of ``keep_two`` stay whole.
    """
    name = F.trim(F.replace(F.replace(F.trim(F.lower(_c(col))), F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" ")))
    out = None
    tests = [(lambda k: name == k), (lambda k: F.contains(name, F.lit(k)))]
    for test in tests:
        for key, short in rules.items():
            out = F.when(test(key), short) if out is None else out.when(test(key), short)
    words = F.split(name, " ")
    whole = (F.size(words) == 2) & words[0].isin(*keep_two)
    return F.when(_c(col).isNull(), "").otherwise(out.when(whole, name).otherwise(words[0]))
