"""Licence texts found by the digest of their canonical form.

Case, punctuation, white space, copyright lines and equivalent spellings do not
count: a text is brought to a canonical form, and the digest of that is looked
up among the digests of known licence texts by a hash join. Whole documents are
looked up, and so is each line of them as a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Notices and short texts of public licences, by identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)

#: Spellings that count as the same word.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("merchantability", "merchantability"),
    ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
)

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright\b|\(c\)|©)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower-case words joined by one space, in common spelling, without copyright lines; empty for null."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, OTHER, " ")), F.lit(" "))
    for odd, common in SPELLINGS:
        if odd != common:
            out = F.replace(out, F.lit(f" {odd} "), F.lit(f" {common} "))
    return F.trim(out)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license): one row per canonical text; if two licences share one, the first name in order."""
    rows = spark.createDataFrame(list(known), "license string, body string")
    return rows.select(F.md5(canonical(F.col("body"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text_col: str = "text", known=KNOWN) -> DataFrame:
    """``docs`` without its text, with ``license`` of the whole text (or null), ``n_license_lines`` and ``licenses``.

    ``licenses`` lists the distinct licences of the whole text and of its
    lines, in order, comma-joined; empty if there are none. Null and empty
    texts have none, and equal texts have equal results. ``known`` is part of
    the code, so its broadcast is as small as it is. Columns of ``docs`` with
    the three names are replaced.
    """
    mine = ("license", "n_license_lines", "licenses", "__key", text_col.lower())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = F.broadcast(known_digests(docs.sparkSession, known))
    parts = docs.select(F.md5(text).alias("__key"), F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("at", "part"))
    hits = parts.select("__key", "at", F.md5(canonical(F.col("part"))).alias("digest")).join(names, "digest")
    hits = hits.select("__key", "at", "license").distinct()
    found = hits.groupBy("__key").agg(
        F.max(F.when(F.col("at") == 0, F.col("license"))).alias("license"),
        F.sum(F.when(F.col("at") > 0, 1).otherwise(0)).alias("n_license_lines"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine], F.md5(text).alias("__key"))
    out = kept.join(found, "__key", "left").drop("__key")
    return out.withColumn("n_license_lines", F.coalesce("n_license_lines", F.lit(0)).cast("long")).withColumn(
        "licenses", F.coalesce("licenses", F.lit(""))
    )
