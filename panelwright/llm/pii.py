"""Personal data: patterns, and terms that give protected values away.

Base spans come from four patterns. Every value found is a protected entity.
Information theory then asks which other terms disclose it: over the documents
of the whole corpus, a word's pointwise mutual information with the entity, as
a share of the entity's information content, says how much of the entity the
word reveals. Words above the disclosure threshold get a span of kind ``term``
wherever they stand, in every document; sanitising removes the strongest and
generalises the others.

Only DataFrame functions are used. Word counts are combined before they travel;
texts are joined with their terms by a digest, without a shuffle of the texts
if the places of terms are few enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.semantics import BROADCAST_BYTES, broadcast_if_small, persisted, row_bytes

#: Fixed by the contract, in listed order. Possessive and anchored forms find the same spans without backtracking.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: A cheap test that a text can hold any span at all.
MAYBE = r"[0-9@]"
LETTERS = r"\p{L}[\p{L}\p{Nd}'_-]*"
SPAN = "struct<start:int,rank:int,end:int>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn test of a digit string of any length."""
    backwards = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(backwards, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, rank: int, valid) -> Column:
    """array<SPAN> of a pattern's matches that pass ``valid``, in code points.

    The text between matches and the matches themselves alternate, so a running sum of their lengths gives each start.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))
    walk = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.when(
                valid(x["m"]),
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["g"])).alias("start"),
                            F.lit(rank).alias("rank"),
                            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return walk["spans"]


def base_spans(text: Column) -> Column:
    """Base spans of a text by start, then kind: array<struct<start, rank, end>>; none for null."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = [
        F.when(F.regexp_count(text, F.lit(PATTERNS[k])) > 0, _located(text, PATTERNS[k], i, lambda c, k=k: _valid(k, c))).otherwise(none)
        for i, k in enumerate(KINDS)
    ]
    return F.when(text.rlike(MAYBE), F.array_sort(F.concat(*parts))).otherwise(none)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def _words(text: Column) -> Column:
    """Distinct words of a text in lower case; none for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), F.lower))


def _outside(text: Column, spans: Column) -> Column:
    """The text with a space for each stretch that base spans cover."""
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))))
            .otherwise(acc["parts"])
            .alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], " "), F.lit(" "), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return walk


def _term_places(text: Column, shares: Column) -> Column:
    """array<struct<start, end, share>> of the words of a text that the map ``shares`` holds."""
    gaps = F.split(text, LETTERS, -1)
    found = F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))
    both = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")),
        lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.try_element_at(shares, F.lower(x["m"])).alias("share")),
    )
    return F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,share:double>>").alias("t")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.when(
                x["share"].isNotNull(),
                F.concat(acc["t"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end"), x["share"].alias("share")))),
            )
            .otherwise(acc["t"])
            .alias("t"),
        ),
    )["t"]


def _holders(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts that hold an entity, one row per row that has it: text and base spans."""
    own = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("spans", base_spans(F.col("text")))
    return own.where(F.size("spans") > 0)


def _key(text: Column) -> Column:
    return F.md5(text)


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, least: int = 3) -> DataFrame:
    """(entity, term, share): the pairs that disclose.

    ``share`` is the pointwise mutual information of both over documents
    divided by the information content of the entity. A term occurs with an
    entity in a document if it stands anywhere in its text outside the base
    spans. Kept are pairs seen in at least ``least`` documents with a share of
    at least ``threshold``. Document counts are over all rows.
    """
    held = persisted(_holders(docs, text_col), "holders")
    values = F.transform("spans", lambda b: F.lower(F.substring(F.col("text"), b["start"] + 1, b["end"] - b["start"])))
    of_text = held.select(_key(F.col("text")).alias("key"), F.array_distinct(values).alias("entities"))
    of_text = of_text.groupBy("key").agg(F.first("entities").alias("entities"), F.count("*").alias("rows"))
    of_text = persisted(of_text.select("key", "rows", F.explode("entities").alias("entity")), "entities")
    total = max(docs.count(), 1)
    n = F.lit(float(total))
    # a pair is in no more documents than its entity, so rarer entities have no pair
    counts = of_text.groupBy("entity").agg(F.sum("rows").alias("n_entity")).where((F.col("n_entity") >= least) & (F.col("n_entity") < n))
    mine = persisted(of_text.join(counts, "entity"), "shared_entities")
    keys = mine.select("key").distinct()
    words = docs.select(F.explode(_words(F.col(text_col).cast("string"))).alias("term"))
    of_term = words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= least)
    # the text is used and dropped in the same projection; only words travel
    texts = held.select(_key(F.col("text")).alias("key"), "text", "spans").join(keys, "key", "left_semi").dropDuplicates(["key"])
    beside = texts.select("key", F.explode(_words(_outside(F.col("text"), F.col("spans")))).alias("term")).join(of_term, "term")
    # a share above the threshold is out of reach of a term in more documents than this, even if all of the entity's hold it
    reach = n * F.pow(F.col("n_entity") / n, F.lit(float(threshold))) * (1 + 1e-9)
    together = mine.join(beside, "key").where(F.col("n_term") <= reach)
    together = together.groupBy("entity", "n_entity", "term", "n_term").agg(F.sum("rows").alias("both")).where(F.col("both") >= least)
    share = F.log2(F.col("both") * n / (F.col("n_entity") * F.col("n_term"))) / F.log2(n / F.col("n_entity"))
    return persisted(together.select("entity", "term", share.alias("share")).where(F.col("share") >= threshold), "pairs")


def found(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, remove: float = 0.95, least: int = 3) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of struct<start, rank, end>, and ``pii_strong``: starts of terms to remove.

    Ranks number email, ip, card, phone, term. A disclosing term has a span at
    every occurrence in every document that does not overlap a base span.
    Positions are code points, end exclusive. Null and empty texts have no
    spans; equal texts have equal spans. Columns of ``docs`` with those names
    are replaced.
    """
    mine = ("pii_base", "pii_spans", "pii_strong")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine])
    pairs = disclosing_terms(docs, text_col, threshold, least)
    text = F.col(text_col).cast("string")
    based = kept.withColumn("pii_base", base_spans(text))
    if pairs.isEmpty():
        return based.select("*", F.col("pii_base").alias("pii_spans"), F.array().cast("array<int>").alias("pii_strong"))
    terms = persisted(pairs.groupBy("term").agg(F.max("share").alias("share")), "terms")
    words = docs.select(_key(text).alias("__k"), F.explode(_words(text)).alias("term"))
    hits = words.join(broadcast_if_small(terms), "term").groupBy("__k", "term").agg(F.first("share").alias("share"))
    hits = persisted(hits, "hits")
    per_text = hits.groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("__t"))
    if hits.count() * row_bytes(hits.schema) <= BROADCAST_BYTES:
        per_text = F.broadcast(per_text)
    rest = based.withColumn("__k", _key(text)).join(per_text, "__k", "left")
    clear = lambda t: ~F.exists("pii_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    places = F.when(F.col("__t").isNotNull(), F.filter(_term_places(text, F.col("__t")), clear))
    rest = rest.withColumn("__p", F.coalesce(places, F.array().cast("array<struct<start:int,end:int,share:double>>")))
    as_span = lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), t["end"].alias("end"))
    rest = rest.withColumn("pii_spans", F.array_sort(F.concat("pii_base", F.transform("__p", as_span))))
    rest = rest.withColumn("pii_strong", F.transform(F.filter("__p", lambda t: t["share"] >= remove), lambda t: t["start"]))
    return rest.drop("__k", "__t", "__p")


#: What stands in for each kind.
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the spans in the text replaced: base spans by their kind, terms by ``[TERM]`` or, if strong, by nothing.

    All other columns and rows stay, and texts without spans stay as they are.
    Spans that overlap an earlier one fall together with it.
    """
    out = found(docs, text_col, **options)
    text = F.col(text_col).cast("string")
    masks = F.array(*[F.lit(m) for m in MASKS])

    def replaced(s: Column) -> Column:
        strong = (s["rank"] == len(KINDS)) & F.array_contains("pii_strong", s["start"])
        return F.when(strong, F.lit("")).otherwise(F.element_at(masks, s["rank"] + 1))

    walk = F.aggregate(
        "pii_spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), replaced(s))),
            )
            .otherwise(acc["parts"])
            .alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size("pii_spans") > 0, walk).otherwise(text)
    return out.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("pii_base", "pii_spans", "pii_strong")])
