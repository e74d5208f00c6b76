"""Secrets: candidate strings, and a random forest that removes false positives.

Every long run of token characters is a candidate, and so is every value that
is assigned after a keyword, whatever its length and characters. Its features are its length
and make-up, how often its characters change class, how likely its character
transitions are among the corpus's words, how much of it the corpus's
vocabulary covers, whether it lies in a path or URL or in a test file, and the
words and signs around it. A forest trained on labelled findings scores it.
All of it is DataFrame and Spark ML work.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.semantics import persisted

#: A run of at least 16 characters that keys and tokens are made of.
CANDIDATE = r"[A-Za-z0-9_/+=-]{16,}+"
REACH = 48
#: Words before a secret.
KEYWORDS = r"(?i)(token|secret|passw(or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: What leads to an assigned value: a name with a keyword, and a sign.
LEAD = KEYWORDS + r"[A-Za-z0-9_-]{0,32}+[\"']?\s{0,8}+(:=|=>|[=:])\s{0,8}+"
#: The value after it: up to the closing quote, or without quotes up to white space, a quote, a comma or a semicolon.
ASSIGNED = LEAD + r"(\"[^\"\n]++\"|'[^'\n]++'|(?![{\[(])[^\s\"',;]++(?<!:)(?!\s{0,8}[=:]|[\"']))"
FEATURES = (
    "length", "digits", "uppers", "variety", "changes", "transitions", "coverage", "in_path", "test_path", "keyword", "assigned", "quoted",
)
SPAN = "struct<value:string,start:int>"


def _places(text: Column, pattern: str, lead: str | None = None) -> Column:
    """array<SPAN> of a pattern's matches, in code points; with ``lead`` without that beginning and without quotes."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))

    def span(m: Column, at: Column) -> Column:
        if lead is None:
            return F.struct(m.alias("value"), at.alias("start"))
        begin = F.length(F.regexp_extract(m, f"^{lead}[\"']?", 0))
        value = F.regexp_replace(F.substring(m, begin + 1, F.length(m)), "[\"']$", "")
        return F.struct(value.alias("value"), (at + begin).alias("start"))

    return F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("s")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(a["s"], F.array(span(x["m"], a["at"] + F.length(x["g"])))).alias("s"),
        ),
    )["s"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, value, start, end, before, after): one row per candidate and document row, positions in code points.

    A value that is both a run and assigned is one candidate; a run inside a longer assigned value is one besides it.
    """
    text = F.col("text")
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    none = F.array().cast(f"array<{SPAN}>")
    walk = F.array_distinct(F.concat(_places(text, CANDIDATE), F.when(text.rlike(ASSIGNED), _places(text, ASSIGNED, LEAD)).otherwise(none)))
    spans = own.where(text.rlike(CANDIDATE) | text.rlike(ASSIGNED)).select("doc_id", "path", "text", F.explode(walk).alias("s"))
    start, end = F.col("s.start"), F.col("s.start") + F.length("s.value")
    low = F.greatest(start - REACH, F.lit(0))
    return spans.select(
        "doc_id", "path", F.col("s.value").alias("value"), start.alias("start"), end.alias("end"),
        F.substring(text, low + 1, start - low).alias("before"), F.substring(text, end + 1, F.lit(REACH)).alias("after"),
    )


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.length(value)


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): lower-case words of three to 15 letters of the whole corpus and the documents that have them."""
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![a-z])[a-z]{3,15}(?![a-z])"), F.lit(0))
    return docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def featured(found: DataFrame, words: DataFrame, common: int = 5) -> DataFrame:
    """Candidates with ``FEATURES``. Vocabulary features are worked out once for each distinct value.

    ``transitions`` is the mean log-probability of a character after the one
    before it among the corpus's words; the table of transitions has at most
    27 * 36 rows, so it may be broadcast. ``coverage`` is the share of the
    value's characters in runs of letters that at least ``common`` documents
    hold as words.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    counts = words.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("c"))
    first = counts.groupBy(F.substring("p", 1, 1).alias("a")).agg(F.sum("c").alias("t"))
    chance = counts.join(first, F.substring("p", 1, 1) == F.col("a")).select("p", F.log((F.col("c") + 1) / (F.col("t") + 36)).alias("l"))
    values = persisted(found.select("value").distinct(), "values")
    low = F.lower(F.col("value"))
    steps = values.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(low, i, F.lit(2)))).alias("p"))
    likely = steps.join(F.broadcast(chance), "p", "left").groupBy("value").agg(F.avg(F.coalesce("l", F.lit(-8.0))).alias("transitions"))
    pieces = values.select("value", F.explode(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    held = pieces.join(words.where(F.col("n") >= common), "word").groupBy("value").agg(F.sum(F.length("word")).alias("held"))
    of_value = likely.join(held, "value", "left").select(
        "value", "transitions", (F.coalesce("held", F.lit(0)) / F.length("value")).alias("coverage")
    )
    v, flag = F.col("value"), lambda c: F.coalesce(c, F.lit(False)).cast("double")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "#"), "[A-Z]", "!"), "[a-z]", "?"), "", "")
    changes = (F.length(kinds) - F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))) / F.length(v)
    made = found.select(
        "*",
        F.log(F.length(v).cast("double")).alias("length"),
        _share(v, "0-9").alias("digits"),
        _share(v, "A-Z").alias("uppers"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("variety"),
        (1 - changes).alias("changes"),
        flag(v.contains("/") | F.col("before").rlike(r"[/\\.]$|://\S*$")).alias("in_path"),
        flag(F.col("path").rlike("(?i)(test|example|sample|fixture|mock)")).alias("test_path"),
        flag(F.col("before").rlike(KEYWORDS)).alias("keyword"),
        flag(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"),
    )
    return made.join(of_value, "value")


def train(labelled: DataFrame, rows: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 5) -> PipelineModel | None:
    """Forest on at most ``rows`` labelled findings (FEATURES, label 0 or 1) of each class, chosen by a hash; None if a class is missing."""
    known = labelled.where("label is not null").withColumn("label", F.col("label").cast("double"))
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("value", "start"), "value", "start").limit(rows) for y in (0.0, 1.0)]
    sample = persisted(parts[0].unionByName(parts[1]).select(*FEATURES, "label"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return PipelineModel([assembler, forest.fit(assembler.transform(sample))])


def score(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Candidates with ``score``, the forest's probability of a secret (0.5 without a model)."""
    if model is None:
        return found.withColumn("score", F.lit(0.5))
    out = model.transform(found).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return out.drop("vector", "rawPrediction", "probability", "prediction")


def rule_labels(found: DataFrame) -> DataFrame:
    """Labels where a rule is sure, null elsewhere.

    1: quoted, assigned after a keyword, with digits. 0: letters only and covered or word-like, or part of a path.
    """
    sure = (F.col("quoted") == 1) & (F.col("assigned") == 1) & (F.col("keyword") == 1) & (F.col("digits") > 0.1)
    never = ((F.col("digits") == 0) & (F.col("assigned") == 0)) | (F.col("value").rlike(r"^(.)\1*$"))
    return found.withColumn("label", F.when(sure, 1).when(never, 0).cast("int"))


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", cut: float = 0.5
) -> DataFrame:
    """(doc_id, start, end, value_sha256, score, is_secret, label): all candidates of all rows, scored.

    ``labelled`` may bring findings (doc_id, start, label) to learn from;
    without it the rules' labels serve. Null and empty texts have no
    candidates; repeated rows repeat theirs; a null id stays null. Values are
    given as digests only.
    """
    found = persisted(featured(persisted(candidates(docs, id_col, text_col, path_col), "candidates"), persisted(vocabulary(docs, text_col), "vocabulary")), "featured")
    if labelled is None:
        found = rule_labels(found)
    else:
        own = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("label").cast("int").alias("label"))
        found = found.join(own.dropna().groupBy("doc_id", "start").agg(F.max("label").alias("label")), ["doc_id", "start"], "left")
    out = score(found, train(found))
    return out.select(
        F.col("doc_id").alias(id_col), "start", "end", F.sha2("value", 256).alias("value_sha256"), "score",
        (F.col("score") >= cut).alias("is_secret"), "label",
    )
