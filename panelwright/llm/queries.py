"""Registered queries of the corpus operators, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import alignment, chat, decontaminate, dedup, licences, mixing, neighbours, pages, pii, prefixes, secrets, tokenfile, toxicity
from panelwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@_query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


@_query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|mix'), 1, 4))::INTEGER AS u
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized),
filled AS (
  SELECT *, sum(s) OVER () - 3 * coalesce(sum(s) OVER lower, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER lower, 0) AS share
  FROM weighed WINDOW lower AS (ORDER BY 3.0::DOUBLE * s / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT first(room ORDER BY 3.0::DOUBLE * s / w, w, source)::DOUBLE AS room, first(share ORDER BY 3.0::DOUBLE * s / w, w, source)::DOUBLE AS share
  FROM filled WHERE w * room <= 3 * s * share),
aimed AS (
  SELECT source, s, CASE WHEN w * level.room > 3 * s * level.share THEN (3 * s)::DOUBLE ELSE w::DOUBLE * level.room / level.share END AS target
  FROM weighed, level),
rated AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM aimed),
steps AS (SELECT source, u, sum(sum(size)) OVER (PARTITION BY source ORDER BY u)::BIGINT AS upto FROM docs GROUP BY source, u),
near AS (
  SELECT r.source, first(target - whole * s) AS want, min({'d': abs(upto - (target - whole * s)), 'u': u}) AS b
  FROM steps JOIN rated r ON steps.source IS NOT DISTINCT FROM r.source GROUP BY r.source),
cuts AS (SELECT source, CASE WHEN want > b.d THEN b.u + 1 ELSE 0 END AS cut FROM near)
SELECT docs.doc_id, docs.size, r.s AS source_size, r.target,
       (docs.size * (r.whole + CASE WHEN docs.u < c.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs JOIN rated r ON docs.source IS NOT DISTINCT FROM r.source JOIN cuts c ON docs.source IS NOT DISTINCT FROM c.source
"""


@_query("op3_mixing", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.counted(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


@_query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.found(table(spark, sf_dir, "documents"))
    ranks = F.transform("pii_base", lambda s: s["rank"])
    counts = [
        (F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)
    ]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(pii.span_text(F.col("pii_base")), 256).alias("base_sha256"),
        pii.span_text(F.col("pii_spans")).alias("spans"),
    )


@_query("op8_nearest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 100 == 0)).withColumn("rank", F.col("rank").cast("int"))


#: A conversation whose texts hold control strings of templates; fixed by the contract.
TRAP = r"\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, CASE WHEN contains(text || '</turn>' || chr(10), '</turn>' || chr(10)) AND strpos(text || '</turn>' || chr(10), '</turn>' || chr(10)) <= length(text)
    THEN 14 + length(role) + length(regexp_replace(text, '[\\<~\n]', '..', 'g')) ELSE 13 + length(role) + length(text) END AS n
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""


@_query("op9_chat", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    rows = rows.unionByName(spark.createDataFrame(extra, rows.schema))
    return chat.digests(chat.formatted(rows))


@_query("op10_pages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _licence_sql() -> str:
    canon = "regexp_replace(lower(coalesce(@, '')), '" + licences.COPYRIGHT_LINE + "', '', 'g')"
    canon = "' ' || trim(regexp_replace(" + canon + ", '" + licences.OTHER + "', ' ', 'g')) || ' '"
    for odd, common in licences.SPELLINGS:
        if odd != common:
            canon = f"replace({canon}, ' {odd} ', ' {common} ')"
    canon = f"md5(trim({canon}))"
    quoted = [(n, t.replace("'", "''").replace("\n", "' || chr(10) || '")) for n, t in licences.KNOWN]
    rows = ", ".join(f"('{n}', '{t}')" for n, t in quoted)
    return f"""
WITH known AS (SELECT {canon.replace('@', 'body')} AS digest, min(license) AS license FROM (VALUES {rows}) v(license, body) GROUP BY 1),
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT t, 0 AS pos, t AS part FROM texts
  UNION ALL SELECT t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS pos, unnest(string_split(t, chr(10))) AS part FROM texts),
hits AS (SELECT t, pos, license FROM parts JOIN known ON {canon.replace('@', 'part')} = known.digest),
found AS (
  SELECT t, max(license) FILTER (pos = 0) AS license, count(*) FILTER (pos > 0) AS n_license_lines,
         array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses
  FROM hits GROUP BY t)
SELECT d.doc_id, f.license, coalesce(f.n_license_lines, 0)::BIGINT AS n_license_lines, coalesce(f.licenses, '') AS licenses
FROM documents d LEFT JOIN found f ON coalesce(d.text, '') = f.t
"""


@_query("op2_licences", _licence_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take any path that all executors reach."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.statistics(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


@_query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return tokenfile.summaries(manifest)


#: CRC-32 of a decimal number, bit by bit, as SQL.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lent AS (SELECT *, {_CRC} % 9 AS h FROM own),
built AS (
  SELECT l.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN l.turns[1:0] ELSE b.turns[1:l.h] END, l.turns[l.h + 1:]) AS turns
  FROM lent l LEFT JOIN own b ON b.conv_id = l.conv_id - l.conv_id % 5),
seen AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
keyed AS (
  SELECT conv_id, depth, depth = len(turns) AS ended, sha256(depth::VARCHAR || to_json(turns[1:depth])) AS k,
         CASE WHEN depth > 0 THEN sha256((depth - 1)::VARCHAR || to_json(turns[1:depth - 1])) END AS p,
         CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].t)) ELSE 0 END AS bytes
  FROM seen),
nodes AS (
  SELECT k, any_value(p) AS p, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n, min(conv_id) AS conv_id,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
  FROM keyed GROUP BY k),
kids AS (SELECT p, count(*) AS n FROM nodes WHERE p IS NOT NULL GROUP BY p),
-- a node lies below every prefix of its smallest member that is not deeper
below AS (
  SELECT a.k, sum((d.n - 1) * d.bytes)::BIGINT AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes d LEFT JOIN kids c ON c.p = d.k JOIN keyed a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
       b.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.k = n.p LEFT JOIN kids c ON c.p = n.k JOIN below b ON b.k = n.k
"""


@_query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations")).drop("digest")
