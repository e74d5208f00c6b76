"""Every stage on what its predecessor kept, against a plain version of its operator."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from panelwright.llm import toxicity

from . import brute
from .test_decontaminate import brute as brute_overlaps
from .test_mixing import water
from .test_pii import base, term_spans

SF = "/root/testdata/sf0.01"


def cleaned(text, spans):
    marks = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"]
    out, at = [], 0
    for s, r, e in spans:
        if s >= at:
            out += [text[at:s], marks[r]]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
    toxic, near, bench, private, mixed = kept
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()
    assert {r.doc_id for r in toxic} == {r.doc_id for r in scores if not r.score >= r.threshold}
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in toxic])
    assert {r.doc_id for r in near} == {i for i, (_, c) in groups.items() if c == i} and len(near) < len(toxic)
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    hits = brute_overlaps([(r.doc_id, r.text) for r in near], list(zip(items["item_id"], items["text"])))
    assert {r.doc_id for r in bench} == {r.doc_id for r in near} - {d for d, _ in hits} and hits
    assert all(r.text == rows[r.doc_id].text for r in bench)
    terms = term_spans([r.text for r in bench])
    before = {r.doc_id: r.text for r in bench}
    for r in private:
        spans = terms.get(before[r.doc_id], base(before[r.doc_id]))
        if not any(s[1] == 4 for s in spans):
            assert r.text == cleaned(before[r.doc_id], spans) and r.n_chars == len(r.text)
    assert {r.doc_id for r in private} == set(before)
    sizes, got, most = {}, {}, {}
    for r in private:
        n = len(brute.words(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        most[r.source] = max(most.get(r.source, 0), n)
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(brute.words(r.text))
    for s, want in water(sizes).items():
        assert abs(got.get(s, 0) - want) <= most[s] / 2 + 1 + 0.01 * want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5)]])
def test_odd_documents_pass_all_stages(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted({(r[0], r[1]) for r in rows}, key=str)
    assert cp.STAGES[-1][1](spark, docs, SF).columns == docs.columns


def test_ids_of_copies_go_to_the_texts(spark):
    """No text is shuffled to meet the ids that go, whatever the planner thinks of their size."""
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "another text of few words"), (None, text)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cp.drop_near_duplicates(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.doc_id for r in out.collect()} == {1, 3, None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
