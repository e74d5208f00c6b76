"""Held-out accuracy, and the defined results of odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import toxicity as tox
from panelwright.llm.queries import QUERIES

SMALL = tox.Shape(buckets=1 << 10)


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = f"vilest{rng.randrange(10**6)}"  # only the stem is shared
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", int(bad)))
    return rows


def test_unseen_forms_of_a_stem(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels, shape=SMALL)
    fresh = corpus(300, 2)
    got = tox._column_scores(model, pa.array([r[1] for r in fresh])) >= 0.5
    assert (got == np.array([r[3] for r in fresh])).mean() > 0.97


def test_pooling_reads_whole_texts_alone():
    model = tox.fit(["bad word"] * 20 + ["good word"] * 20, np.array([1] * 20 + [0] * 20), SMALL)
    texts = ["bad", "x " * 300_000 + "bad", "", None, "y", "bad"]
    together = tox._column_scores(model, pa.array(texts))
    alone = np.concatenate([tox._column_scores(model, pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)
    assert together[0] == together[5] and together[2] == together[3]
    far = tox._column_scores(model, pa.array(["x " * 200_000, "x " * 200_000 + "bad"]))
    assert far[1] > far[0]


def test_ids_of_the_held_out_fold_are_never_learnt(spark):
    rows = [(i, "alpha" if zlib.crc32(str(i).encode()) % 5 == 0 else "beta", "en") for i in range(200)]
    labels = [(i, 1 if t == "alpha" else i % 2) for i, t, _ in rows]
    args = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = spark.createDataFrame([(i, 1 - y if t == "alpha" else y) for (i, y), (_, t, _) in zip(labels, rows)], "doc_id long, toxic int")
    one, two = tox.train(*args, shape=SMALL), tox.train(args[0], flipped, shape=SMALL)
    assert np.array_equal(one.table, two.table) and one.intercept == two.intercept


@pytest.mark.parametrize("known", [[], [(1, 1)], [(1, None), (None, 1)], [(1, 0), (1, 1), (2, 0), (3, 0)]])
def test_few_labels_and_odd_rows(spark, known):
    docs = spark.createDataFrame(
        [(1, "a b", "en", 5.0, "x"), (1, "a b", "en", 5.0, "x"), (None, None, None, None, None), (3, "", "", 0.0, "y")],
        "doc_id long, text string, lang string, score double, toxic string",
    )
    model = tox.train(docs, spark.createDataFrame(known, "doc_id long, toxic int"), shape=SMALL)
    out = tox.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "threshold", "toxic"]
    rows = out.collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.toxic is not None for r in rows)
    assert tox.score(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id")
    rows = got.where("held_out").select("score", "predicted", "label").collect()
    s = sorted((r.score, r.label) for r in rows)
    pos = sum(y for _, y in s)
    auc = (sum(i + 1 for i, (_, y) in enumerate(s) if y) - pos * (pos + 1) / 2) / (pos * (len(s) - pos))
    assert auc > 0.95
    assert sum(r.predicted == r.label for r in rows) / len(rows) > 0.95


def test_last_word_of_the_last_text_is_pooled():
    model = tox.fit(["bad word"] * 20 + ["good word"] * 20, np.array([1] * 20 + [0] * 20), SMALL)
    for text in ("word bad", "good bad", "one two bad"):
        alone = tox._column_scores(model, pa.array([text]))[0]
        assert alone == tox._column_scores(model, pa.array([text, "word"]))[0]
        words = tox.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        rows = tox._rows(words, SMALL)
        assert np.allclose(tox._pooled(model, rows, words.first), tox._pooled(model, rows, words.first, where=True)[0])


def test_long_texts_are_learnt_whole(spark):
    rows = [(i, "x " * 50_001 + "vile" if i % 2 else "x good", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = tox.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), shape=SMALL, least_steps=40)
    low, high = tox._column_scores(model, pa.array(["x good", "x vile"]))
    assert low < 0.5 < high


def test_every_labelled_row_is_learnt_in_shards(spark):
    """Averaged over shards the model learns as one, and a stem that only a few rows have is learnt too."""
    rows = [(i, (t if i % 60 else f"w1 w2 hideous{i}"), lang, y) for i, t, lang, y in corpus(1500, 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels, shape=SMALL, shard_rows=300)
    fresh = corpus(300, 2)
    got = tox._column_scores(model, pa.array([r[1] for r in fresh])) >= 0.5
    assert (got == np.array([r[3] for r in fresh])).mean() > 0.95
    assert (tox._column_scores(model, pa.array(["w5 hideous77 w9", "hideous"])) > 0.5).all()
    again = tox.train(docs, labels, shape=SMALL, shard_rows=300)
    assert np.array_equal(model.table, again.table) and model.thresholds == again.thresholds


def test_cuts_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(lang, round(rng.random() ** (1 if y else 2), 2), y) for lang, n in (("a", 400), ("b", 90), ("c", 30)) for y in (int(rng.random() < 0.3) for _ in range(n))]
    rows += [("only", 0.5, 1)] * 40

    def plain(part):
        marks = sorted({s for s, _ in part}, reverse=True)
        def f1(c):
            hits = sum(y for s, y in part if s >= c)
            return 2 * hits / (sum(s >= c for s, _ in part) + sum(y for _, y in part))
        i = max(range(len(marks)), key=lambda i: (f1(marks[i]), marks[i]))
        return (marks[i] + (marks[i + 1] if i + 1 < len(marks) else 0)) / 2

    got = tox.best_cuts(spark.createDataFrame(rows, "lang string, score double, y int"), 25)
    want = {lang: plain([(s, y) for l, s, y in rows if l == lang]) for lang in ("a", "b")}
    positive = {lang: sum(y for l, _, y in rows if l == lang) for lang in ("a", "b", "c")}
    assert got == pytest.approx({k: v for k, v in want.items() if positive[k] >= 25})


def test_one_step_of_all_shards_comes_to_the_driver(spark, monkeypatch):
    rows = corpus(600, 3)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    kind, came = type(docs), []
    collect = kind.collect

    def spied(df):
        got = collect(df)
        came.append(sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))))
        return got

    monkeypatch.setattr(kind, "collect", spied)
    model = tox.train(docs, labels, shape=SMALL, shard_rows=100)
    assert max(came) == 8 * len(tox._flat(model))


def test_steps_hold_little_beside_the_weights():
    """The table, its gradient and two moments; not a copy for each sum of the optimiser."""
    import tracemalloc

    start = tox._fresh(tox.Shape(buckets=1 << 17), np.random.default_rng(1))
    tox._column_scores(start, pa.array(["powers of the hash's base"]))
    tracemalloc.start()
    tox.fit(["bad word", "good word"] * 8, np.array([1, 0] * 8), rounds=2, least_steps=0, start=start, share=0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * start.table.nbytes


def test_examples_keep_bucket_numbers_and_no_text():
    texts = pa.array(["one two three", None, "", "four " * 1000])
    known = tox.Examples(tox.Shape())
    known.add(texts.slice(0, 2), [1, 0])
    known.add(texts.slice(2), [0, 1])
    assert [len(r) for r in known.rows] == [3, 0, 0, 1000] and known.toxic == [1, 0, 0, 1]
    assert all(r.dtype == np.uint16 and r.shape[1] == 5 for r in known.rows)
    assert tox.Examples(tox.Shape(buckets=1 << 17)).shape.buckets > 1 << 16
    wide = tox.Examples(tox.Shape(buckets=1 << 17))
    wide.add(texts, [0] * 4)
    assert wide.rows[3].dtype == np.int32


def test_buffers_that_are_used_again_change_no_value():
    model, space = tox._fresh(SMALL, np.random.default_rng(3)), {}
    for text in ("a b c d e f", "", "x", "a b c"):
        words = tox.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        rows = tox._rows(words, SMALL)
        assert np.array_equal(tox._pooled(model, rows, words.first, space=space), tox._pooled(model, rows, words.first))
