"""Benchmark overlaps against a scan of every alignment, and odd rows."""

import random
import re

import pyarrow.parquet as pq
import pytest

from panelwright.llm import decontaminate as dec
from panelwright.llm.queries import QUERIES


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items, least=13, percent=80):
    """Every alignment of every document and item, without seeds: {(doc, item): most agreeing words}."""
    out = {}
    penalty = max(1, -(-percent // (100 - percent)))
    toks = [(i, tokens(t)) for i, t in items]
    for d, text in docs:
        doc = tokens(text)
        where = {}
        for p, w in enumerate(doc):
            where.setdefault(w, []).append(p)
        for i, it in toks:
            if len(it) < dec.LEAST_WORDS:
                continue
            need = max(dec.LEAST_WORDS, min(least, -(-len(it) * percent // 100)))
            hits = {}
            for q, w in enumerate(it):
                for p in where.get(w, ()):
                    hits[p - q] = hits.get(p - q, 0) + 1
            for diag, n in hits.items():
                if n < need:
                    continue
                best = run = same = 0
                for q in range(len(it)):
                    if 0 <= diag + q < len(doc):
                        eq = doc[diag + q] == it[q]
                        run, same = (run + 1, same + 1) if eq else (run - penalty, same)
                        if run < 0:
                            run = same = 0
                        if run > best:
                            best, kept = run, same
                if best and kept >= need:
                    out[d, i] = max(out.get((d, i), 0), kept)
    return out


def got(df):
    return {(r[0], r.item_id): r.n_equal for r in df.collect()}


def test_whole_tables_agree_with_all_alignments(spark):
    sf = "/root/testdata/sf0.01"
    cols = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pydict()
    want = brute(list(zip(cols["doc_id"], cols["text"])), list(zip(items["item_id"], items["text"])))
    have = got(QUERIES["op6_decontaminate"](spark, sf))
    assert have == want and len(want) > 0


def test_replaced_words(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"b{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    docs = []
    for i, text in items:
        w = text.split()
        for at in range(rng.randrange(8), 40, 9):
            w[at] = "other"
        docs.append((i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(50)] + w + ["tail"] * 9)))
    docs += [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(200))) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = got(dec.overlaps(frame, bench))
    assert set(whole) == {(i, i) for i, _ in items}
    assert got(dec.overlaps(frame, bench, block_words=100)) == whole
    clean = dec.decontaminated(frame, bench, block_words=100)
    assert sorted(r.doc_id for r in clean.collect()) == list(range(1000, 1050))


def test_odd_rows(spark):
    text = "One two, three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, text), (1, text), (2, "too short"), (3, None), (None, text), (4, "")], "item_id long, text string")
    rows = [(1, text.upper(), "a"), (1, text.upper(), "a"), (None, "x " + text, "b"), (3, None, None), (4, "", "c"), (5, "y " * 200_000 + text, "d"), (6, "too short", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    found = sorted(dec.overlaps(docs, bench).collect(), key=str)
    assert [(r.doc_id, r.item_id, r.first_word, r.n_words, r.n_equal) for r in found] == [
        (1, 1, 0, 10, 10), (1, 1, 0, 10, 10), (5, 1, 200_000, 10, 10), (None, 1, 1, 10, 10)
    ]
    clean = dec.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 6]


@pytest.mark.parametrize("empty", ["docs", "bench"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty == "docs" else [(1, "a " * 20)], "doc_id long, text string")
    bench = spark.createDataFrame([] if empty == "bench" else [(1, "a " * 20)], "item_id long, text string")
    assert dec.overlaps(docs, bench).count() == 0
    assert dec.decontaminated(docs, bench).count() == docs.count()


def most_equal(doc, item, least, percent=80):
    """Most equal words of any stretch of any alignment that has ``least`` of them and ``percent`` % of its words equal, 0 if none."""
    best = 0
    for diag in range(-len(item), len(doc)):
        equal = [doc[diag + q] == item[q] for q in range(len(item)) if 0 <= diag + q < len(doc)]
        for i in range(len(equal)):
            same = 0
            for j in range(i, len(equal)):
                same += equal[j]
                if same >= least and 100 * same >= percent * (j - i + 1):
                    best = max(best, same)
    return best


def test_share_of_equal_words_counts_over_the_whole_overlap(spark):
    rng = random.Random(11)
    items = [(i, [f"b{rng.randrange(10**6)}" for _ in range(100)]) for i in range(4)]
    docs = []
    for i, w in items:
        for kind in range(3):
            gone = range(2 + i % 2, 100, 5) if kind == 0 else rng.sample(range(100), 20) if kind == 1 else rng.sample(range(100), 45)
            own = [f"y{rng.randrange(10**6)}" if at in gone else x for at, x in enumerate(w)]
            docs.append((10 * i + kind, [f"x{rng.randrange(10**6)}" for _ in range(7)] + own + ["tail"] * 5))
    want = {(d, i): most_equal(t, w, 13) for d, t in docs for i, w in items if d // 10 == i}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    assert got(dec.overlaps(frame, bench)) == {k: n for k, n in want.items() if n}
    assert all(want[10 * i, i] == 80 for i, _ in items)


def test_texts_are_lowered_in_bounded_steps(monkeypatch):
    """No copy of a whole batch; rows keep their numbers, whatever lower case does to their length."""
    import numpy as np
    import pyarrow as pa

    from panelwright.llm.common import STEP_BYTES

    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    words = dec.Words(np.frombuffer(item.encode(), np.uint8), np.array([0, len(item)]), dec.NON_WORD).hash
    texts = ["İ" * 40_000 if i % 3 else "filler " * 10_000 for i in range(40)] + [None, "", item.upper()]
    texts[20] = "İ " * 1000 + item.title()
    block, lowered, sizes = dec._make_block([7], [words]), dec._lowered, []

    def seen(column):
        sizes.append(sum(len(t.encode()) for t in column.to_pylist() if t))
        return lowered(column)

    monkeypatch.setattr(dec, "_lowered", seen)
    got = [r[:2] for r in dec._found(block, pa.array(texts), 13, 80)]
    assert got == [(20, 7), (42, 7)]
    assert max(sizes) <= STEP_BYTES < sum(sizes) / 4
