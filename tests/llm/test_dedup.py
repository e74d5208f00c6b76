"""Near duplicates against all pairs, and the defined results of odd rows."""

import random

import pyarrow.parquet as pq
import pytest

from panelwright.llm.dedup import near_duplicates

from . import brute


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_whole_table_agrees_with_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = result(near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")))
    assert got == brute.near_duplicates(list(zip(t["doc_id"], t["text"])))


def test_chains_whose_ends_do_not_meet(spark):
    """Every step changes a few words: neighbours are linked, the ends are far apart; ids are shuffled."""
    rng = random.Random(5)
    rows, ids = [], list(range(400))
    rng.shuffle(ids)
    for _ in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for step in range(50):
            rows.append((ids.pop(), " ".join(words)))
            words[(step * 7) % 120] = f"w{rng.randrange(10**6)}"
            words[(step * 7 + 60) % 120] = f"w{rng.randrange(10**6)}"
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_duplicates(rows)


def test_copies_of_a_master_that_differ_from_each_other(spark):
    """The hub is the only link between the copies, and its id is not the smallest."""
    rng = random.Random(6)
    master = [f"m{i}" for i in range(100)]
    rows = [(500, " ".join(master))]
    for i in range(120):
        own = list(master)
        for at in rng.sample(range(0, 100, 7), 2):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_duplicates(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "One two", "b"), (5, "one TWO", "b"), (6, "two one", "b"),
        (7, "É a b c d", "b"), (8, "é a b c d", "b"), (None, "one two", "b"), (4, "One two", "b"), (9, "w " * 50_000, None),
        (10, "w " * 7, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp string")
    got = [tuple(r) for r in near_duplicates(df).orderBy("doc_id", "n_shingles").collect()]
    assert got == [
        (None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True),
        (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 9, False),
    ]


@pytest.mark.parametrize("rows", [[], [(1, "only one")]])
def test_small_tables(spark, rows):
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert out.count() == len(rows)
