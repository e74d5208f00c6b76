"""The prefix trie against a plain one, its minimal perfect hash, odd rows, the SQL counterpart."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from panelwright.llm import prefixes
from panelwright.llm.queries import ORACLES, QUERIES
from tools.check import compare

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in by.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built = own.get(base, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own_saving = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = own_saving + sum(saved[x] for x in kids[k])
    return sorted(
        (
            len(k), min(members[k]), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest(),
        )
        for k in members
    )


def collected(df):
    cols = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("shard_turns", [1, 7, 2_000_000])
def test_against_plain(spark, shard_turns):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 120), 10_000, -3, -7]:
        # a third of the conversations are one conversation
        same = c % 3 == 0
        for t in range(6 if same else rng.randint(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "one é" if same else rng.choice(["a", "bb", "", "ü"])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(prefixes.trie(df, shard_turns)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "w"), (None, 1, "user", "lost"),
        (2, 5, "", ""), (2, 5, None, None), (7, 1, "a", "b" * 500_000), (3, 0, "ab", "c"), (8, 0, "a", "bc"),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", path string, digest int")
    assert collected(prefixes.trie(df)) == plain(rows)
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_left_without_turns_are_at_the_root(spark):
    c = next(i for i in range(1, 1000) if i % 5 and prefixes.borrowed(i) > 0)
    rows = [(c, 0, "user", "gone")]
    assert collected(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows) == [
        (0, c, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
    ]


def test_slots():
    rng = np.random.default_rng(3)
    keys = np.zeros(20_000, prefixes.DIGEST)
    keys["hi"], keys["lo"] = rng.integers(0, 2**63, 20_000), rng.integers(0, 2**63, 20_000)
    table = prefixes.Slots(keys)
    assert sorted(table.of(keys).tolist()) == list(range(20_000))
    others = keys.copy()
    others["lo"] += 1
    assert (table.of(others) == -1).all()
    assert len(prefixes.Slots(keys[:0]).of(keys[:0])) == 0


def test_accumulate():
    parent, depth = np.array([-1, 0, 0, 1, 3]), np.array([0, 1, 1, 2, 3])
    values = np.array([1, 10, 100, 1000, 10_000])
    prefixes.accumulate(parent, depth, values)
    assert values.tolist() == [11_111, 11_010, 100, 11_000, 10_000]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_prefix_trie"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(got) == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert compare(got, con, ORACLES["op13_prefix_trie"]) is None
