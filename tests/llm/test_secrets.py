"""Candidates against Python, held-out accuracy of the forest, odd rows."""

import random
import re

import pyarrow.parquet as pq

from panelwright.llm import secrets
from panelwright.llm.queries import QUERIES


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    want = {(i, m.start(), m.end()) for i, x in zip(t["doc_id"], t["text"]) for m in re.finditer(r"[A-Za-z0-9_/+=-]{16,}", x or "")}
    sure = {(i, m.start(1)) for i, x in zip(t["doc_id"], t["text"]) for m in re.finditer(r'token = "([0-9a-f]{40})"', x or "")}
    rows = QUERIES["op4_secrets"](spark, sf).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == want and len(rows) == len(want)
    found = {(r.doc_id, r.start) for r in rows if r.is_secret}
    assert sure <= found
    words = [r for r in rows if (r.doc_id, r.start) not in sure and r.label == 0]
    assert all(not r.is_secret for r in words)


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)]
        secret = i % 2 == 0
        value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(32)) if secret else "_".join(rng.sample(["alpha", "beta", "gamma", "delta"], 4))
        lead = rng.choice(["my password: ", "api_key=", "see "]) if secret else rng.choice(["see ", "name = ", "token "])
        text = " ".join(words) + f" {lead}"
        rows.append((i, text + value + " end", "src/main"))
        labels.append((i, len(text), int(secret)))
    return rows, labels


def test_learns_from_labelled_findings(spark):
    rows, labels = corpus(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame(labels[:250], "doc_id long, start int, label int")
    got = {r.doc_id: r.is_secret for r in secrets.scan(docs, known).collect()}
    held = labels[250:]
    assert sum(got[i] == bool(y) for i, _, y in held) / len(held) > 0.95


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "x" * 20, None), (3, "é😀 " + "Ab1" * 8, "b"), (3, "é😀 " + "Ab1" * 8, "b"), (4, "w " * 100_000 + "=" * 20, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, score double")
    got = sorted(((r.doc_id, r.start, r.end) for r in secrets.scan(df).collect()), key=str)
    assert got == sorted([(None, 0, 20), (3, 3, 27), (3, 3, 27), (4, 200_000, 200_020)], key=str)
    assert secrets.scan(df.limit(0)).count() == 0


def test_assigned_values_of_any_length_and_characters(spark):
    texts = {
        'é password = "Tr0ub4dor&3" end': ["Tr0ub4dor&3"], "db_password: 'p@ss.w0rd!2024', x": ["p@ss.w0rd!2024"], "secret_key=s3:cr;et": ["s3:cr"],
        '{"api_key": "a b"}': ["a b"], "token: {password: \"x y\"}": ["x y"], "token = password = 'z1'": ["z1"],
        'token = "0123456789abcdef0123"': ["0123456789abcdef0123"], 'token = "0123456789abcdef.0123456789abcdefg"': ["0123456789abcdef", "0123456789abcdef.0123456789abcdefg", "0123456789abcdefg"],
        "a password of mine": [], "name = 'Tr0ub4dor&3'": [], "AUTH => k": ["k"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in secrets.candidates(df).collect():
        assert list(texts)[r.doc_id][r.start : r.end] == r.value
        got[r.doc_id].append(r.value)
    assert [sorted(v) for v in got.values()] == list(texts.values())
    assert secrets.scan(df).count() == sum(map(len, texts.values()))
