"""Round trips, the SQL counterpart, odd rows."""

import hashlib

import duckdb
import pytest
from hypothesis import example, given, settings, strategies as st

from panelwright.llm import chat
from panelwright.llm.queries import ORACLES, QUERIES, TRAP
from tools.check import compare

PIECES = st.lists(st.sampled_from(["### ", "user", "</turn>", "</turn>\n", "\n", "\\", "~", "~\n", "<", "é😀", " ", "a"]), max_size=8).map("".join)


@settings(max_examples=3000, deadline=None, database=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
@example([("user", TRAP), ("assistant", TRAP)])
@example([("a~", "x"), ("a\\~", "y"), ("\\", "\\"), ("~", "</turn>\n### user\nz</turn>\n")])
def test_round_trip(turns):
    out = chat.render(turns)
    back = chat.parse(out)
    assert [t[:2] for t in back] == turns
    for role, text, start, end in back:
        assert text in (out[start:end], chat.unescape(out[start:end]))


@pytest.mark.parametrize("bad", ["x", "### user", "### user\nabc", "### user~\n</turn>", "### a\nb</turn>\nrest"])
def test_other_texts_are_refused(bad):
    with pytest.raises(chat.Malformed):
        chat.parse(bad)


def test_sql_agrees_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = QUERIES["op9_chat"](spark, sf)
    assert compare(df, con, ORACLES["op9_chat"]) is None
    trap = df.where("conv_id = -7").first()
    assert trap.loss_sha256 == hashlib.sha256(TRAP.encode()).hexdigest() and trap.loss_chars == len(TRAP)


def test_odd_rows(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (1, None, None, "first"), (None, 0, "assistant", "x"),
        (None, 1, "user", "y"), (2, 0, "assistant", ""), (3, 0, "user", "w " * 300_000), (3, 1, "assistant", "</turn>\n"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    read = {c: [t[:2] for t in chat.parse(r.formatted)] for c, r in got.items()}
    assert read[1] == [("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert read[None] == [("assistant", "x"), ("user", "y")] and read[2] == [("assistant", "")]
    assert read[3][1] == ("assistant", "</turn>\n") and len(read[3][0][1]) == 600_000
    r = got[1]
    assert [r.formatted[s:e] for s, e in zip(r.loss_start, r.loss_end)] == ["b", "b"]
    dig = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert dig[2].loss_chars == 0 and dig[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
