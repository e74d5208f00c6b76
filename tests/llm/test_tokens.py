"""Token ids by parts against whole texts; token files against plain reading; alignments against all pairs of tokens."""

import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from panelwright.llm import alignment, tokenfile, tokens
from panelwright.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"

#: Texts that tokenizers may treat oddly; the special token stands alone and inside words.
ODD = [
    "", " ", "  a b", "a  b c", "a\n b", "a \nb", "x　 y", "▁x y▁ z", "foo<|endoftext|> bar <|endoftext|>baz", "don't we'll  '  s",
    "a\x1c b", "\x85 b c", "é f", "1 2  3 4\t 5 ", "\n", "<s> </s> <0x41>", "中文 字", "ends ", "a" * 5000, "x y " * 3000, "x\x00y z", "é ​ z",
]
PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", ".", "?!", "1,", "_.", "²;", "'s", "é", "▁", "\t", "1", "<|endoftext|>", "字", " "]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def coders():
    return tokens.ByteLevel(A), tokens.ByteLevel(A, special=False), tokens.Pieces(B), Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)


def whole(ids):
    return np.array(ids, tokens.ID).tobytes()


@settings(max_examples=500, deadline=None, database=None)
@given(st.lists(PIECES, max_size=6))
@example(ODD)
def test_parts_are_the_whole(coders, texts):
    a, plain_a, b, library_a, library_b = coders
    library_a.encode_special_tokens = False
    assert a.encode(texts) == [whole(library_a.encode(t, add_special_tokens=False).ids) for t in texts]
    library_a.encode_special_tokens = True
    assert plain_a.encode_after_space(texts) == [whole(library_a.encode(" " + t, add_special_tokens=False).ids) for t in texts]
    assert b.encode(texts) == [whole(library_b.encode(t)) for t in texts]


def test_memory_of_parts_changes_nothing(coders, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PARTS", 5)
    texts = [f"a b c {i} {i % 3} long{'x' * i}" for i in range(40)]
    fresh = tokens.ByteLevel(A)
    assert [fresh.encode([t])[0] for t in texts] == coders[0].encode(texts)


# ---- token files ---------------------------------------------------------


def test_file_round_trip(tmp_path):
    path = str(tmp_path / "t.zst")
    docs = [(3, [1, 2, 0]), (3, []), (None, [7]), (9, list(range(1000)))]
    w = tokenfile.Writer(path, frame_ids=64)
    for d, ids in docs:
        w.add(d, whole(ids))
    w.close()
    r = tokenfile.Reader(path)
    for i, (d, ids) in enumerate(docs):
        assert b"".join(r.frames(i)) == whole(ids) and (None if r.nulls[i] else r.doc_ids[i]) == d
    assert r.starts.tolist() == [0, 3, 3, 4, 1004]
    assert len(list(r.frames(3))) == 16
    # any zstandard reader takes the file as one stream
    raw = open(path, "rb").read()
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert stream == b"".join(whole(ids) for _, ids in docs)
    # a changed frame is found, the others are read all the same
    at = int(r._at[3]) + 3
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(bytes([raw[at] ^ 255]))
    again = tokenfile.Reader(path)
    assert b"".join(again.frames(0)) == whole([1, 2, 0])
    with pytest.raises((tokenfile.Damaged, zstandard.ZstdError)):
        b"".join(again.frames(3))
    with open(path, "r+b") as f:
        f.truncate(len(raw) - 1)
    with pytest.raises(tokenfile.Damaged):
        tokenfile.Reader(path)


def test_token_files_of_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op12_token_files"](spark, SF).collect()}
    library = Tokenizer.from_file(A)
    at = 0
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for doc_id, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_fetch_and_odd_rows(spark):
    rows = [(5, "a b"), (5, "c"), (None, "none"), (1, None), (1, ""), (2, "x " * 50_000), (7, "last <|endoftext|>")] + [(50, "same")] * 3
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, path string")
    library = Tokenizer.from_file(A)
    want = sorted((d is not None, d or 0, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    manifest = tokenfile.write(docs, A, file_bytes=40)
    assert manifest.count() > 3
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)
    summed = sorted(tuple(r) for r in tokenfile.summaries(manifest).select("start", "n_tokens").collect())
    assert [s for s, _ in summed] == np.concatenate([[0], np.cumsum([n for _, n in summed])[:-1]]).tolist()
    asked = spark.createDataFrame([(5,), (2,), (2,), (99,), (None,), (50,), (1,)], "doc_id long")
    found = sorted((True, r.doc_id, tuple(r.ids)) for r in tokenfile.fetch(manifest, asked).collect())
    assert found == [w for w in want if w[0] and w[1] in (5, 2, 50, 1)]
    empty = tokenfile.write(docs.limit(0), A)
    assert empty.count() == 0 and tokenfile.summaries(empty).count() == 0 and tokenfile.fetch(empty, asked).count() == 0


# ---- alignment -----------------------------------------------------------


def plain_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = tokens.byte_alphabet()
    counts, found = Counter(), []
    for t in texts:
        t = t or ""
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            found.append(None)
            continue
        ends = [{}, {}]
        for places, parts in zip(ends, (bytes_a, bytes_b)):
            e = 0
            for i, p in enumerate(parts):
                e += len(p)
                places[e] = i
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, ids_a[i : m + 1])) + "|" + ",".join(map(str, ids_b[j : n + 1])))
            links.append((ids_a[m], ids_b[n]))
            i, j = m + 1, n + 1
        counts.update(links)
        found.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None
        else (*f[:3], len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4])
        for f in found
    ]


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), plain_alignment([r.text for r in rows])))
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in QUERIES["op11_alignment"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_odd_rows(spark, monkeypatch, small):
    if small:  # many chunks, and pairs joined without a broadcast
        monkeypatch.setattr(alignment, "BROADCAST_BYTES", 0)
    texts = [*ODD, None, "same text twice", "same text twice"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in alignment.statistics(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts)
    assert alignment.statistics(docs.limit(0), A, B).count() == 0


def test_aligned_groups_cover_both_streams(spark):
    docs = spark.createDataFrame([(1, "some invented words, thloriv 12.5"), (2, None), (3, "▁x")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.aligned(docs, A, B).collect()}
    r = got[1]
    one = alignment.Aligner(A, B)
    assert r.a_ends[-1] == len(r.a_ids) and r.b_ends[-1] == len(r.b_ids) and len(r.a_ends) == len(r.b_ends) > 5
    for i, j, k, m in zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends):
        assert b"".join(one.bytes_a[x] for x in r.a_ids[i:j]) == b"".join(one.bytes_b[x] for x in r.b_ids[k:m])
    assert got[2].a_ids == got[3].a_ids == []


def test_chunks_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    texts = [f"word{i} of the {i % 7} line" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(alignment, "CHUNK_WINDOWS", 20)
    monkeypatch.setattr(alignment, "text_steps", lambda b, c, limit: tokens.text_steps(b, c, 100))
    monkeypatch.setattr(alignment.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    rows = pa.Table.from_batches(list(alignment._chunks(iter([batch]), A, B))).to_pylist()
    chunks = {r["chunk"] for r in rows}
    assert len(chunks) > 3
    for c in chunks:
        named: Counter = Counter()
        for r in rows:
            if r["chunk"] == c and r["doc_id"] is not None:
                named.update(dict(zip(r["names"], r["times"])))
        assert {r["name"]: r["n"] for r in rows if r["chunk"] == c and r["name"] is not None} == named


def test_windows_stay_and_packed_sums_move(spark):
    docs = spark.createDataFrame([(i, f"word{i} of the {i % 7} line") for i in range(60)], "doc_id long, text string")
    plan = alignment.statistics(docs, A, B)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Aggregate" not in plan and "counts#" in plan


def test_packed_sums_of_split_windows():
    """A window's links in several batches, chunks in turn: the documents get whole sums."""
    import pyarrow as pa

    rows = [(5, 0, 3, 1), (5, 0, 2, 0), (5, 1, 7, 1), (6, 0, 10, 1), (5, 1, 1, 1), (6, 2, 4, 0), (5, 2, 9, 0)]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    made = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=["of_chunk", "name", "links", "best"])
    packed = pa.Table.from_batches(list(alignment._packed(iter([made(rows[:3]), made(rows[3:]), made(rows[:1]).slice(1)]))))
    assert len(packed) == 3
    own = packed.filter(pa.compute.equal(packed["of_chunk"], 5))
    ints = pa.list_(pa.int32())
    docs = {c: [1, 2] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": ["x", "y"]}
    docs = pa.table(docs | {"names": pa.array([[0, 1], []], ints), "times": pa.array([[2, 1], []], ints)})
    got = alignment._summed(docs, own).to_pylist()
    assert [(r["n_best"], r["count_sum"]) for r in got] == [(4, 18), (0, 0)]


def test_a_chunk_gives_rows_for_pairs_not_for_windows(monkeypatch):
    """Many different words of few tokens: rows grow with the linked pairs, and every pair stands once with its count."""
    import itertools

    import pyarrow as pa

    parts = ["an", "er", "ing", "ol", "is", "at", "en", "or"]
    texts = [" ".join("".join(p) for p in itertools.islice(itertools.product(parts, repeat=5), i, None, 8)) for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(alignment.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    rows = pa.Table.from_batches(list(alignment._chunks(iter([batch]), A, B))).to_pylist()
    docs, named = [r for r in rows if r["doc_id"] is not None], [r for r in rows if r["name"] is not None]
    windows = len({w for t in texts for w in t.split(" ")})
    assert len(named) * 4 < windows and sum(r["n"] for r in named) == sum(r["n_links"] for r in docs) > windows
    one = alignment.Aligner(A, B)
    links: Counter = Counter()
    for a, b in one.encode(texts):
        a, b = np.frombuffer(a, tokens.ID), np.frombuffer(b, tokens.ID)
        links.update((int(a[i]), int(b[j])) for i, j in zip(*one.shared_ends(a, b)))
    assert Counter({(r["a_id"], r["b_id"]): r["n"] for r in named}) == links and len(named) == len(links)
