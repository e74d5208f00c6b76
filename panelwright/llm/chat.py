"""Conversations as one training text, checked by reading the text back.

A turn is rendered as a header line with its role, the text, and a closing
mark. A deterministic parser reads rendered text; a turn whose parse differs
from its source is written again with its control characters escaped, until
what is read equals what was written. Loss spans cover assistant texts.

    ### user
    text</turn>

An escaped turn has ``~`` before the line break of its header; in its role and
text a backslash stands before every backslash, ``<``, ``~`` and line break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD, ESCAPED, CLOSE = "### ", "~\n", "</turn>\n"
#: How a turn may be written, in the order tried.
LEVELS = ("plain", "escaped")
_SPECIAL = re.compile(r"[\\<~\n]")
_PAIR = re.compile(r"\\(.)", re.S)


class Malformed(ValueError):
    """Text that no conversation renders to."""


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def render_turn(role: str, text: str, level: str) -> str:
    if level == "plain":
        return f"{HEAD}{role}\n{text}{CLOSE}"
    return f"{HEAD}{escape(role)}{ESCAPED}{escape(text)}{CLOSE}"


def _line_end(out: str, at: int) -> int:
    """Position of the first line break from ``at`` without a backslash before it that is no pair's second half."""
    while True:
        end = out.find("\n", at)
        if end < 0:
            raise Malformed("header without end")
        slashes = end
        while slashes > at and out[slashes - 1] == "\\":
            slashes -= 1
        if (end - slashes) % 2 == 0:
            return end
        at = end + 1


def parse(out: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit the text as written, in code points."""
    turns, at = [], 0
    while at < len(out):
        if not out.startswith(HEAD, at):
            raise Malformed(f"no header at {at}")
        head = at + len(HEAD)
        first = out.find("\n", head)
        if first < 0:
            raise Malformed("header without end")
        line_end = _line_end(out, head)
        escaped = out[head:line_end].endswith("~") and not (line_end - head > 1 and _odd(out, line_end - 1, head))
        if not escaped:
            line_end = first
        start = line_end + 1
        close = out.find(CLOSE, start)
        if close < 0:
            raise Malformed(f"turn at {at} is not closed")
        role, text = (out[head : line_end - 1], out[start:close]) if escaped else (out[head:line_end], out[start:close])
        turns.append((unescape(role), unescape(text), start, close) if escaped else (role, text, start, close))
        at = close + len(CLOSE)
    return turns


def _odd(out: str, at: int, low: int) -> bool:
    """Whether an odd number of backslashes stands before ``at``."""
    n = at
    while n > low and out[n - 1] == "\\":
        n -= 1
    return (at - n) % 2 == 1


def written(role: str, text: str) -> str:
    """The first way of writing a turn that reads back as itself, alone and before another turn."""
    for level in LEVELS:
        out = render_turn(role, text, level)
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except Malformed:
            continue
    raise Malformed("no level reads back")


def render(turns: list[tuple[str, str]]) -> str:
    """One text for the turns; ``parse`` gives them back."""
    out = "".join(written(*t) for t in turns)
    if [t[:2] for t in parse(out)] != turns:
        raise Malformed("the conversation does not read back")
    return out


def _format(batches: Iterator[pa.RecordBatch], learn: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to one row per conversation; one conversation is held at a time."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))]
    schema = pa.schema(fields)
    ready, size = [], 0

    def close(conv, turns):
        out = render(turns)
        spans = [(s, e) for role, _, s, e in parse(out) if role == learn]
        return conv, len(turns), out, [s for s, _ in spans], [e for _, e in spans]

    def flush():
        cols = list(zip(*ready)) if ready else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(cols, fields)], schema=schema)

    now, turns = None, []
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if turns and conv != now:
                ready.append(close(now, turns))
                size += len(ready[-1][2])
                turns = []
                if size > 8_000_000:
                    yield flush()
                    ready, size = [], 0
            now = conv
            turns.append((role, text))
    if turns:
        ready.append(close(now, turns))
    yield flush()


def formatted(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_start, loss_end): one row per conversation.

    Turns are ordered by number, then role, then text, nulls first; repeated
    rows stay repeated. Null roles and texts are empty. Rows without an id form
    one conversation with a null id. Loss spans are code point ranges of
    ``formatted`` that hold the texts of role ``learn`` as written. A
    conversation is one text, so its rows meet in one task, sorted there; a
    task holds one conversation and a few megabytes of finished ones.
    """
    own = rows.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(turn_col).cast("long").alias("turn"),
    )
    placed = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return placed.mapInArrow(
        lambda it: _format(it, learn), "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
    )


def digests(out: DataFrame, learn: str = "assistant") -> DataFrame:
    """What can be read back from ``formatted``: turns, loss text and their SHA-256, one row per conversation."""
    import hashlib

    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4))):
                turns = parse(text)
                whole, loss, n = hashlib.sha256(), hashlib.sha256(), 0
                by_span = {(s, e): t for _, t, s, e in turns}
                for role, t, _, _ in turns:
                    whole.update(f"{role}\n{t}\n".encode())
                for span in zip(starts, ends):
                    loss.update(by_span[span].encode())
                    n += len(by_span[span])
                rows.append((conv, len(turns), whole.hexdigest(), n, loss.hexdigest(), len(text)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], names=[n for n, _ in kinds])

    return out.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
