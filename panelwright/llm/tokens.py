"""Token ids of public tokenizers, encoded a part at a time and remembered.

A text is cut at every single space between two characters that are no white
space. Neither tokenizer makes a token across such a place: the byte-level
pre-tokenizer always starts a new unit at that space, and no piece of the
other vocabulary has a space after another character (checked when a model is
loaded). So the ids of a text are those of its parts, each encoded whole by
its library, and a part that comes again is looked up. Tokenizers without
these properties encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single space between two characters that are no white space.
_CUT = re.compile(r" (?=\S)(?<=\S )")
#: White space but the space itself.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]

#: Marks that end words.
_MARKS = ".,;:!?"

#: Parts of a generation that are remembered, and the longest one worth remembering; both bound memory, not results.
MEMO_PARTS, MEMO_CHARS = 400_000, 64

#: New parts that one call of the byte-level tokenizer encodes.
RUN = 400

ID = np.dtype("<u4")


def _plain(text: str) -> bool:
    """Whether every space of a text stands between characters that are no white space."""
    if text[:1].isspace() or text[-1:].isspace() or "  " in text:
        return False
    return not any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACE)


def cut(text: str) -> list[str]:
    """Parts of a text; all but the first stand for a space and the part."""
    return text.split(" ") if _plain(text) else _CUT.split(text)


class Memo:
    """Values of parts by ``make``, a function of a list of distinct parts; what was seen lately is looked up.

    Two generations: when the newer one is full it becomes the older one, and
    parts that come again move back to the newer. Frequent parts stay.
    """

    def __init__(self, make: Callable[[list[str]], list], limit: int = MEMO_PARTS):
        self._make, self._limit = make, limit
        self._new: dict[str, object] = {}
        self._old: dict[str, object] = {}

    def __call__(self, parts: list[str]) -> list:
        """The values of distinct parts."""
        out = list(map(self._new.get, parts))
        for i, v in enumerate(out):
            if v is None:
                out[i] = self._old.get(parts[i])
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self._make([parts[i] for i in rest])):
            out[i] = v
        self._new.update((p, v) for p, v in zip(parts, out) if len(p) <= MEMO_CHARS)
        if len(self._new) > self._limit:
            self._old, self._new = self._new, {}
        return out


class Parted:
    """Texts as numbers into their distinct parts: ``first[i]`` and, for ``at[i]:at[i + 1]``, ``rest``."""

    def __init__(self, texts: list[str], whole: Callable[[str], bool] = lambda t: False):
        plain = pa.array(texts, pa.string())
        odd = [i for i, t in enumerate(texts) if whole(t) or not _plain(t)]
        lists = pc.split_pattern(plain, " ") if len(odd) < len(texts) else pa.array([[]] * len(texts), pa.list_(pa.string()))
        if odd:
            # these few are cut one by one and put in place of what the plain cut made of them
            own = pa.array([[texts[i]] if whole(texts[i]) else _CUT.split(texts[i]) for i in odd], pa.list_(pa.string()))
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            lists = pa.concat_arrays([lists, own]).take(pa.array(order))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        numbers = coded.indices.to_numpy()
        self.parts: list[str] = coded.dictionary.to_pylist()
        offsets -= offsets[0]
        self.first = numbers[offsets[:-1]]
        keep = np.ones(len(numbers), bool)
        keep[offsets[:-1]] = False
        self.rest, self.at, self.numbers, self.bounds = numbers[keep], offsets - np.arange(len(offsets)), numbers, offsets


def gathered(numbers: np.ndarray, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``values[n]`` for each number, one after the other, and where each ends."""
    sizes = np.array([len(v) for v in values], np.int64) // ID.itemsize
    flat, start = np.frombuffer(b"".join(values), ID), np.cumsum(sizes) - sizes
    lengths = sizes[numbers]
    stop = np.cumsum(lengths)
    return flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start[numbers] - stop + lengths, lengths)], stop


def packed_between(flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Packed ids between neighbouring ends."""
    data, cuts = flat.tobytes(), (ends * ID.itemsize).tolist()
    return [data[i:j] for i, j in zip([0, *cuts], cuts)]


class ByteLevel:
    """Byte-level BPE from a ``tokenizers`` file. ``special=False`` takes the strings of special tokens as plain text."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.divisible = bool(
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] for t in spec.get("added_tokens", ()))
        )
        self._widths = np.array([len(b) for b in self.token_bytes()], np.int64)
        self._first = Memo(self._whole)
        self._spaced = Memo(self._by_stems)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        return (array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)) if texts else iter(())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return list(self._ids(texts))

    def _by_stems(self, parts: list[str]) -> list[bytes]:
        """Ids of a space and each part. Marks behind a letter or digit are a unit of their own, so the word before them is looked up without them."""
        stems = [p.rstrip(_MARKS) for p in parts]
        marked = [i for i, (p, w) in enumerate(zip(parts, stems)) if len(w) < len(p) and w[-1:].isalnum()]
        others = sorted(set(range(len(parts))).difference(marked))
        out: list[bytes] = [b""] * len(parts)
        for i, ids in zip(others, self.after_spaces([parts[i] for i in others])):
            out[i] = ids
        if marked:
            words, tails = sorted({stems[i] for i in marked}), sorted({parts[i][len(stems[i]) :] for i in marked})
            word, tail = dict(zip(words, self._spaced(words))), dict(zip(tails, self._first(tails)))
            for i in marked:
                out[i] = word[stems[i]] + tail[parts[i][len(stems[i]) :]]
        return out

    def after_spaces(self, parts: list[str]) -> list[bytes]:
        """Ids of a space and each part: runs of parts are encoded together and divided where their bytes end."""
        out: list[bytes | None] = [None] * len(parts)
        even = [i for i, p in enumerate(parts) if p and len(p) <= MEMO_CHARS and not (p[0].isspace() or p[-1].isspace())]
        runs = [even[i : i + RUN] for i in range(0, len(even), RUN)]
        for run, ids in zip(runs, self._ids(["".join(" " + parts[i] for i in run) for run in runs])):
            ends = np.cumsum(self._widths[np.frombuffer(ids, ID)])
            wanted = np.cumsum([len(parts[i].encode()) + 1 for i in run])
            at = np.searchsorted(ends, wanted)
            if len(ends) and at[-1] < len(ends) and (ends[at] == wanted).all():
                stops = ((at + 1) * ID.itemsize).tolist()
                for i, a, b in zip(run, [0, *stops], stops):
                    out[i] = ids[a:b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._ids([" " + parts[i] for i in rest])):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not self.divisible or not texts:
            return self._whole(texts)
        cuts = Parted(texts)
        rest, stops = gathered(cuts.rest, self._spaced(cuts.parts))
        ends = np.concatenate([[0], stops])[cuts.at[1:]]
        heads = dict(zip(distinct := sorted(set(cuts.first.tolist())), self._first([cuts.parts[i] for i in distinct])))
        return [heads[h] + tail for h, tail in zip(cuts.first.tolist(), packed_between(rest, ends))]

    def encode_after_space(self, texts: list[str]) -> list[bytes]:
        """Packed ids of a space and each text; a text that starts with white space is encoded whole."""
        if not self.divisible or not texts:
            return self._whole([" " + t for t in texts])
        cuts = Parted(texts, lambda t: t[:1].isspace())
        flat, stops = gathered(cuts.numbers, self._spaced(cuts.parts))
        return packed_between(flat, stops[cuts.bounds[1:] - 1])

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id: entries of the vocabulary through the byte-level alphabet, added tokens as they stand."""
        alphabet = byte_alphabet()
        added = {i: t.content for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        out = []
        for i in range(self._tokenizer.get_vocab_size(with_added_tokens=True)):
            token = self._tokenizer.id_to_token(i)
            out.append(added[i].encode() if i in added else bytes(alphabet[c] for c in token) if token is not None else b"")
        return out


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces:
    """A ``sentencepiece`` model; it adds a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        joins = any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:]))
        # normalisation must leave a text alone, or parts and whole might differ
        probe = "A  ﬁ ①\té "
        self.divisible = not joins and self._decoded(self._model.encode(probe)) == (" " + probe).encode()
        self._parts = Memo(self.whole)

    def _decoded(self, ids: Sequence[int]) -> bytes:
        return b"".join(_piece_bytes(self._model, i) for i in ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, each encoded in one go."""
        return [array("I", ids).tobytes() for ids in self._model.encode(texts, num_threads=1)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. U+2581 is read as a space: a text with it is no union of parts."""
        if not self.divisible or not texts:
            return self.whole(texts)
        cuts = Parted(texts, lambda t: "▁" in t)
        flat, stops = gathered(cuts.numbers, self._parts(cuts.parts))
        return packed_between(flat, stops[cuts.bounds[1:] - 1])

    def token_bytes(self) -> list[bytes]:
        return [_piece_bytes(self._model, i) for i in range(self._model.get_piece_size())]


def _piece_bytes(model, i: int) -> bytes:
    """A piece in UTF-8, U+2581 as space, a byte piece as its byte."""
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str, **options):
    """A tokenizer, read once for each Python worker."""
    key = (kind, path, *sorted(options.items()))
    if key not in _LOADED:
        _LOADED[key] = kind(path, **options)
    return _LOADED[key]


#: Bytes of text that are encoded at once.
STEP = 4_000_000


def text_steps(batch: pa.RecordBatch, column: int, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text; a longer text makes a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = min(max(at + 1, int(np.searchsorted(upto, upto[at] + limit, "right")) - 1), len(sizes))
        yield batch.slice(at, to - at)
        at = to
