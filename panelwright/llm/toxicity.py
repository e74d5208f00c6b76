"""Toxicity by a convolutional text classifier.

A word's vector is the mean of hashed embedding rows: one for the whole word
and one for each of a few leading byte runs, so that unseen forms of a stem
share strength. Filters of several widths slide over the whole text, each is
max-pooled, and a logistic unit reads the pooled values. Training reads every
labelled row: rows are dealt to shards of a bounded size, tasks take gradient
steps in numpy over their shards, and the weights are averaged after each
pass. Scoring runs in the tasks that read the documents. Decision thresholds
are calibrated for each language on all rows kept out of the gradient steps;
the score itself sees the text only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelwright.llm.common import U64, Words, memory_returned, mix64, steps
from panelwright.semantics import broadcast_if_small, persisted

OWN = ("score", "threshold", "toxic")
#: Bytes of text scored at once.
SCORE_BYTES = 500_000


@dataclass
class Shape:
    buckets: int = 1 << 15
    dim: int = 16
    filters: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    prefixes: tuple[int, ...] = (4, 5, 6, 7)


@dataclass
class Model:
    """Weights; ``thresholds`` maps a language to its cut, others use ``default``."""

    shape: Shape
    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    shift: float = 0.0
    default: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)


def _rows(words: Words, shape: Shape) -> np.ndarray:
    """Embedding rows of every word: (words, 1 + prefixes), in as few bytes as bucket numbers need, column by column."""
    mask = U64(shape.buckets - 1)
    out = np.empty((1 + len(shape.prefixes), len(words.hash)), np.uint16 if shape.buckets <= 1 << 16 else np.int32)
    out[0] = words.hash & mask
    for salt, n in enumerate(shape.prefixes, 1):
        part = words.of(words.start, np.minimum(words.start + n, words.end))
        out[salt] = mix64(part + U64(salt)) & mask
    return out.T


def _padded(first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and of text starts once every text is followed by ``pad`` empty places."""
    sizes = np.diff(first)
    starts = first[:-1] + pad * np.arange(len(sizes))
    return np.arange(first[-1]) + pad * np.repeat(np.arange(len(sizes)), sizes), starts


def _held(space: dict[str, np.ndarray], name: str, n: int, width: int) -> np.ndarray:
    """``n`` rows of a buffer that later calls use again, as fresh memory costs more than the sums in it."""
    if name not in space or len(space[name]) < n:
        space[name] = np.empty((n + n // 4, width), np.float32)
    return space[name][:n]


def _pooled(model: Model, rows: np.ndarray, first: np.ndarray, where: bool = False, space: dict[str, np.ndarray] | None = None):
    """Pooled filter values (texts, all filters), before bias; with ``where`` also the places they came from.

    With ``space`` buffers are taken from there; what came back with ``where`` holds until the next call.
    """
    shape, pad, space = model.shape, max(model.shape.widths) - 1, {} if space is None else space
    places, starts = _padded(first, pad)
    sizes = np.diff(first)
    n = first[-1] + pad * len(sizes)
    at_rows = np.zeros((rows.shape[1], n + 1), np.int64)
    at_rows[:, places] = rows.T
    x, part = _held(space, "x", n + 1, shape.dim), _held(space, "part", n + 1, shape.dim)
    model.table.take(at_rows[0], axis=0, out=x, mode="clip")
    for c in range(1, rows.shape[1]):
        x += model.table.take(at_rows[c], axis=0, out=part, mode="clip")
    x *= np.float32(1 / rows.shape[1])
    empty = np.ones(n + 1, bool)
    empty[places] = False
    x[empty] = 0
    some = np.flatnonzero(sizes)
    values, at = [], []
    n -= pad
    y, part = _held(space, "y", n + 1, shape.filters), _held(space, "product", n, shape.filters)
    y[n] = -np.inf  # lets the last text end inside
    filters = np.arange(shape.filters)
    for width, kernel in zip(shape.widths, model.kernels):
        np.matmul(x[:n], kernel[0], out=y[:n])
        for j in range(1, width):
            y[:n] += np.matmul(x[j : n + j], kernel[j], out=part)
        best = np.zeros((len(sizes), shape.filters), np.float32)
        place = np.zeros((len(sizes), shape.filters), np.int64)
        if where:
            for d in some:
                seg = y[starts[d] : starts[d] + sizes[d]]
                place[d] = seg.argmax(0)
                best[d] = seg[place[d], filters]
                place[d] += starts[d]
        elif len(some):
            edges = np.empty(2 * len(some), np.int64)
            edges[::2], edges[1::2] = starts[some], starts[some] + sizes[some]
            best[some] = np.maximum.reduceat(y, edges, axis=0)[::2] if pad else np.maximum.reduceat(y, starts[some], axis=0)
        values.append(best)
        at.append(place)
    return (np.concatenate(values, 1), at, x, places) if where else np.concatenate(values, 1)


def _logit(model: Model, pooled: np.ndarray) -> np.ndarray:
    return np.maximum(pooled + model.bias, 0) @ model.out + model.intercept + model.shift


def score_words(model: Model, words: Words, space: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Score of each text, 0 to 1, to six digits; a text without words has the score of all-zero filters."""
    z = _logit(model, _pooled(model, _rows(words, model.shape), words.first, space=space))
    return np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 6)


def _column_scores(model: Model, column: pa.Array) -> np.ndarray:
    space: dict[str, np.ndarray] = {}
    got = [score_words(model, Words(data, offsets), space) for _, _, data, offsets in steps(column, SCORE_BYTES)]
    return np.concatenate(got) if got else np.zeros(0)


def _fresh(shape: Shape, rng: np.random.Generator) -> Model:
    total = shape.filters * len(shape.widths)
    return Model(
        shape,
        rng.normal(0, 0.1, (shape.buckets, shape.dim)).astype(np.float32),
        [rng.normal(0, 0.3, (w, shape.dim, shape.filters)).astype(np.float32) for w in shape.widths],
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, total).astype(np.float32),
        0.0,
    )


def _base_rate(model: Model, n: int, positive: int) -> Model:
    """The model that knows nothing but the share of toxic rows."""
    model.out[:] = 0
    model.intercept = float(np.log((positive + 0.5) / (n - positive + 0.5))) if n else 0.0
    return model


def _passes(n: int, rounds: int, batch: int, least_steps: int) -> int:
    return max(rounds, -(-least_steps // -(-n // batch)))


class Examples:
    """Labelled texts as embedding rows, in the order they were added; the texts themselves are not kept."""

    def __init__(self, shape: Shape):
        self.shape, self.rows, self.toxic = shape, [], []

    def add(self, texts: pa.Array, toxic: list | np.ndarray) -> None:
        for _, _, data, offsets in steps(texts, SCORE_BYTES):
            w = Words(data, offsets)
            own = _rows(w, self.shape)
            self.rows += [own[w.first[d] : w.first[d + 1]] for d in range(len(offsets) - 1)]
        self.toxic.extend(toxic)

    def __len__(self) -> int:
        return len(self.rows)


def fit(
    texts: list[str], toxic: np.ndarray, shape: Shape | None = None, rounds: int = 6, batch: int = 64, rate: float = 0.015, seed: int = 7,
    least_steps: int = 240, start: Model | None = None, share: float | None = None,
) -> Model:
    """Adam on the logistic loss, both classes weighing alike, for ``rounds`` passes or ``least_steps`` steps if those are more.

    Texts may be empty; one class alone gives its base rate. With ``start``
    the steps go on from that model, whatever classes the texts have;
    ``share`` is the share of toxic rows that sets the weights.
    """
    known = Examples(start.shape if start else shape or Shape())
    known.add(pa.array(texts, pa.string()), toxic)
    return fit_examples(known, rounds, batch, rate, seed, least_steps, start, share)


def fit_examples(
    known: Examples, rounds: int = 6, batch: int = 64, rate: float = 0.015, seed: int = 7, least_steps: int = 240, start: Model | None = None,
    share: float | None = None,
) -> Model:
    """What ``fit`` does, from texts that have been read already."""
    rng = np.random.default_rng(seed)
    shape, rows, toxic = known.shape, known.rows, np.asarray(known.toxic, np.float32)
    if start is None:
        model = _fresh(shape, rng)
        if not len(toxic) or toxic.min() == toxic.max():
            return _base_rate(model, len(toxic), float(toxic.sum()))
    else:
        model = Model(start.shape, start.table.copy(), [k.copy() for k in start.kernels], start.bias.copy(), start.out.copy(), start.intercept)
    share = float(toxic.mean()) if share is None else share
    sizes = np.array([len(r) for r in rows], np.int64)
    weight = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    state: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        """One step, in place and by runs that stay in the processor's cache; ``grad`` is used up."""
        if name not in state:
            state[name] = [np.zeros_like(value), np.zeros_like(value)]
        flat = [x.reshape(-1) for x in (value, grad, *state[name])]
        for lo in range(0, value.size, len(one)):
            w, g, m, v = (x[lo : lo + len(one)] for x in flat)
            a, b = one[: len(w)], two[: len(w)]
            np.multiply(g, g, out=a)
            a -= v
            a *= 0.001
            v += a
            g -= m
            g *= 0.1
            m += g
            np.divide(v, 1 - 0.999**step, out=a)
            np.sqrt(a, out=a)
            a += 1e-7
            np.divide(m, 1 - 0.9**step, out=b)
            b *= rate
            b /= a
            w -= b

    one, two = np.empty(1 << 14, np.float32), np.empty(1 << 14, np.float32)
    space: dict[str, np.ndarray] = {}
    intercept = np.array([model.intercept], np.float32)
    table_grad, dims = np.empty_like(model.table), np.arange(shape.dim)
    for _ in range(_passes(len(toxic), rounds, batch, least_steps)):
        order = rng.permutation(len(toxic))
        for lo in range(0, len(order), batch):
            step += 1
            pick = order[lo : lo + batch]
            first = np.concatenate([[0], np.cumsum(sizes[pick])])
            own = np.concatenate([rows[i].T for i in pick], axis=1).T
            pooled, at, x, places = _pooled(model, own, first, where=True, space=space)
            hidden = np.maximum(pooled + model.bias, 0)
            z = hidden @ model.out + intercept[0]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[pick]) * weight[pick] / len(pick)
            back = err[:, None] * model.out * (hidden > 0) * (np.diff(first) > 0)[:, None]
            word_at = np.full(len(x), -1, np.int64)
            word_at[places] = np.arange(len(places))
            dx: list[tuple[np.ndarray, np.ndarray]] = []
            for i, (width, kernel) in enumerate(zip(shape.widths, model.kernels)):
                g = back[:, i * shape.filters : (i + 1) * shape.filters]
                grad = np.zeros_like(kernel)
                for j in range(width):
                    near = x[at[i] + j]
                    grad[j] = np.einsum("dfe,df->ef", near, g)
                    dx.append(((at[i] + j).ravel(), (g[:, :, None] * kernel[j].T[None]).reshape(-1, shape.dim)))
                adam(f"k{i}", kernel, grad)
            place = word_at[np.concatenate([p for p, _ in dx])]
            flow = np.concatenate([v for _, v in dx])[place >= 0]
            place = place[place >= 0]
            table_grad[:] = 0
            flow = (flow / own.shape[1]).ravel()
            for c in range(own.shape[1]):  # flat: numpy adds at places of one axis several times faster
                np.add.at(table_grad.reshape(-1), (own[place, c].astype(np.int64)[:, None] * shape.dim + dims).ravel(), flow)
            adam("table", model.table, table_grad)
            adam("bias", model.bias, back.sum(0))
            adam("out", model.out, hidden.T @ err)
            adam("intercept", intercept, np.array([err.sum()], np.float32))
    model.intercept = float(intercept[0])
    return model


def best_cuts(scored: DataFrame, least: int) -> dict[str, float]:
    """For each ``lang`` the cut of ``score`` with the best F1 for ``y``, in the middle of the gap between the scores around it.

    Languages with fewer than ``least`` rows of y = 1, or no others, have
    none. Equal scores, which have six digits, are one row before they move.
    """
    counts = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t"))
    own, order = Window.partitionBy("lang"), F.desc("score")
    upto = own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hits, rows, total = F.sum("t").over(upto), F.sum("n").over(upto), F.sum("t").over(own)
    below = F.coalesce(F.lead("score").over(own.orderBy(order)), F.lit(0.0))
    ranked = counts.select(
        "lang", "score", (2 * hits / (rows + total)).alias("f1"), ((F.col("score") + below) / 2).alias("cut"), total.alias("t"), F.sum("n").over(own).alias("n")
    )
    best = ranked.where((F.col("t") >= least) & (F.col("t") < F.col("n"))).groupBy("lang").agg(F.max_by("cut", F.struct("f1", "score")).alias("cut"))
    return {r.lang: r.cut for r in best.collect()}


def _flat(model: Model) -> np.ndarray:
    parts = [model.table, *model.kernels, model.bias, model.out, [model.intercept]]
    return np.concatenate([np.asarray(p, np.float32).ravel() for p in parts])


def _moved(model: Model, step: np.ndarray) -> Model:
    """``model`` with ``step``, in the order of ``_flat``, added to its weights."""
    new, at = [], 0
    for p in (model.table, *model.kernels, model.bias, model.out):
        new.append((p + step[at : at + p.size].reshape(p.shape)).astype(np.float32))
        at += p.size
    return Model(model.shape, new[0], new[1:-2], new[-2], new[-1], model.intercept + float(step[at]))


_STEP = "shard int, rows long, step binary, seen binary"


def _one_pass(grown: DataFrame, model: Model, share: float, seed: int, rounds: int, least_steps: int, shards: int = 1) -> Model:
    """Steps of every shard from ``model`` on, averaged by rows; an embedding row over the shards that moved it."""
    size = model.table.size

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stepped(shard: int, known: Examples) -> pa.RecordBatch:
            new = fit_examples(known, rounds, seed=seed + 1009 * shard, least_steps=least_steps, start=model, share=share)
            n = len(known)
            step = _flat(new) - _flat(model)
            seen = np.any(step[:size].reshape(model.table.shape) != 0, axis=1)
            cols = [pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([step.tobytes()], pa.binary()), pa.array([np.where(seen, float(n), 0.0).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "rows", "step", "seen"])

        now, known = None, Examples(model.shape)
        for b in batches:
            shards = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if shards[lo] != now and len(known):
                    yield stepped(now, known)
                    known = Examples(model.shape)
                now = int(shards[lo])
                known.add(b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo).to_pylist())
        if len(known):
            yield stepped(now, known)
        del known
        memory_returned()

    def added(steps_of: pa.Table) -> pa.Table:
        """One row: steps weighted by rows, and the rows behind them."""
        total, seen, rows = 0.0, 0.0, 0
        for i in np.lexsort([steps_of["rows"].to_numpy(), steps_of["shard"].to_numpy()]):
            n = steps_of["rows"][i].as_py()
            total = total + n * np.frombuffer(steps_of["step"][i].as_py(), np.float32).astype(np.float64)
            seen = seen + np.frombuffer(steps_of["seen"][i].as_py(), np.float64)
            rows += n
        shard = min(steps_of["shard"].to_pylist())
        return pa.table([pa.array([shard], pa.int32()), pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["shard", "rows", "step", "seen"])

    dim = model.shape.dim

    def averaged(sums: pa.Table) -> pa.Table:
        """One row: the step of all shards."""
        order = np.argsort(sums["shard"].to_numpy())
        total, seen = (sum(np.frombuffer(sums[c][int(i)].as_py(), np.float64) for i in order) for c in ("step", "seen"))
        over = np.full(total.size, float(sum(sums["rows"].to_pylist())))
        over[:size] = np.repeat(np.maximum(seen, 1), dim)
        return pa.table([pa.array([(total / over).tobytes()], pa.binary())], names=["step"])

    steps_made = grown.select("shard", "text", "y").mapInArrow(learn, _STEP)
    # a task adds up about as many steps as there are sums, the root of the shards at most; one step comes to the driver
    sums = steps_made.groupBy(F.col("shard") % max(4, math.isqrt(shards))).applyInArrow(added, _STEP)
    step = sums.groupBy().applyInArrow(averaged, "step binary").first().step
    return _moved(model, np.frombuffer(step, np.float64))


def _set_aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y) with a mark on the fifth of the ids that calibrates."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        aside = mix64(ids.view(U64) + U64(3)) % U64(5) == 0
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(aside)], names=["id", "y", "aside"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fold: int = 5,
    min_positive: int = 25,
    shape: Shape | None = None,
    rounds: int = 6,
    shard_rows: int = 10_000,
    shard_bytes: int = 32_000_000,
    least_steps: int = 240,
) -> Model:
    """Fit on all labelled rows, whole texts.

    Only ids with crc32(id as text) mod ``fold`` other than 0 take part. Rows
    are dealt by a hash to shards of about ``shard_rows`` rows or
    ``shard_bytes`` of text, which bounds what a task holds; the driver holds
    weights alone. A single shard takes all passes in one go. A fifth of the
    rows, by a hash of the id, calibrates thresholds: a language with at
    least ``min_positive`` toxic rows there gets its own cut, kept within
    0.1 to 0.9, others 0.5. Null labels and ids are left out; several labels of
    an id count as toxic if one of them is.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    known = known.dropna().groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("id").cast("string")) % fold != 0)
    known = persisted(known.mapInArrow(_set_aside, "id long, y int, aside boolean"), "known")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    rows = rows.where(F.crc32(F.col("id").cast("string")) % fold != 0).join(broadcast_if_small(known), "id")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows), -(-size // shard_bytes))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))
    # staged, a shard a file: every pass reads it; the order makes reruns agree
    rows = persisted(rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "text", "lang"), "labelled")
    grown, held = rows.where("not aside"), rows.where("aside")
    n, positive = grown.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = _fresh(shape or Shape(), np.random.default_rng(7))
    if not 0 < positive < n:
        model = _base_rate(model, n, positive)
    elif shards == 1:
        model = _one_pass(grown, model, positive / n, 7, rounds, least_steps, shards)
    else:
        for i in range(_passes(n, rounds, 64, least_steps)):
            model = _one_pass(grown, model, positive / n, 7 + i, 1, 0, shards)
    if counts.get(0) and counts.get(1) and 0 < positive < n:
        # both classes weighed alike in training; halfway to the true odds keeps rare toxic rows in reach
        model.shift = 0.5 * float(np.log(counts[1] / counts[0]))
    scored = score(held.select("text", "lang", "y"), model).select("lang", "score", "y")
    model.thresholds = {name: float(np.clip(cut, 0.1, 0.9)) for name, cut in best_cuts(scored, min_positive).items()}
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), the ``threshold`` of its language and ``toxic``: score at or above it.

    Whole texts are scored; null and blank texts score as an empty pooled
    vector does. Columns of ``docs`` with those three names are replaced.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OWN])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    text_at = [c.lower() for c in kept.columns].index(text_col.lower())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text_at)
            if pa.types.is_null(column.type):
                column = column.cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(_column_scores(model, column), pa.float64())], names=[*b.schema.names, "score"]
            )
        memory_returned()

    out = kept.mapInArrow(scored, schema)
    cut = F.lit(model.default)
    if lang_col in kept.columns:
        for name, t in sorted(model.thresholds.items()):
            cut = F.when(F.col(lang_col) == name, F.lit(t)).otherwise(cut)
    return out.withColumn("threshold", cut).withColumn("toxic", F.col("score") >= F.col("threshold"))
