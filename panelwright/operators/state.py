"""What leak-free windows need to know of the past, as one row per entity.

A feature of a row that is still to come reads its entity's last rows and
running totals, not the history. Both can be kept: a ring of the newest rows,
as long as the longest row frame, and sums and counts. States merge: the state
of a history is that of its parts put together, so a batch of new rows costs
the batch. ``from_state`` gives what ``add_prior`` would give on the whole
history with the new rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.windows import Expanding, Feature, FillPrior, Lag, Panel, Rolling

RING = "__ring"


def _reach(features: Sequence[Feature]) -> int:
    return max((f.rows if isinstance(f, Rolling) else f.k if isinstance(f, Lag) else 0) for f in features)


def _kept(panel: Panel, features: Sequence[Feature]) -> list[str]:
    """Columns that ring entries hold besides the order."""
    used = {f.col for f in features if isinstance(f, (Rolling, Lag))} | {w for f in features if isinstance(f, (Rolling, Lag)) for w in f.within}
    return sorted(used - set(panel.order) - set(panel.entity))


def _totals(features: Sequence[Feature]) -> dict[tuple[str, ...], dict[str, str | None]]:
    """(within) -> {name of the total: column, None for rows}."""
    out: dict[tuple[str, ...], dict[str, str | None]] = {}
    for f in features:
        if isinstance(f, Expanding):
            name = "rows" if f.agg == "rows" else f.col
            out.setdefault(f.within, {})[name] = None if f.agg == "rows" else f.col
    return out


def _held(within: tuple[str, ...]) -> str:
    return "__of_" + "_".join(within) if within else "__of_all"


def _sums(cols: dict[str, str | None]) -> Column:
    parts = []
    for name, col in cols.items():
        value = F.lit(1) if col is None else F.col(col)
        parts += [F.sum(value).alias(f"s_{name}"), F.count(value).alias(f"n_{name}")]
    return parts


def build_state(df: DataFrame, panel: Panel, features: Sequence[Feature]) -> DataFrame:
    """One row per entity of ``df``; rows without an entity have none.

    The ring's rows are picked by a limit that works before the shuffle, the
    totals are combined map-side. Of totals that restart (``within``) the
    newest run is kept: a later row can only belong to it or to a new one.
    """
    keys = list(panel.entity)
    df = df.dropna(subset=keys)
    totals = _totals(features)
    last = {f.col: f for f in features if isinstance(f, FillPrior)}
    order = F.struct(*panel.order)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        *(F.max(F.when(F.col(c).isNotNull(), F.struct(*panel.order, F.col(c).alias("value")))).alias(f"__last_{c}") for c in last),
        *([] if () not in totals else _sums(totals[()])),
    )
    if () in totals:
        names = [p for n in totals[()] for p in (f"s_{n}", f"n_{n}")]
        out = out.withColumn(_held(()), F.struct(*names)).drop(*names)
    for within, cols in totals.items():
        if not within:
            continue
        runs = df.groupBy(*keys, *within).agg(*_sums(cols))
        names = [p for n in cols for p in (f"s_{n}", f"n_{n}")]
        newest = runs.groupBy(*keys).agg(F.max_by(F.struct(F.struct(*within).alias("run"), *names), F.struct(*within)).alias(_held(within)))
        out = out.join(newest, keys)
    reach = _reach(features)
    if reach:
        newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in panel.order))
        tail = df.select(*keys, *panel.order, *_kept(panel, features)).withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= reach)
        entry = F.struct(*panel.order, *_kept(panel, features))
        out = out.join(tail.groupBy(*keys).agg(F.sort_array(F.collect_list(entry), asc=False).alias(RING)), keys)
    return out


def merge_states(old: DataFrame, new: DataFrame, panel: Panel, features: Sequence[Feature]) -> DataFrame:
    """State of the rows of both; ``new`` need not be later. Entities of either side stay. One join by entity."""
    keys = list(panel.entity)
    a = old.select(*keys, *(F.col(c).alias(f"a{c}") for c in old.columns if c not in keys))
    b = new.select(*keys, *(F.col(c).alias(f"b{c}") for c in new.columns if c not in keys))
    both = a.join(b, keys, "full")
    made = []
    for c in old.columns:
        if c in keys:
            continue
        x, y = F.col(f"a{c}"), F.col(f"b{c}")
        if c == RING:
            value = F.slice(F.sort_array(F.concat(F.coalesce(x, F.array().cast(old.schema[c].dataType)), F.coalesce(y, F.array().cast(old.schema[c].dataType))), asc=False), 1, _reach(features))
        elif c == "__rows":
            value = F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        elif c.startswith("__last_"):
            value = F.greatest(x, y)
        else:
            fields = [f for f in old.schema[c].dataType.names if f != "run"]
            added = [F.when(x[f].isNull(), y[f]).when(y[f].isNull(), x[f]).otherwise(x[f] + y[f]).alias(f) for f in fields]
            if c == _held(()):
                value = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.struct(*added))
            else:
                value = F.when(x.isNull() | (y["run"] > x["run"]), y).when(y.isNull() | (x["run"] > y["run"]), x).otherwise(F.struct(x["run"].alias("run"), *added))
        made.append(value.alias(c))
    return both.select(*keys, *made)


def from_state(future: DataFrame, state: DataFrame, panel: Panel, features: Sequence[Feature]) -> DataFrame:
    """``future`` plus one column per feature, as if its rows stood behind the history, their values not known yet.

    Several coming rows of an entity follow each other in the panel's order:
    a later one counts the earlier ones as rows without values.
    """
    keys = list(panel.entity)
    w = Window.partitionBy(*keys).orderBy(*panel.order)
    df = future.withColumn("__j", F.row_number().over(w) - 1)
    runs = {f.within for f in features if f.within}
    for within in runs:
        inside = Window.partitionBy(*keys, *within).orderBy(*panel.order)
        df = df.withColumn("__j" + _held(within), F.row_number().over(inside) - 1)
    held = [c for c in state.columns if c not in keys]
    out = df.join(state.select(*keys, *(F.col(c).alias(f"__st{c}") for c in held)), keys, "left")
    ring = F.col(f"__st{RING}") if RING in held else None

    def seen(f: Feature) -> tuple[Column, Column]:
        """Ring entries of the row's run, and how many coming rows stand before it there."""
        if not f.within:
            return ring, F.col("__j")
        return F.filter(ring, lambda r: _all(r[c].eqNullSafe(F.col(c)) for c in f.within)), F.col("__j" + _held(f.within))

    def value(f: Feature) -> Column:
        if isinstance(f, FillPrior):
            return F.col(f"__st__last_{f.col}")["value"]
        if isinstance(f, Expanding):
            name = "rows" if f.agg == "rows" else f.col
            t = F.col(f"__st{_held(f.within)}")
            s, n = t[f"s_{name}"], F.coalesce(t[f"n_{name}"], F.lit(0))
            if f.within:
                here = _all(t["run"][c].eqNullSafe(F.col(c)) for c in f.within)
                s, n = F.when(here, s), F.when(here, n).otherwise(0)
            if f.agg == "rows":
                return n + F.col("__j" + _held(f.within) if f.within else "__j")
            known = {"count": n, "sum": F.when(n > 0, s), "avg": F.when(n > 0, s / n)}[f.agg]
            return known
        past, ahead = seen(f)
        if isinstance(f, Lag):
            return F.when(ahead < f.k, F.get(past, F.lit(f.k) - ahead - 1)[f.col])
        taken = F.slice(past, 1, F.greatest(F.lit(f.rows) - ahead, F.lit(0)))
        values = F.filter(F.transform(taken, lambda r: r[f.col]), lambda v: v.isNotNull())
        n = F.size(values)
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        whole = {"avg": total / n, "sum": total, "max": F.array_max(values), "min": F.array_min(values)}[f.agg]
        return F.when(n >= max(f.min_count, 1), whole)

    made = []
    for f in features:
        c, default = value(f), getattr(f, "default", None)
        made.append((c if default is None else F.coalesce(c, F.lit(default))).alias(f.out))
    return out.select(*future.columns, *made)


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
