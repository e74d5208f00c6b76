"""Leak-free panel windows: every feature of a row sees earlier rows only.

``add_prior`` computes any number of features in one pass, so all frames of
an entity share one shuffle and one sort.  An entity may hold a third of all
rows, far more than one task should sort; such an entity is cut into blocks
of consecutive periods.  A block receives copies of the last rows before it
(for row frames) and the totals of all earlier blocks (for unbounded frames),
so the result equals the uncut window exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.semantics import BROADCAST_BYTES, broadcast_if_small, null_safe_join, persisted, row_bytes

_BLK, _HALO = "__block", "__halo"


@dataclass(frozen=True)
class Panel:
    """Who a row belongs to and when it happened.

    ``period`` is a coarse, order-preserving prefix of ``order`` (an hour, a
    gameweek); it is what blocks of a heavy entity are made of.
    """

    entity: tuple[str, ...]
    order: tuple[str, ...]
    period: tuple[str, ...] = ()
    block_rows: int = 5_000_000

    def within(self, *cols: str) -> "Panel":
        """The same panel with finer entities (a season of a player, say)."""
        period = tuple(p for p in self.period if p not in cols)
        return Panel(self.entity + cols, self.order, period, self.block_rows)

    def window(self):
        return Window.partitionBy(*self.entity).orderBy(*self.order)


@dataclass(frozen=True)
class Rolling:
    """Aggregate of the ``rows`` rows before this one; nulls use up a slot.

    ``within`` restarts the window per extra key (a season of the entity).
    """

    col: str
    rows: int
    out: str
    agg: str = "avg"
    min_count: int = 1
    default: float | None = None
    within: tuple[str, ...] = ()


@dataclass(frozen=True)
class Expanding:
    """Aggregate (sum, avg, count, rows) of all rows before this one."""

    col: str | None
    out: str
    agg: str = "sum"
    default: float | None = None
    within: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lag:
    col: str
    out: str
    k: int = 1
    default: float | None = None
    within: tuple[str, ...] = ()


@dataclass(frozen=True)
class FillPrior:
    """Last value that was not null before this row."""

    col: str
    out: str
    within: tuple[str, ...] = ()


Feature = Rolling | Expanding | Lag | FillPrior


def rolling_features(cols: dict[str, str] | Sequence[str], windows: Sequence[int], **kw) -> list[Rolling]:
    """``{column: stem}`` times window lengths, named ``stem_roll<n>``."""
    stems = cols if isinstance(cols, dict) else {c: c for c in cols}
    return [Rolling(c, n, f"{stem}_roll{n}", **kw) for c, stem in stems.items() for n in windows]


def add_prior(
    df: DataFrame, panel: Panel, features: Sequence[Feature], sizes: DataFrame | None = None
) -> DataFrame:
    """``df`` plus one column per feature.

    Rows per entity and period are counted first, to find heavy entities; a
    narrow frame with the same rows can be handed in as ``sizes`` for that.
    Entity-wide windows are planned before finer ones: rows placed by entity
    also serve (entity, season), not the other way round.
    """
    groups: dict[tuple[str, ...], list[Feature]] = {}
    for f in sorted(features, key=lambda f: len(f.within)):
        groups.setdefault(f.within, []).append(f)
    source = df if sizes is None else sizes
    blocks = _heavy_blocks(source, panel) if panel.period else None
    for within, feats in groups.items():
        finer = panel.within(*within)
        if blocks is not None and within:
            part = _heavy_blocks(source, finer) if finer.period else None
        else:
            part = blocks
        df = _single_pass(df, finer, feats) if part is None else _blocked(df, finer, feats, part)
    return df


# ---- ordinary entities ---------------------------------------------------


def _default(c: Column, f: Feature) -> Column:
    value = getattr(f, "default", None)
    return c if value is None else F.coalesce(c, F.lit(value))


def _rolling_expr(f: Rolling, w) -> Column:
    frame = w.rowsBetween(-f.rows, -1)
    value = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[f.agg](f.col).over(frame)
    if f.min_count > 1:
        value = F.when(F.count(f.col).over(frame) >= f.min_count, value)
    return _default(value, f)


def _single_pass(df: DataFrame, panel: Panel, features: Sequence[Feature]) -> DataFrame:
    w = panel.window()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for f in features:
        if isinstance(f, Rolling):
            c = _rolling_expr(f, w)
        elif isinstance(f, Lag):
            c = _default(F.lag(f.col, f.k).over(w), f)
        elif isinstance(f, FillPrior):
            c = F.last(f.col, ignorenulls=True).over(before)
        elif f.agg == "rows":
            c = F.count(F.lit(1)).over(before)
        else:
            c = _default({"sum": F.sum, "avg": F.avg, "count": F.count}[f.agg](f.col).over(before), f)
        out.append(c.alias(f.out))
    return df.select("*", *out)


# ---- heavy entities ------------------------------------------------------


def _heavy_blocks(df: DataFrame, panel: Panel) -> DataFrame | None:
    """(entity, period) -> block number, for entities above ``block_rows`` only.

    The histogram is pre-aggregated map-side; its windows see one row per
    period. Returns None when no entity is heavy.
    """
    keys, period = list(panel.entity), list(panel.period)
    hist = df.groupBy(*keys, *period).agg(F.count(F.lit(1)).alias("__n"))
    by_entity = Window.partitionBy(*keys)
    earlier = by_entity.orderBy(*period).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        hist.select(
            *keys,
            *period,
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__n").over(by_entity).alias("__total"),
        )
        .where(F.col("__total") > panel.block_rows)
        .select(*keys, *period, F.floor(F.col("__before") / panel.block_rows).alias(_BLK))
    )
    found = blocks.count()  # one number per partition
    if not found:
        return None
    return F.broadcast(blocks) if found * row_bytes(blocks.schema) <= BROADCAST_BYTES else blocks


def _blocked(df: DataFrame, panel: Panel, features: Sequence[Feature], blocks: DataFrame) -> DataFrame:
    keys = [*panel.entity, _BLK]
    # a null period is a period of its own, and so is a null entity
    tagged = null_safe_join(df, blocks, [*panel.entity, *panel.period], "left").select(*df.columns, _BLK)
    heavy = tagged.where(F.col(_BLK).isNotNull())
    rows = tagged.withColumn(_BLK, F.coalesce(F.col(_BLK), F.lit(0).cast("long"))).withColumn(_HALO, F.lit(False))

    reach = max((f.rows if isinstance(f, Rolling) else f.k if isinstance(f, Lag) else 0) for f in features)
    if reach:
        rows = rows.unionByName(_halo_rows(heavy, panel, features, reach), allowMissingColumns=True)

    w = Window.partitionBy(*keys).orderBy(*panel.order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def own(c: Column) -> Column:
        return F.when(~F.col(_HALO), c)

    local: list[Column] = []
    final: list[Column] = []
    carried: list[Column] = []
    for i, f in enumerate(features):
        s, n, last = f"__s{i}", f"__n{i}", f"__l{i}"
        cs, cn, cl = f"__cs{i}", f"__cn{i}", f"__cl{i}"
        if isinstance(f, Rolling):
            local.append(_rolling_expr(f, w).alias(f.out))
            final.append(F.col(f.out))
        elif isinstance(f, Lag):
            local.append(_default(F.lag(f.col, f.k).over(w), f).alias(f.out))
            final.append(F.col(f.out))
        elif isinstance(f, FillPrior):
            local.append(F.last(own(F.col(f.col)), ignorenulls=True).over(before).alias(last))
            carried.append(F.max_by(f.col, F.when(F.col(f.col).isNotNull(), F.struct(*panel.order))).alias(cl))
            final.append(F.coalesce(F.col(last), F.col(cl)).alias(f.out))
        else:
            value = F.lit(1) if f.agg == "rows" else F.col(f.col)
            local += [F.sum(own(value)).over(before).alias(s), F.count(own(value)).over(before).alias(n)]
            carried += [F.sum(value).alias(cs), F.count(value).alias(cn)]
            count = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(cn), F.lit(0))
            total = F.when(count > 0, F.coalesce(F.col(s), F.lit(0)) + F.coalesce(F.col(cs), F.lit(0)))
            whole = {"rows": count, "count": count, "sum": total, "avg": total / count}[f.agg]
            if f.agg == "avg":
                whole = F.when(count > 0, whole)
            final.append(_default(whole, f).alias(f.out))

    out = rows.select("*", *local).where(~F.col(_HALO))
    if carried:
        names = [c for i in range(len(features)) for c in (f"__cs{i}", f"__cn{i}", f"__cl{i}")]
        totals = heavy.groupBy(*keys).agg(*carried)
        names = [c for c in names if c in totals.columns]
        earlier = Window.partitionBy(*panel.entity).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(
            *keys,
            *(
                (F.last(c, ignorenulls=True) if c.startswith("__cl") else F.sum(c)).over(earlier).alias(c)
                for c in names
            ),
        )
        out = null_safe_join(out, totals, keys, "left")
    return out.select(*df.columns, *final)


def _halo_rows(heavy: DataFrame, panel: Panel, features: Sequence[Feature], reach: int) -> DataFrame:
    """For every block of a heavy entity, copies of the ``reach`` rows before it.

    Each block hands on its own last rows (a row_number filter, limited before
    the shuffle). As a block holds at least one row, the ``reach`` blocks
    before a block are enough to find ``reach`` rows.
    """
    keys = [*panel.entity, _BLK]
    used = sorted({f.col for f in features if isinstance(f, (Rolling, Lag))} - {*panel.order, *panel.entity})
    tail = (
        heavy.select(*keys, *panel.order, *used)
        .withColumn(
            "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in panel.order)))
        )
        .where(F.col("__rn") <= reach)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(*panel.order, *used)).alias("__tail"))
    )
    earlier = Window.partitionBy(*panel.entity).orderBy(_BLK).rowsBetween(-reach, -1)
    latest = F.slice(
        F.sort_array(F.flatten(F.collect_list("__tail").over(earlier)), asc=False), 1, reach
    )
    return (
        tail.select(*keys, latest.alias("__latest"))
        .select(*keys, F.explode("__latest").alias("__r"))
        .select(*keys, "__r.*")
        .withColumn(_HALO, F.lit(True))
    )


# ---- further window operators --------------------------------------------


def gap_since(df: DataFrame, panel: Panel, period: str, flag: Column, out: str) -> DataFrame:
    """Periods since the flag was last true on an earlier row."""
    seen = df.withColumn("__seen", F.when(flag, F.col(period)))
    return (
        add_prior(seen, panel, [FillPrior("__seen", "__last")])
        .withColumn(out, F.col(period) - F.col("__last"))
        .drop("__seen", "__last")
    )


def tail_mean(df: DataFrame, panel: Panel, cols: Sequence[str], n: int, min_rows: int = 1) -> DataFrame:
    """Current state: mean of the latest ``n`` rows per entity, no shift."""
    newest = Window.partitionBy(*panel.entity).orderBy(*(F.desc(c) for c in panel.order))
    kept = df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n)
    return (
        kept.groupBy(*panel.entity)
        .agg(F.count(F.lit(1)).alias("n_rows"), *(F.avg(c).alias(c) for c in cols))
        .where(F.col("n_rows") >= min_rows)
    )


def ewm_prior(df: DataFrame, panel: Panel, col: str, span: int, out: str) -> DataFrame:
    """Exponentially weighted mean of all earlier rows, adjusted weights, nulls age.

    A scan in segments. A value that comes so late after the one before that
    everything older weighs less than the rounding of one double starts a new
    segment. Inside a segment rows are cut into blocks by their number; in a
    block weights relative to its start are plain sums over earlier rows, and
    a block hands its two sums on to the next one. A block is three such
    gaps long: what it received itself is below rounding by then, so no sum
    travels further, and no weight leaves the range of a double. The mean of
    a row without value is that of the last value before it, as nulls age
    both sums alike. All steps are ``add_prior``, which divides heavy entities.
    """
    keep = 1 - 2 / (span + 1)
    if keep <= 0:
        return add_prior(df, panel, [FillPrior(col, out)])
    gap = math.ceil((60 * math.log(2) - math.log(1 - keep)) / -math.log(keep))
    block = 3 * gap
    # a divided entity is read several times by each step: the steps are staged then
    heavy = bool(panel.period) and _heavy_blocks(df, panel) is not None
    staged = (lambda d: persisted(d, "ewm")) if heavy else (lambda d: d)
    has = F.col(col).isNotNull()
    i, seg, blk = "__ewm_i", "__ewm_seg", "__ewm_blk"
    rows = staged(add_prior(df, panel, [Expanding(None, i, "rows")]).withColumn("__ewm_at", F.when(has, F.col(i))))
    rows = staged(add_prior(rows, panel, [FillPrior("__ewm_at", "__ewm_last")]))
    late = F.col("__ewm_last").isNull() | (F.col(i) - F.col("__ewm_last") > gap)
    rows = rows.withColumn("__ewm_new", F.when(has & late, 1).otherwise(0))
    rows = staged(add_prior(rows, panel, [Expanding("__ewm_new", "__ewm_seg0", default=0)]))
    weight = F.pow(F.lit(1 / keep), F.col(i) % block)
    rows = rows.withColumns(
        {
            seg: F.col("__ewm_seg0") + F.col("__ewm_new"),
            blk: F.floor(F.col(i) / block),
            "__ewm_x": F.when(has, weight * F.col(col)),
            "__ewm_w": F.when(has, weight),
        }
    )
    here = (seg, blk)
    rows = staged(add_prior(rows, panel, [Expanding(f"__ewm_{c}", f"__ewm_s{c}", default=0.0, within=here) for c in ("x", "w")]))
    keys = [*panel.entity, *here]
    handed = rows.where(has).groupBy(*keys).agg(*(F.sum(f"__ewm_{c}").alias(f"__ewm_p{c}") for c in ("x", "w")))
    rows = null_safe_join(rows, handed.withColumn(blk, F.col(blk) + 1), keys, "left")
    total = {c: F.col(f"__ewm_s{c}") + F.coalesce(F.col(f"__ewm_p{c}"), F.lit(0.0)) * keep**block + F.col(f"__ewm_{c}") for c in ("x", "w")}
    rows = rows.withColumn("__ewm", F.when(has, total["x"] / total["w"])).select(*df.columns, "__ewm")
    return add_prior(staged(rows), panel, [FillPrior("__ewm", out)]).drop("__ewm")


def conditional_expanding(
    df: DataFrame, panel: Panel, season: str, cond: str, cols: Sequence[str], fallback: dict[str, str]
) -> DataFrame:
    """Season-to-date mean over rows of the same venue as this row.

    Meant for panels with one row per entity and period (team matches).
    Adds ``<c>_here`` (mean at this row's venue, else the overall season mean
    named in ``fallback``), ``<c>_yes`` and ``<c>_no`` (latest known mean at
    either venue, carried forward).
    """
    same = panel.within(season, cond)
    out = add_prior(df, same, [Expanding(c, f"__{c}", "avg") for c in cols])
    for c in cols:
        out = out.withColumn(f"{c}_here", F.coalesce(F.col(f"__{c}"), F.col(fallback[c])))
    upto = panel.window().rowsBetween(Window.unboundedPreceding, 0)
    carried = []
    for c in cols:
        for flag, name in ((1, "yes"), (0, "no")):
            value = F.when(F.col(cond) == flag, F.col(f"__{c}"))
            carried.append(F.last(value, ignorenulls=True).over(upto).alias(f"{c}_{name}"))
    return out.select("*", *carried).drop(*(f"__{c}" for c in cols))


def group_size(df: DataFrame, keys: Sequence[str], out: str = "n_in_group") -> DataFrame:
    """Rows per key next to each row. Counted by a combined aggregate, then joined."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, list(keys), "left")


def best_values(df: DataFrame, keys: Sequence[str], value: str, marks: Sequence[str]) -> DataFrame:
    """One row per group with a positive value: its best distinct values, the best first, null where there are no more."""
    return (
        df.where(F.col(value) > 0)
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value))))
        .where(F.col("__rk") <= len(marks))
        .groupBy(*keys)
        .agg(*(F.max(F.when(F.col("__rk") == i + 1, F.col(value))).alias(m) for i, m in enumerate(marks)))
    )


def tier_award(
    df: DataFrame, group: Sequence[str], value: str, out: str, tiers: Sequence[int] = (3, 2, 1)
) -> DataFrame:
    """Award by dense rank inside a group; equal values share, only positives count.

    The best distinct values of a group become one row of thresholds: values
    are made distinct map-side, then limited to the top few before they move.
    Every row compares with its group's thresholds; no row is joined by its
    value. The thresholds are staged and, where their size allows, broadcast,
    so that the rows do not move. A null group or value has no award.
    """
    keys, marks = list(group), [f"__tier{i}" for i in range(len(tiers))]
    top = best_values(df, keys, value, marks)
    top = broadcast_if_small(persisted(top, "tiers"))
    award = F.lit(0)
    for tier, mark in reversed(list(zip(tiers, marks))):
        award = F.when(F.col(value) == F.col(mark), F.lit(tier)).otherwise(award)
    return df.join(top, keys, "left").select(*df.columns, award.alias(out))


def densify(
    df: DataFrame, keys: Sequence[str], period: str, sums: Sequence[str], maxes: Sequence[str]
) -> DataFrame:
    """One row per entity and period between its first and last; gaps hold 0."""
    by = list(keys)
    seen = df.dropna(subset=[*by, period]).groupBy(*by, period).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxes)
    )
    grid = (
        seen.groupBy(*by)
        .agg(F.min(period).alias("__lo"), F.max(period).alias("__hi"))
        .select(*by, F.explode(F.sequence("__lo", "__hi")).alias(period))
    )
    filled = grid.join(seen, [*by, period], "left")
    return filled.select(*by, period, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*sums, *maxes]))


def calendar_features(
    df: DataFrame,
    entity: Sequence[str],
    season: str,
    period: str,
    windows: Sequence[int],
    minutes: str = "minutes",
    starter_at: float = 60,
    full_at: float = 89,
) -> DataFrame:
    """Calendar-aware minutes features, keyed by entity, season and period."""
    base = df.select(
        *entity,
        season,
        period,
        F.coalesce(F.col(minutes), F.lit(0)).alias("minutes"),
        (F.col(minutes) >= starter_at).cast("int").alias("was_starter"),
        (F.col(minutes) >= full_at).cast("int").alias("was_full_90"),
        (F.col(minutes) > 0).cast("int").alias("appeared"),
    )
    grid = densify(base, [*entity, season], period, ["minutes"], ["was_starter", "was_full_90", "appeared"])
    grid = grid.withColumn("__app", F.when(F.col("appeared") == 1, F.col(period)))
    panel = Panel((*entity, season), (period,))
    feats: list[Feature] = [
        Lag("minutes", "last_minutes"),
        Lag("was_starter", "last_was_starter", default=0),
        Lag("was_full_90", "last_was_full_90", default=0),
        FillPrior("__app", "__last"),
        *rolling_features({"minutes": "minutes", "was_starter": "starter_rate", "was_full_90": "full90_rate"}, windows),
    ]
    out = add_prior(grid, panel, feats)
    return out.withColumn("gap_since_last", F.col(period) - F.col("__last")).select(
        *entity,
        season,
        period,
        "last_minutes",
        "last_was_starter",
        "last_was_full_90",
        "gap_since_last",
        *(f.out for f in feats if isinstance(f, Rolling)),
    )


def features_for_future(history: DataFrame, future: DataFrame, entity: Sequence[str], feature_fn, flag: str = "is_future"):
    """Score-time rows through the training-time feature code.

    Filters cannot move below a window, so history is reduced to the entities
    that are needed before the features are planned.
    """
    needed = history.join(future.select(*entity).distinct(), list(entity), "left_semi")
    both = needed.withColumn(flag, F.lit(False)).unionByName(
        future.withColumn(flag, F.lit(True)), allowMissingColumns=True
    )
    return feature_fn(both).where(F.col(flag)).drop(flag)
