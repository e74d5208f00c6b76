"""Row-local feature formulas, all plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.semantics import clip

# Upper bounds of match rates per 90 minutes.
MATCH_CAPS = {
    "goals": 3.0,
    "assists": 3.0,
    "xg": 2.0,
    "xa": 1.5,
    "shots": 8.0,
    "key_passes": 6.0,
    "fouls": 6.0,
    "saves": 12.0,
    "xgot_faced": 5.0,
}
# Further bounds used by the award model.
AWARD_CAPS = {
    "tackles_per90": 8.0,
    "clearances_per90": 12.0,
    "interceptions_per90": 6.0,
    "recoveries_per90": 15.0,
    "blocks_per90": 6.0,
    "key_passes_per90": 6.0,
    "shots_per90": 8.0,
    "goals_per90": 3.0,
    "assists_per90": 3.0,
    "xg_per90": 2.0,
    "xa_per90": 1.5,
}
# Weight of one action in the baseline estimate.
BASELINE_WEIGHTS = {
    "key_passes": 1.0,
    "tackles": 2.0,
    "interceptions": 1.0,
    "recoveries": 1.0,
    "clearances": 1.0,
    "blocks": 1.0,
    "shots": 0.8,
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def per90(value: Column | str, minutes: Column | str, min_minutes: float | None = 20, cap: float | None = None) -> Column:
    """Rate per 90 minutes; null under ``min_minutes``, optionally capped."""
    rate = _c(value) / F.greatest(_c(minutes) / 90, F.lit(0.01))
    if cap is not None:
        rate = clip(rate, high=cap)
    return rate if min_minutes is None else F.when(_c(minutes) >= min_minutes, rate)


def rate_per(
    df: DataFrame,
    cols: Sequence[str],
    minutes: str = "minutes",
    min_minutes: float | None = 20,
    caps: Mapping[str, float] | None = MATCH_CAPS,
) -> DataFrame:
    """Adds ``<col>_per90``; ``caps=None`` leaves the rates uncapped."""
    caps = caps or {}
    return df.select("*", *(per90(c, minutes, min_minutes, caps.get(c)).alias(f"{c}_per90") for c in cols))


def lifetime_rate(total: Column | str, minutes: Column | str, cap: float | None = None, least: float = 90) -> Column:
    """Career rate per 90 minutes, 0 until a full match has been played."""
    rate = F.coalesce(_c(total), F.lit(0)) / F.greatest(_c(minutes) / 90, F.lit(0.01))
    rate = F.when(_c(minutes) >= least, rate).otherwise(F.lit(0.0))
    return rate if cap is None else clip(rate, high=cap)


def share_of(part: Column | str, whole: Column | str, minutes: Column | str, min_minutes: float = 20, floor: float = 0.1):
    """Share of a team total; null for short appearances and empty totals."""
    return F.when(
        (_c(minutes) >= min_minutes) & (_c(whole) > 0), _c(part) / F.greatest(_c(whole), F.lit(floor))
    )


def ratio_where(a: Column | str, b: Column | str) -> Column:
    """a / b where there was exposure, else null."""
    return F.when(_c(b) > 0, _c(a) / _c(b))


def trend(short: Column | str, long: Column | str) -> Column:
    return _c(short) - _c(long)


def overperformance(actual: Column | str, expected: Column | str) -> Column:
    return _c(actual) - _c(expected)


def interact(a: Column | str, b: Column | str, fill: float | None = 0.0) -> Column:
    """Product; with ``fill`` a missing factor counts as that value."""
    if fill is None:
        return _c(a) * _c(b)
    return F.coalesce(_c(a), F.lit(fill)) * F.coalesce(_c(b), F.lit(fill))


def damped_ratio(a: Column | str, b: Column | str, fill: float = 1.0, damp: float = 0.01) -> Column:
    return F.coalesce(_c(a), F.lit(fill)) / (F.coalesce(_c(b), F.lit(fill)) + damp)


def weighted_score(terms: Sequence[tuple[Column | str, float, float]]) -> Column:
    """Sum of weight * value, a missing value replaced by its default."""
    parts = [F.coalesce(_c(c), F.lit(default)) * weight for c, weight, default in terms]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def starter_score(minutes: Column | str, starter_rate: Column | str, last_full: Column | str) -> Column:
    return weighted_score([(_c(minutes) / 90, 0.4, 60 / 90), (starter_rate, 0.4, 0.5), (last_full, 0.2, 0.5)])


def prior_rate(team_rate: Sequence[Column | str], opp_rate: Sequence[Column | str], league: Column) -> Column:
    """Naive expected goals against: own rate times relative opponent strength.

    Both sides are fallback chains; the league mean ends them.
    """
    own = F.coalesce(*(_c(c) for c in team_rate), league)
    opp = F.coalesce(*(_c(c) for c in opp_rate), league)
    return own * (opp / league)


def linear_points(
    df: DataFrame, weights: Mapping[str, float] = BASELINE_WEIGHTS, suffix: str = "_per90_roll5", minutes: str = "minutes"
) -> Column:
    """Baseline estimate: 6 / 3 / 0 by minutes plus weighted recent rates."""
    played = F.coalesce(F.col(minutes), F.lit(0.0))
    out = F.when(played >= 60, 6.0).when(played >= 1, 3.0).otherwise(0.0)
    for stat, weight in weights.items():
        if f"{stat}{suffix}" in df.columns:
            out = out + F.coalesce(F.col(f"{stat}{suffix}"), F.lit(0.0)) * (played / 90) * weight
    return out


def residual_points(total: Column | str, goals, assists, clean_sheet, goal_value: Column, clean_value: Column) -> Column:
    """What is left of an award score after its major events, at least 0."""
    return F.greatest(
        F.coalesce(_c(total), F.lit(0))
        - F.coalesce(_c(goals), F.lit(0)) * goal_value
        - F.coalesce(_c(assists), F.lit(0)) * 9
        - F.coalesce(_c(clean_sheet), F.lit(0)) * clean_value,
        F.lit(0),
    )


def reliability_scale(base: Column | str, recent: Column | str, predicted: Column | str, available: Column) -> Column:
    """Scale by trust in recent minutes and by expected exposure."""
    trust = clip(F.coalesce(_c(recent), F.lit(300.0)) / 300, 0.3, 1.0)
    exposure = clip(_c(predicted) / 90, 0.0, 1.0)
    return F.when((_c(predicted) >= 10) & available, _c(base) * trust * exposure).otherwise(F.lit(0.0))


def conditional_metric(df: DataFrame, position: str = "position") -> DataFrame:
    """Defensive actions, threshold and hit flag by class of player."""
    four = F.col("clearances") + F.col("blocks") + F.col("interceptions") + F.col("tackles")
    is_def = F.col(position) == 1
    actions = F.when(is_def, four).otherwise(four + F.col("recoveries"))
    bar = F.when(is_def, 10).otherwise(12)
    return df.select(
        "*", actions.alias("defcon"), bar.alias("defcon_threshold"), (actions >= bar).cast("int").alias("hit_threshold")
    )
