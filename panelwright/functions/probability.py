"""Count distributions and scoring rules as native expressions (no UDF)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.semantics import clip

# Points by class of player.
POINTS = {
    "goal": {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4},
    "clean_sheet": {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0},
    "assist": 3,
    "conceded_pair": -1,
    "saves_triple": 1,
    "defcon": 2,
    "yellow": -1,
    "red": -3,
    "appearance_60": 2,
    "appearance_1": 1,
}
# Award score of the events that are drawn.
AWARD_SCORE = {
    "goal": {"GK": 12, "DEF": 12, "MID": 18, "FWD": 24},
    "clean_sheet": {"GK": 12, "DEF": 12, "MID": 0, "FWD": 0},
    "assist": 9,
    "yellow": -3,
}
POSITIONS = ("GK", "DEF", "MID", "FWD")
RED_PER_FOUL = 0.004


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_class(label: Column | str, table: Mapping[str, float], default: float) -> Column:
    out = None
    for name, value in table.items():
        cond = _c(label) == name
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def position_label(code: Column | str) -> Column:
    out = None
    for i, name in enumerate(POSITIONS):
        cond = _c(code) == i
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("MID"))


def poisson_pmf(k: int, lam: Column | str) -> Column:
    return F.exp(-_c(lam)) * F.pow(_c(lam), F.lit(float(k))) / float(math.factorial(k))


def _horner(coefficients: list[float], x: Column) -> Column:
    """Polynomial, lowest power first; x appears once per power, so the expression stays small."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def poisson_cdf(k: int, lam: Column | str) -> Column:
    """P(X <= k)."""
    return F.exp(-_c(lam)) * _horner([1 / math.factorial(i) for i in range(k + 1)], _c(lam))


def expected_floor(lam: Column | str, per: int = 2, upto: int = 10) -> Column:
    """Negative expectation of floor(k / per); the tail counts as upto / per.

    With tail value T: sum p(k) floor(k/per) + T (1 - sum p(k)) is T plus
    exp(-lam) times one polynomial.
    """
    tail = upto // per
    poly = _horner([(k // per - tail) / math.factorial(k) for k in range(upto + 1)], _c(lam))
    return -(tail + F.exp(-_c(lam)) * poly)


def nb_tail(threshold: Column, r: Column, mu: Column | str, most: int | None = None) -> Column:
    """P(X >= threshold) of a negative binomial with mean mu and dispersion r.

    A null r means no overdispersion: Poisson. The mass follows
    p(i) = p(i-1) f(i). A caller that knows its largest threshold passes it as
    ``most``: the sum below the threshold is then one nested expression,
    p(0) (1 + f(1) (1 + f(2) (1 + ...))), that compiles well, and a larger
    threshold is an error. Otherwise the terms are added one by one.
    """
    m = F.greatest(_c(mu), F.lit(0.01))
    poisson = r.isNull()
    step = F.when(poisson, m).otherwise(r * m / (r + m))
    grow = F.when(poisson, F.lit(0.0)).otherwise(m / (r + m))
    first = F.when(poisson, F.exp(-m)).otherwise(F.pow(r / (r + m), r))
    if most is None:

        def term(acc, i):
            p = acc["p"] * (step + grow * (i - 1)) / i
            return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"))

        terms = F.filter(F.sequence(F.lit(1), F.greatest(threshold.cast("int"), F.lit(1))), lambda i: i < threshold)
        below = F.aggregate(terms, F.struct(first.alias("p"), first.alias("sum")), term, lambda acc: acc["sum"])
        return clip(1 - F.when(threshold > 0, below).otherwise(0.0), 0.0, 1.0)
    nested = F.lit(1.0)
    for i in range(most - 1, 0, -1):
        nested = 1 + F.when(threshold > i, (step + grow * (i - 1)) / i * nested).otherwise(0.0)
    checked = F.when(threshold > most, F.raise_error(F.lit("threshold above the declared maximum")).cast("double"))
    return F.coalesce(checked, clip(1 - first * nested, 0.0, 1.0))


def nb_dispersion(df: DataFrame, y: str, mu: str) -> DataFrame:
    """One row: Pearson phi and dispersion r (null when phi <= 1)."""
    m = F.greatest(F.col(mu), F.lit(0.01))
    yy = F.coalesce(F.col(y), F.lit(0))
    stats = df.agg(
        (F.sum(F.pow(yy - m, F.lit(2)) / m) / (F.count(F.lit(1)) - 1)).alias("phi"), F.avg(m).alias("mean_mu")
    )
    r = F.when(F.col("phi") > 1, F.greatest(F.col("mean_mu") / (F.col("phi") - 1), F.lit(0.5)))
    return stats.select("phi", r.alias("r"))


def sharpen(p: Column | str, temp: float = 0.3) -> Column:
    q = clip(_c(p), 1e-6, 1 - 1e-6)
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / temp))


def log_blend(a: Column | str, b: Column | str, w: float = 0.5) -> Column:
    mixed = F.exp(w * F.log(_c(a)) + (1 - w) * F.log(clip(_c(b), 1e-6, 10.0)))
    return clip(mixed, 1e-6, 10.0)


def mix(p: Column | str, a: Column | str, b: Column | str) -> Column:
    return _c(p) * _c(a) + (1 - _c(p)) * _c(b)


def cap_minutes(pred, apps, season_minutes, per_app, recent) -> Column:
    """Caps, then floors, on predicted minutes by use in the current season."""
    x, a, m, avg = _c(pred), F.coalesce(_c(apps), F.lit(0)), F.coalesce(_c(season_minutes), F.lit(0)), _c(per_app)
    avg = F.coalesce(avg, F.lit(0.0))
    last = F.coalesce(_c(recent), F.lit(60.0))
    scaled = avg * 1.2
    capped = (
        F.when(a == 0, F.least(x, F.lit(30.0)))
        .when(m < 90, F.least(x, F.greatest(scaled, F.lit(15.0))))
        .when(a >= 3, F.least(x, F.greatest(F.least(F.lit(90.0), scaled), F.lit(30.0))))
        .otherwise(x)
    )
    regular = (a >= 5) & (avg >= 80)
    floored = (
        F.when(regular & (last >= 80), F.greatest(capped, F.lit(88.0)))
        .when(regular & (last >= 70), F.greatest(capped, F.lit(80.0)))
        .otherwise(capped)
    )
    return clip(floored, 1.0, 90.0)


def appearance_points(minutes: Column | str) -> Column:
    m = _c(minutes)
    return F.when(m >= 60, POINTS["appearance_60"]).when(m >= 1, POINTS["appearance_1"]).otherwise(0)


def expected_points(df: DataFrame, label: str = "fpl_position", include_cards: bool = True) -> DataFrame:
    """Eleven point columns from predicted rates and probabilities."""
    mins, pos = F.col("pred_minutes"), F.col(label)
    full = mins >= 60
    back = pos.isin("GK", "DEF")
    zero = F.lit(0.0)
    parts = {
        "exp_goals_pts": F.col("pred_exp_goals") * by_class(label, POINTS["goal"], 5),
        "exp_assists_pts": F.col("pred_exp_assists") * POINTS["assist"],
        "exp_cs_pts": F.when(full, F.col("pred_cs_prob") * by_class(label, POINTS["clean_sheet"], 0)).otherwise(zero),
        "exp_conceded_penalty": F.when(full & back, expected_floor("pred_goals_against")).otherwise(zero),
        "exp_saves_pts": F.when(pos == "GK", F.col("pred_exp_saves") / 3 * POINTS["saves_triple"]).otherwise(zero),
        "exp_defcon_pts": F.when(full & pos.isin("DEF", "MID"), F.col("pred_defcon_prob") * POINTS["defcon"]).otherwise(
            zero
        ),
        "exp_bonus_pts": F.col("pred_bonus"),
        "exp_yellow_pts": F.col("pred_yellow_prob") * (POINTS["yellow"] if include_cards else 0),
        "exp_red_pts": F.col("pred_red_prob") * (POINTS["red"] if include_cards else 0),
        "exp_appearance_pts": appearance_points("pred_minutes").cast("double"),
    }
    out = df.select("*", *(c.alias(n) for n, c in parts.items()))
    total = None
    for n in parts:
        total = F.col(n) if total is None else total + F.col(n)
    return out.withColumn("exp_total_pts", total)


def actual_points(df: DataFrame, label: str = "fpl_position", include_cards: bool = True) -> Column:
    """Points from what happened; 0 without an appearance."""
    mins, pos = F.col("minutes"), F.col(label)
    full = mins >= 60
    conceded = F.coalesce(F.col("goals_conceded"), F.lit(1))
    zero = F.lit(0)
    pts = (
        appearance_points("minutes")
        + F.coalesce(F.col("goals"), zero) * by_class(label, POINTS["goal"], 5)
        + F.coalesce(F.col("assists"), zero) * POINTS["assist"]
        + F.when(full & (conceded == 0), by_class(label, POINTS["clean_sheet"], 0)).otherwise(zero)
        + F.when(full & pos.isin("GK", "DEF"), F.floor(conceded / 2) * POINTS["conceded_pair"]).otherwise(zero)
        + F.when(pos == "GK", F.floor(F.coalesce(F.col("saves"), zero) / 3) * POINTS["saves_triple"]).otherwise(zero)
        + F.when(full & pos.isin("DEF", "MID"), F.coalesce(F.col("hit_threshold"), zero) * POINTS["defcon"]).otherwise(
            zero
        )
    )
    if include_cards:
        for col, rule in (("yellow", "yellow"), ("red", "red")):
            if col in df.columns:
                pts = pts + F.coalesce(F.col(col), zero) * POINTS[rule]
    return F.when(mins >= 1, pts).otherwise(zero)


def rate_to_prob(fouls_per90: Column | str, minutes: Column | str) -> Column:
    """Red-card proxy: expected fouls times a fixed rate."""
    return clip(_c(fouls_per90), 0.0, 6.0) * (_c(minutes) / 90) * RED_PER_FOUL


def scale_exposure(per90_rate: Column | str, minutes: Column | str) -> Column:
    return _c(per90_rate) * (_c(minutes) / 90)


def any_of(p: Column | str) -> Column:
    """Aggregate: probability of at least one success over a group's rows."""
    q = F.coalesce(_c(p), F.lit(0.0))
    certain = F.max((q >= 1).cast("int")) == 1
    # ln(1-p) is not evaluated where p >= 1
    miss = F.sum(F.when(q < 1, F.log(1 - q)))
    return F.when(certain, F.lit(1.0)).otherwise(1 - F.exp(F.coalesce(miss, F.lit(0.0))))
