"""The feature table of matches still to come, from kept state instead of the history.

A state has four tables, each as small as its entities: players (ring of the
last ten rows, lifetime and season totals), players by season (their last
gameweeks), sides (ring of the last thirty matches) and, if owners are used,
the basis of their embedding with each owner's games. A batch of whole
matches updates them; a coming gameweek reads them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.operators.state import build_state, from_state, merge_states
from panelwright.operators.windows import Panel
from panelwright.plans import features as T
from panelwright.plans.features import PLAYER_WINDOWS, TEAM_WINDOWS
from panelwright.semantics import broadcast_if_small, persisted

_SEASON = ["player_id", "season"]


@dataclass(frozen=True)
class FeatureState:
    """State tables, staged. ``columns`` are those of the facts."""

    players: DataFrame
    weeks: DataFrame
    sides: DataFrame
    player: Panel
    team: Panel
    columns: tuple[str, ...]
    windows: tuple[int, ...] = PLAYER_WINDOWS
    team_windows: tuple[int, ...] = TEAM_WINDOWS

    def updated(self, batch: DataFrame) -> "FeatureState":
        """The state after a batch of whole matches; neither the history nor the feature table is read."""
        new = build(batch, self.player, self.team, self.windows, self.team_windows)
        return FeatureState(
            persisted(merge_states(self.players, new.players, self.player, T.player_windows(self.columns, self.windows)), "players"),
            persisted(_merged_weeks(self.weeks, new.weeks, max(self.windows)), "weeks"),
            persisted(merge_states(self.sides, new.sides, self.team, T.side_windows(self.windows, self.team_windows)), "sides"),
            self.player, self.team, self.columns, self.windows, self.team_windows,
        )


def build(
    pm: DataFrame, player: Panel, team: Panel, windows: Sequence[int] = PLAYER_WINDOWS, team_windows: Sequence[int] = TEAM_WINDOWS
) -> FeatureState:
    """State of a history of whole matches."""
    windows, team_windows = tuple(windows), tuple(team_windows)
    return FeatureState(
        persisted(build_state(T.player_rows(pm), player, T.player_windows(pm.columns, windows)), "players"),
        persisted(_weeks(pm, max(windows)), "weeks"),
        persisted(build_state(T.side_rows(pm), team, T.side_windows(windows, team_windows)), "sides"),
        player, team, tuple(pm.columns), windows, team_windows,
    )


# ---- gameweeks of a player's season ---------------------------------------


def _weeks(pm: DataFrame, reach: int, starter_at: float = 60, full_at: float = 89) -> DataFrame:
    """(player, season): first gameweek, last one with minutes, and the last ``reach`` gameweeks with rows."""
    m = F.col("minutes")
    flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    seen = pm.dropna(subset=[*_SEASON, "gameweek"]).groupBy(*_SEASON, "gameweek").agg(
        F.sum(F.coalesce(m, F.lit(0.0))).alias("minutes"),
        flag(m >= starter_at).alias("starter"),
        flag(m >= full_at).alias("full"),
        flag(m > 0).alias("appeared"),
    )
    return _weeks_of(seen, reach)


def _weeks_of(seen: DataFrame, reach: int) -> DataFrame:
    """A season has few gameweeks: a group is bounded by the calendar."""
    week = F.struct("gameweek", "minutes", "starter", "full")
    return seen.groupBy(*_SEASON).agg(
        F.min("gameweek").alias("first"),
        F.max(F.when(F.col("appeared") == 1, F.col("gameweek"))).alias("last_seen"),
        F.slice(F.sort_array(F.collect_list(week), asc=False), 1, reach).alias("weeks"),
    )


def _merged_weeks(old: DataFrame, new: DataFrame, reach: int) -> DataFrame:
    """Weeks of both; rows of one gameweek in both are one gameweek."""
    rows = old.unionByName(new)
    bounds = rows.groupBy(*_SEASON).agg(F.min("first").alias("first"), F.max("last_seen").alias("last_seen"))
    week = rows.select(*_SEASON, F.inline("weeks")).groupBy(*_SEASON, "gameweek").agg(
        F.sum("minutes").alias("minutes"), F.max("starter").alias("starter"), F.max("full").alias("full")
    )
    rn = F.row_number().over(Window.partitionBy(*_SEASON).orderBy(F.desc("gameweek")))
    kept = week.withColumn("__rn", rn).where(F.col("__rn") <= reach)
    lists = kept.groupBy(*_SEASON).agg(F.sort_array(F.collect_list(F.struct("gameweek", "minutes", "starter", "full")), asc=False).alias("weeks"))
    return bounds.join(lists, _SEASON)


def _calendar(future: DataFrame, weeks: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Calendar features of coming rows: gameweeks without rows since the first one count as zero minutes."""
    df = future.join(weeks, _SEASON, "left")
    g, first = F.col("gameweek"), F.col("first")
    begun = first.isNotNull() & (first < g)
    last = F.get(F.filter("weeks", lambda w: w["gameweek"] == g - 1), F.lit(0))
    made = [
        F.when(begun, F.coalesce(last["minutes"], F.lit(0.0))).alias("last_minutes"),
        F.when(begun, F.coalesce(last["starter"], F.lit(0))).otherwise(0).alias("last_was_starter"),
        F.when(begun, F.coalesce(last["full"], F.lit(0))).otherwise(0).alias("last_was_full_90"),
        (g - F.when(F.col("last_seen") < g, F.col("last_seen"))).alias("gap_since_last"),
    ]
    for field, stem in (("minutes", "minutes"), ("starter", "starter_rate"), ("full", "full90_rate")):
        for n in windows:
            inside = F.filter("weeks", lambda w: (w["gameweek"] >= g - n) & (w["gameweek"] < g))
            total = F.aggregate(inside, F.lit(0.0), lambda acc, w: acc + w[field])
            made.append(F.when(begun, total / F.least(F.lit(n), g - first)).alias(f"{stem}_roll{n}"))
    return df.select(*future.columns, *made)


# ---- coming rows ----------------------------------------------------------


def future_features(future: DataFrame, state: FeatureState, owners: DataFrame | None = None) -> DataFrame:
    """The feature table of ``future``: rows of one coming gameweek, with players, sides and match, without statistics.

    Equals the rows that ``player_features`` would give once the matches are
    played, as no feature reads its own row. Players and sides without a
    history have the defaults of a first row. ``owners``: embedding of the
    coming sides.
    """
    absent = [c for c in state.columns if c not in future.columns]
    # statistics that are not known yet
    df = T.one_hot(future, "position", T.POSITION_FLAGS, 2).select("*", *(F.lit(None).cast("double").alias(c) for c in absent))
    df = from_state(df, state.players, state.player, T.player_windows(state.columns, state.windows))
    df = T.after_windows(df, state.windows)
    df = _calendar(df, broadcast_if_small(state.weeks), state.windows)
    feats = T.side_windows(state.windows, state.team_windows)
    sides = future.where(F.col("match_id").isNotNull()).select("match_id", "season", "gameweek", "team_no", "opp_no").distinct()
    rival = sides.select("match_id", "season", "gameweek", F.col("opp_no").alias("team_no"), F.col("team_no").alias("opp_no"))
    both = sides.unionByName(rival).distinct()
    panel = from_state(both, state.sides, state.team, feats).select("match_id", "team_no", *(f.out for f in feats))
    panel = broadcast_if_small(persisted(panel, "coming"))
    return T.with_owners(T.with_context(df, panel), owners)
