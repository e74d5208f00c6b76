"""What-if rows: a team's latest state against the opponent it meets next."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.functions.rates import prior_rate
from panelwright.operators.windows import Panel


def latest_team_state(tm: DataFrame, panel: Panel, recent: int = 5) -> DataFrame:
    """Current state per team, its last match included.

    ``tm`` carries goals, goals_conceded and the season and venue rates.
    """
    upto = panel.window().rowsBetween(1 - recent, 0)
    cols = ["scored5", "conceded5", "goals_conceded_here", "goals_conceded_yes", "goals_conceded_no", "season_conceded"]
    rolled = tm.withColumns({"scored5": F.avg("goals").over(upto), "conceded5": F.avg("goals_conceded").over(upto)})
    newest = Window.partitionBy(*panel.entity).orderBy(*(F.desc(c) for c in panel.order))
    return (
        rolled.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") == 1).select(*panel.entity, *cols)
    )


def matchup_rows(state: DataFrame, rates: DataFrame, fixtures: DataFrame, league: DataFrame, team="team_no", opp="opp_no") -> DataFrame:
    """One row per side of each fixture with prior rate and interactions.

    Venue decides which of the team's venue rates is used; the opponent's
    season scoring rate replaces whatever its last match left behind.
    """
    attack = state.select(F.col(team).alias(opp), F.col("scored5").alias("__scored5"))
    season = rates.select(F.col(team).alias(opp), F.col("season_goals_per_game").alias("opp_season_goals"))
    df = (
        fixtures.join(state.drop("scored5"), team, "left")
        .join(attack, opp, "left")
        .join(season, opp, "left")
        .withColumn("__league", league.scalar())
    )
    mean = F.col("__league")
    here = F.when(F.col("is_home") == 1, F.col("goals_conceded_yes")).otherwise(F.col("goals_conceded_no"))
    lam = prior_rate([here, "goals_conceded_here", "season_conceded"], ["opp_season_goals"], mean)
    own = F.coalesce("conceded5", F.lit(1.0))
    return (
        df.withColumn("opp_scored_roll5", F.coalesce("__scored5", "opp_season_goals", mean))
        .withColumn("prior_lambda", lam)
        .withColumn("naive_cs_prob", F.exp(-F.col("prior_lambda")))
        .withColumn("conceded_x_opp", own * F.col("opp_scored_roll5"))
        .withColumn("conceded_div_opp", own / (F.col("opp_scored_roll5") + 0.01))
        .drop("__scored5", "__league")
    )


def refresh_state(df: DataFrame, latest: DataFrame, key: str, latest_key: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace stale columns by the latest known state; unknown keys keep theirs."""
    fresh = latest.select(F.col(latest_key).alias(key), *(F.col(c).alias(f"__{o}") for c, o in mapping.items()))
    joined = df.join(fresh, key, "left")
    targets = set(mapping.values())
    return joined.select(
        *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in targets else F.col(c) for c in df.columns)
    )


