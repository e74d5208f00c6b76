"""Flattening of nested documents. All row-local: no shuffle is needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.text import snake

# Names of the shot fields, raw -> flat.
SHOT_FIELDS = {
    "id": "shot_id",
    "playerId": "player_id",
    "playerName": "player_name",
    "teamId": "team_id",
    "min": "minute",
    "x": "x",
    "y": "y",
    "expectedGoals": "xG",
    "expectedGoalsOnTarget": "xGOT",
    "eventType": "event_type",
    "shotType": "shot_type",
    "situation": "situation",
    "isOnTarget": "is_on_target",
    "isBlocked": "is_blocked",
    "isFromInsideBox": "is_from_inside_box",
}
# Flat match row, output name -> path.
MATCH_FIELDS = {
    "match_id": "general.matchId",
    "home_team": "general.homeTeam.name",
    "away_team": "general.awayTeam.name",
    "home_score": "general.homeTeam.score",
    "away_score": "general.awayTeam.score",
    "match_date": "general.matchTimeUTCDate",
}
MAX_STAT_COLUMNS = 10_000


def project_struct(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = (), root: str = "") -> DataFrame:
    """Nested fields as flat columns; a missing parent gives null."""
    return df.select(*keep, *(F.col(root + path).alias(out) for out, path in mapping.items()))


def stat_entries(stats: Column) -> Column:
    """array(struct(stats map)) -> array of (snake-case name, value), first one per name."""
    flat = F.flatten(F.transform(stats, lambda s: F.map_entries(s["stats"])))
    named = F.transform(flat, lambda e: F.struct(snake(e["key"]).alias("key"), e["value"]["stat"]["value"].alias("value")))
    keys = F.transform(named, lambda e: e["key"])
    return F.filter(named, lambda e, i: F.array_position(keys, e["key"]) == i + 1)


def flatten_stats(df: DataFrame, doc: str = "doc", keep: Mapping[str, str] | None = None) -> DataFrame:
    """One row per player with an open map ``stats``; players without stats are dropped."""
    keep = keep or {"match_id": "general.matchId"}
    players = df.select(
        *(F.col(f"{doc}.{p}").alias(o) for o, p in keep.items()),
        F.explode(F.col(f"{doc}.content.playerStats")).alias("player_id", "p"),
    )
    rows = players.withColumn("__e", stat_entries(F.col("p.stats"))).where(F.size("__e") > 0)
    return rows.select(
        *keep,
        "player_id",
        F.col("p.name").alias("player_name"),
        F.col("p.teamName").alias("team"),
        F.col("p.usualPosition").alias("position"),
        F.col("p.shirtNumber").alias("shirt_number"),
        F.map_from_entries("__e").alias("stats"),
    )


def stat_names(df: DataFrame, stats: str = "stats") -> list[str]:
    """Names in use, for promotion to columns. Bounded: more would not be columns."""
    found = df.select(F.explode(F.map_keys(stats)).alias("k")).distinct().limit(MAX_STAT_COLUMNS + 1).collect()
    if len(found) > MAX_STAT_COLUMNS:
        raise ValueError("too many stat names for columns; keep them in the map")
    return sorted(r.k for r in found)


def promote_stats(df: DataFrame, names: Sequence[str], stats: str = "stats") -> DataFrame:
    """Map entries as columns; a name that a row lacks is null."""
    return df.select(*(c for c in df.columns if c != stats), *(F.try_element_at(stats, F.lit(n)).alias(n) for n in names))


def flatten_array(df: DataFrame, col: str, mapping: Mapping[str, str], keep: Mapping[str, str] | None = None) -> DataFrame:
    """An array of structs as rows, fields renamed."""
    items = F.transform(F.col(col), lambda x: F.struct(*(x[raw].alias(out) for raw, out in mapping.items())))
    return df.select(*(F.col(p).alias(o) for o, p in (keep or {}).items()), F.inline(items))


def flatten_shots(df: DataFrame, doc: str = "doc") -> DataFrame:
    return flatten_array(df, f"{doc}.content.shotmap.shots", SHOT_FIELDS, {"match_id": f"{doc}.general.matchId"})


def extract_sides(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Manager and formation of both sides, one row per side."""

    def side(which: str, home: int) -> Column:
        return F.struct(
            F.col(f"{doc}.general.{which}.name").alias("team"),
            F.col(f"{doc}.content.lineup.{which}.coach.id").alias("manager_id"),
            F.col(f"{doc}.content.lineup.{which}.coach.name").alias("manager_name"),
            F.col(f"{doc}.content.lineup.{which}.formation").alias("formation"),
            F.lit(home).alias("is_home"),
        )

    return df.select(
        F.col(f"{doc}.general.matchId").alias("match_id"), F.inline(F.array(side("homeTeam", 1), side("awayTeam", 0)))
    )


def flatten_fixtures(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Finished matches of a season list; the round's name stands in for its number."""
    items = df.select(*keep, F.inline(col))
    return items.where(F.col("status.finished")).select(
        *keep,
        F.col("id").alias("match_id"),
        F.coalesce(F.col("round").cast("string"), F.col("roundName")).alias("round"),
        F.col("home.name").alias("home_team"),
        F.col("away.name").alias("away_team"),
        F.col("home.score").alias("home_score"),
        F.col("away.score").alias("away_score"),
    )


def flatten_points(live: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """Live points per gameweek with player and team looked up.

    Unknown players keep their row with empty names. Both lookups are left to
    the planner, which broadcasts them when their size allows.
    """
    rows = live.select("gameweek", F.inline("elements")).select("gameweek", F.col("id").alias("fpl_id"), "stats.*")
    out = rows.join(players, "fpl_id", "left").join(teams, "team_id", "left")
    text = ("player_name", "web_name", "team")
    return out.select(
        "fpl_id",
        "gameweek",
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in text),
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in rows.columns if c not in ("fpl_id", "gameweek")),
    )
