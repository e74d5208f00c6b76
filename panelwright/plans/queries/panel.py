"""Window queries over the player and team panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import owners as O, windows as W
from panelwright.operators.windows import Expanding, FillPrior, Lag, Panel, Rolling, add_prior, rolling_features
from panelwright.plans.registry import query
from panelwright.plans.standins import PLAYER, PM, SIDES, TEAM, TM, player_match, sides, team_match

PLAYER_WINDOWS = (1, 2, 3, 5, 7, 10)
TEAM_WINDOWS = (*PLAYER_WINDOWS, 30)
_PRIOR = "(PARTITION BY player_id ORDER BY ts, match_row"


def _r(c, digits=6):
    return F.round(c, digits).alias(c)


@query(
    "q_lag",
    PM
    + """SELECT a.match_row, b.minutes AS last_minutes, COALESCE(b.goals, 0) AS goals_last1
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts, match_row) AS i FROM pm) AS a
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts, match_row) AS i FROM pm) AS b
      ON a.player_id = b.player_id AND a.i = b.i + 1""",
)
def _lag(spark, sf):
    feats = [Lag("minutes", "last_minutes"), Lag("goals", "goals_last1", default=0)]
    return add_prior(player_match(spark, sf), PLAYER, feats).select("match_row", "last_minutes", "goals_last1")


_roll_sql = ", ".join(
    f"round(avg(b.{c}) FILTER (WHERE a.i - b.i <= {n}), {dg}) AS {c}_roll{n}"
    for c, dg in (("minutes", 6), ("xg", 8))
    for n in PLAYER_WINDOWS
)


@query(
    "q_rolling_mean",
    PM
    + f""", n AS (SELECT *, row_number() OVER {_PRIOR}) AS i FROM pm)
    SELECT a.match_row, {_roll_sql}
    FROM n AS a LEFT JOIN n AS b ON a.player_id = b.player_id AND b.i < a.i AND b.i >= a.i - 10
    GROUP BY a.match_row""",
)
def _rolling_mean(spark, sf):
    feats = rolling_features(["minutes", "xg"], PLAYER_WINDOWS)
    out = add_prior(player_match(spark, sf), PLAYER, feats)
    return out.select("match_row", *(_r(f.out, 6 if f.col == "minutes" else 8) for f in feats))


_sum_sql = ", ".join(
    f"CAST(COALESCE(sum({c}) OVER {_PRIOR} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {c}_roll{n}"
    for c in ("goals", "assists")
    for n in PLAYER_WINDOWS
)


@query("q_rolling_sum", PM + f"SELECT match_row, {_sum_sql}, goals_roll5 + assists_roll5 AS goal_involvements_roll5 FROM pm")
def _rolling_sum(spark, sf):
    feats = rolling_features(["goals", "assists"], PLAYER_WINDOWS, agg="sum", default=0)
    out = add_prior(player_match(spark, sf), PLAYER, feats)
    return out.select(
        "match_row",
        *(f.out for f in feats),
        (F.col("goals_roll5") + F.col("assists_roll5")).alias("goal_involvements_roll5"),
    )


@query(
    "q_rolling_minp",
    PM
    + f""", r AS (SELECT *, CASE WHEN fouls > 0 THEN yellow / fouls END AS ratio FROM pm)
    SELECT match_row, round(CASE WHEN count(ratio) OVER w >= 3 THEN avg(ratio) OVER w END, 6) AS yellow_per_foul_roll10
    FROM r WINDOW w AS {_PRIOR} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def _rolling_minp(spark, sf):
    from panelwright.functions.rates import ratio_where

    pm = player_match(spark, sf).withColumn("ratio", ratio_where("yellow", "fouls"))
    out = add_prior(pm, PLAYER, [Rolling("ratio", 10, "yellow_per_foul_roll10", min_count=3)])
    return out.select("match_row", _r("yellow_per_foul_roll10"))


@query(
    "q_lifetime_sum",
    PM
    + f""", n AS (SELECT *, row_number() OVER {_PRIOR}) AS i FROM pm)
    SELECT match_row, CASE WHEN i > 1 THEN CAST(sum(goals) OVER {_PRIOR}) - goals AS BIGINT) END AS lifetime_goals,
           CASE WHEN i > 1 THEN CAST(sum(tackles) OVER {_PRIOR}) - tackles AS BIGINT) END AS lifetime_tackles,
           i - 1 AS lifetime_appearances FROM n""",
)
def _lifetime_sum(spark, sf):
    feats = [
        Expanding("goals", "lifetime_goals"),
        Expanding("tackles", "lifetime_tackles"),
        Expanding(None, "lifetime_appearances", "rows"),
    ]
    return add_prior(player_match(spark, sf), PLAYER, feats).select("match_row", *(f.out for f in feats))


@query(
    "q_season_to_date",
    TM
    + """SELECT a.match_id, a.team_no, round(avg(b.goals), 6) AS season_goals, round(avg(b.xg), 8) AS season_xg
    FROM tm AS a LEFT JOIN tm AS b ON a.team_no = b.team_no AND a.season = b.season AND b.d < a.d
    GROUP BY a.match_id, a.team_no""",
)
def _season_to_date(spark, sf):
    feats = [Expanding("goals", "season_goals", "avg"), Expanding("xg", "season_xg", "avg")]
    out = add_prior(team_match(spark, sf), TEAM.within("season"), feats)
    return out.select("match_id", "team_no", _r("season_goals"), _r("season_xg", 8))


@query(
    "q_season_cum",
    PM
    + """, c AS (SELECT match_row, COALESCE(sum(touches) OVER w, 0) AS m,
             row_number() OVER (PARTITION BY player_id, season ORDER BY ts, match_row) - 1 AS apps
    FROM pm WINDOW w AS (PARTITION BY player_id, season ORDER BY ts, match_row
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT match_row, CAST(m AS BIGINT) AS current_season_touches, apps AS current_season_apps,
           round(m / CASE WHEN apps = 0 THEN 1 ELSE apps END, 6) AS current_season_touches_per_app FROM c""",
)
def _season_cum(spark, sf):
    from panelwright.operators.windows import add_prior

    feats = [
        Expanding("touches", "current_season_touches", default=0),
        Expanding(None, "current_season_apps", "rows"),
    ]
    out = add_prior(player_match(spark, sf), PLAYER.within("season"), feats)
    per_app = F.col("current_season_touches") / F.greatest(F.col("current_season_apps"), F.lit(1))
    return out.select(
        "match_row", *(f.out for f in feats), F.round(per_app, 6).alias("current_season_touches_per_app")
    )


@query(
    "q_ffill",
    PM
    + f"""SELECT match_row, last_value(CASE WHEN goals > 0 THEN minutes END IGNORE NULLS) OVER
      {_PRIOR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS minutes_at_last_goal FROM pm""",
)
def _ffill(spark, sf):
    pm = player_match(spark, sf).withColumn("at_goal", F.when(F.col("goals") > 0, F.col("minutes")))
    return add_prior(pm, PLAYER, [FillPrior("at_goal", "minutes_at_last_goal")]).select(
        "match_row", "minutes_at_last_goal"
    )


@query(
    "q_gap_since",
    PM
    + """SELECT a.match_row, a.d - max(b.d) AS days_since_goal FROM pm AS a
    LEFT JOIN pm AS b ON a.player_id = b.player_id AND b.goals > 0 AND (b.ts, b.match_row) < (a.ts, a.match_row)
    GROUP BY a.match_row, a.d""",
)
def _gap_since(spark, sf):
    out = W.gap_since(player_match(spark, sf), PLAYER, "d", F.col("goals") > 0, "days_since_goal")
    return out.select("match_row", "days_since_goal")


@query(
    "q_tail_mean",
    PM
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, match_row DESC) AS rn FROM pm)
    SELECT player_id, count(*) AS n_rows, round(avg(goals), 6) AS goals, round(avg(touches), 6) AS touches
    FROM r WHERE rn <= 20 GROUP BY player_id HAVING count(*) >= 3""",
)
def _tail_mean(spark, sf):
    out = W.tail_mean(player_match(spark, sf), PLAYER, ["goals", "touches"], 20, min_rows=3)
    return out.select("player_id", "n_rows", _r("goals"), _r("touches"))


@query(
    "q_ewm",
    TM
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY team_no ORDER BY season, gameweek, match_id) AS i FROM tm)
    SELECT a.match_id, a.team_no,
           round(sum(power(2.0 / 3, a.i - b.i) * b.shots) / sum(power(2.0 / 3, a.i - b.i)), 6) AS shots_ewm
    FROM n AS a LEFT JOIN n AS b ON a.team_no = b.team_no AND b.i < a.i GROUP BY a.match_id, a.team_no""",
)
def _ewm(spark, sf):
    out = W.ewm_prior(team_match(spark, sf), TEAM, "shots", 5, "shots_ewm")
    return out.select("match_id", "team_no", _r("shots_ewm"))


@query(
    "q_venue_season",
    TM
    + """, v AS (SELECT *,
        avg(goals) OVER (PARTITION BY team_no, season, is_home ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g,
        avg(goals) OVER (PARTITION BY team_no, season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
      FROM tm)
    SELECT match_id, team_no, round(COALESCE(g, s), 6) AS goals_here,
      round(last_value(CASE WHEN is_home = 1 THEN g END IGNORE NULLS) OVER w, 6) AS goals_yes,
      round(last_value(CASE WHEN is_home = 0 THEN g END IGNORE NULLS) OVER w, 6) AS goals_no
    FROM v WINDOW w AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _venue_season(spark, sf):
    tm = add_prior(team_match(spark, sf), TEAM.within("season"), [Expanding("goals", "season_goals", "avg")])
    out = W.conditional_expanding(tm, TEAM, "season", "is_home", ["goals"], {"goals": "season_goals"})
    return out.select("match_id", "team_no", _r("goals_here"), _r("goals_yes"), _r("goals_no"))


@query(
    "q_group_size",
    PM
    + "SELECT match_row, count(*) OVER (PARTITION BY player_id, d) AS n_in_group FROM pm",
)
def _group_size(spark, sf):
    return W.group_size(player_match(spark, sf), ["player_id", "d"]).select("match_row", "n_in_group")


@query(
    "q_tier_award",
    PM
    + """, r AS (SELECT match_row, match_id, touches, dense_rank() OVER (PARTITION BY match_id ORDER BY touches DESC) AS rk
      FROM pm WHERE touches > 0)
    SELECT pm.match_row, CASE WHEN rk <= 3 THEN CAST(4 - rk AS INTEGER) ELSE 0 END AS award
    FROM pm LEFT JOIN r ON pm.match_row = r.match_row""",
)
def _tier_award(spark, sf):
    return W.tier_award(player_match(spark, sf), ["match_id"], "touches", "award").select("match_row", "award")


_DENSE = (
    PM
    + """, seen AS (SELECT player_id, season, gameweek, sum(touches) AS touches, max(CAST(minutes >= 60 AS INTEGER)) AS was_starter
      FROM pm GROUP BY player_id, season, gameweek),
    b AS (SELECT player_id, season, min(gameweek) AS lo, max(gameweek) AS hi FROM seen GROUP BY player_id, season),
    grid AS (SELECT player_id, season, unnest(range(lo, hi + 1)) AS gameweek FROM b)
    """
)


@query(
    "q_densify",
    _DENSE
    + """SELECT grid.player_id, grid.season, grid.gameweek, CAST(COALESCE(touches, 0) AS BIGINT) AS touches,
       COALESCE(was_starter, 0) AS was_starter
    FROM grid LEFT JOIN seen ON grid.player_id = seen.player_id AND grid.season = seen.season
      AND grid.gameweek = seen.gameweek""",
)
def _densify(spark, sf):
    pm = player_match(spark, sf).withColumn("was_starter", (F.col("minutes") >= 60).cast("int"))
    return W.densify(pm, ["player_id", "season"], "gameweek", ["touches"], ["was_starter"])


_cal = """, base AS (SELECT player_id, season, gameweek, sum(minutes) AS minutes, max(CAST(minutes >= 60 AS INTEGER)) AS st,
      max(CAST(minutes >= 89 AS INTEGER)) AS fl FROM pm GROUP BY player_id, season, gameweek),
    g AS (SELECT grid.*, COALESCE(base.minutes, 0) AS minutes, COALESCE(st, 0) AS st, COALESCE(fl, 0) AS fl,
        CASE WHEN base.minutes > 0 THEN grid.gameweek END AS app
      FROM grid LEFT JOIN base ON grid.player_id = base.player_id AND grid.season = base.season
        AND grid.gameweek = base.gameweek)
    SELECT a.player_id, a.season, a.gameweek,
      round(max(b.minutes) FILTER (WHERE b.gameweek = a.gameweek - 1), 6) AS last_minutes,
      COALESCE(max(b.st) FILTER (WHERE b.gameweek = a.gameweek - 1), 0) AS last_was_starter,
      COALESCE(max(b.fl) FILTER (WHERE b.gameweek = a.gameweek - 1), 0) AS last_was_full_90,
      a.gameweek - max(b.app) AS gap_since_last, """ + ", ".join(
    f"round(avg(b.{c}) FILTER (WHERE a.gameweek - b.gameweek <= {n}), 6) AS {o}_roll{n}"
    for c, o in (("minutes", "minutes"), ("st", "starter_rate"), ("fl", "full90_rate"))
    for n in PLAYER_WINDOWS
)


@query(
    "q_calendar_minutes",
    _DENSE
    + _cal
    + """ FROM g AS a LEFT JOIN g AS b ON a.player_id = b.player_id AND a.season = b.season AND b.gameweek < a.gameweek
    GROUP BY a.player_id, a.season, a.gameweek""",
)
def _calendar(spark, sf):
    out = W.calendar_features(player_match(spark, sf), ["player_id"], "season", "gameweek", PLAYER_WINDOWS)
    keep = {"player_id", "season", "gameweek", "last_was_starter", "last_was_full_90", "gap_since_last"}
    return out.select(*(c if c in keep else _r(c) for c in out.columns))


_OWNED = "(PARTITION BY manager_id ORDER BY d, match_id, team_no"


@query(
    "q_owner_roll",
    SIDES
    + f"SELECT match_id, team_no, manager_id, row_number() OVER {_OWNED}) - 1 AS n_prior_games, "
    + ", ".join(f"round(avg({c}) OVER {_OWNED} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 8) AS {c}_form" for c in O.PROFILE)
    + " FROM games",
)
def _owner_roll(spark, sf):
    """Each side's 14 columns, averaged over its manager's last 20 games, whichever side they led."""
    pm = player_match(spark, sf)
    listed = sides(pm)
    stays = O.spells(listed, ["team_no"], "manager_id", "d")
    known = O.point_in_time(listed.drop("manager_id"), stays, ["team_no"], "d", ["manager_id"], width=8)
    out = O.owner_form(O.match_profile(pm, known), "manager_id", ["d", "match_id", "team_no"])
    return out.select("match_id", "team_no", "manager_id", "n_prior_games", *(F.round(f"{c}_form", 8).alias(f"{c}_form") for c in O.PROFILE))


@query(
    "q_matchup_top5",
    TM
    + """, f AS (SELECT match_row, player_id, position, season, gameweek, match_id, team_no, opp_no, ts,
        avg(xg) OVER w AS xg5 FROM pm WINDOW w AS (PARTITION BY player_id ORDER BY ts, match_row
          ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    conceded AS (SELECT a.match_id, a.d, a.team_no, a.season, b.goals + a.own_goal AS goals_conceded
      FROM tm AS a LEFT JOIN tm AS b ON a.match_id = b.match_id AND b.team_no = a.opp_no),
    c5 AS (SELECT match_id, team_no, avg(goals_conceded) OVER (PARTITION BY team_no ORDER BY d
          ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS conceded5 FROM conceded),
    s AS (SELECT position, player_id, match_row, round(xg5 * conceded5, 6) AS xg_x_opp_conceded
      FROM f JOIN c5 ON f.match_id = c5.match_id AND f.opp_no = c5.team_no WHERE xg5 * conceded5 IS NOT NULL)
    SELECT position, player_id, match_row, xg_x_opp_conceded FROM (
      SELECT *, row_number() OVER (PARTITION BY position ORDER BY xg_x_opp_conceded DESC, match_row) AS rn FROM s)
    WHERE rn <= 5""",
)
def _matchup_top5(spark, sf):
    """Player form against the defence they face: the five best rows per position."""
    from panelwright.operators.aggregates import goals_conceded
    from panelwright.operators.ranking import top_k_per

    pm = player_match(spark, sf)
    form = add_prior(pm, PLAYER, [Rolling("xg", 5, "xg5")])
    conceded = add_prior(goals_conceded(team_match(spark, sf)), TEAM, [Rolling("goals_conceded", 5, "conceded5")])
    opp = conceded.select("match_id", F.col("team_no").alias("opp_no"), "conceded5")
    scored = (
        form.join(opp, ["match_id", "opp_no"])
        .withColumn("xg_x_opp_conceded", F.round(F.col("xg5") * F.col("conceded5"), 6))
        .where(F.col("xg_x_opp_conceded").isNotNull())
    )
    top = top_k_per(scored, ["position"], [F.desc("xg_x_opp_conceded"), F.asc("match_row")], 5)
    return top.select("position", "player_id", "match_row", "xg_x_opp_conceded")


@query(
    "q_future_union",
    PM
    + """, last_day AS (SELECT max(d) AS m FROM pm),
    ids AS (SELECT DISTINCT player_id FROM pm, last_day WHERE d = m),
    r AS (SELECT pm.*, row_number() OVER (PARTITION BY pm.player_id ORDER BY ts DESC, match_row DESC) AS rn
      FROM pm JOIN ids ON pm.player_id = ids.player_id)
    SELECT player_id, round(avg(touches) FILTER (WHERE rn <= 3), 6) AS touches_roll3,
      round(avg(touches) FILTER (WHERE rn <= 10), 6) AS touches_roll10, CAST(sum(goals) AS BIGINT) AS lifetime_goals
    FROM r GROUP BY player_id""",
)
def _future_union(spark, sf):
    pm = player_match(spark, sf)
    last_day = pm.agg(F.max("d")).scalar()
    ahead = F.lit(1)
    future = (
        pm.where(F.col("d") == last_day)
        .groupBy("player_id")
        .agg(F.max("ts").alias("ts"), F.max("slot").alias("slot"))
        .select(
            "player_id",
            (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"),
            (F.col("slot") + 24 * ahead).alias("slot"),
            F.lit(-1).cast("long").alias("match_row"),
        )
    )
    feats = [*rolling_features(["touches"], [3, 10]), Expanding("goals", "lifetime_goals")]
    out = W.features_for_future(pm, future, ["player_id"], lambda both: add_prior(both, PLAYER, feats))
    return out.select("player_id", _r("touches_roll3"), _r("touches_roll10"), "lifetime_goals")
