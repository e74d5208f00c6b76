"""Aggregates, derived features, probability rules and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import probability as M, rates as D
from panelwright.operators import aggregates as A, metrics as E, ranking as K
from panelwright.operators.windows import Expanding, Rolling, add_prior, rolling_features
from panelwright.plans.registry import query
from panelwright.semantics import persisted
from panelwright.plans.standins import PLAYER, PM, RUNS, TEAM, TM, player_match, run_results, runs, table, team_match


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# ---- aggregates ----------------------------------------------------------


@query(
    "q_team_totals",
    PM
    + """, t AS (SELECT team_no, season, gameweek, sum(goals) AS g, sum(shots) AS s FROM pm GROUP BY 1, 2, 3),
    o AS (SELECT opp_no, season, gameweek, sum(own_goal) AS og FROM pm WHERE opp_no IS NOT NULL GROUP BY 1, 2, 3)
    SELECT t.team_no, t.season, t.gameweek, CAST(g + COALESCE(og, 0) AS BIGINT) AS team_goals, CAST(s AS BIGINT) AS team_shots
    FROM t LEFT JOIN o ON t.team_no = o.opp_no AND t.season = o.season AND t.gameweek = o.gameweek""",
)
def _team_totals(spark, sf):
    return A.team_totals(player_match(spark, sf), ["season", "gameweek"], "team_no", "opp_no", ["goals", "shots"])


@query(
    "q_collapse",
    PM
    + """SELECT player_id, season, gameweek, CAST(sum(touches) AS BIGINT) AS touches, max(goals) AS goals, max(is_home) AS is_home
    FROM pm GROUP BY player_id, season, gameweek""",
)
def _collapse(spark, sf):
    return A.collapse(player_match(spark, sf), ["player_id", "season", "gameweek"], ["touches"], ["goals", "is_home"])


_WIDE = ["goals", "own_goal", "tackles", "interceptions", "clearances", "blocks", "saves", "touches", "key_passes", "shots"]


@query(
    "q_team_match",
    PM
    + f"""SELECT match_id, team_no, opp_no, is_home, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _WIDE)},
      arg_min(CASE WHEN goals > 0 THEN player_id END, CASE WHEN goals > 0 THEN match_row END) AS first_scorer
    FROM pm WHERE opp_no IS NOT NULL GROUP BY match_id, team_no, opp_no, is_home""",
)
def _team_match(spark, sf):
    pm = player_match(spark, sf).withColumn("first_scorer", F.when(F.col("goals") > 0, F.col("player_id")))
    return A.team_match(pm, ["match_id", "team_no", "opp_no", "is_home"], _WIDE, ["first_scorer"], "match_row")


@query(
    "q_gf_ga",
    TM
    + """, sides AS (SELECT DISTINCT d * 100 + least(t, o) AS match_id, t AS team_no FROM (SELECT DISTINCT d FROM pm) AS days,
        (SELECT a.range AS t, b.range AS o FROM range(20) AS a, range(20) AS b) AS p WHERE t <> o AND ((d - t) % 20 + 20) % 20 = o)
    SELECT s.match_id, s.team_no,
      CASE WHEN a.team_no IS NOT NULL OR b.team_no IS NOT NULL THEN COALESCE(a.goals, 0) + COALESCE(b.own_goal, 0) END AS gf,
      CASE WHEN a.team_no IS NOT NULL OR b.team_no IS NOT NULL THEN COALESCE(b.goals, 0) + COALESCE(a.own_goal, 0) END AS ga
    FROM sides AS s LEFT JOIN tm AS a ON a.match_id = s.match_id AND a.team_no = s.team_no
    LEFT JOIN tm AS b ON b.match_id = s.match_id AND b.team_no <> s.team_no""",
)
def _gf_ga(spark, sf):
    days = player_match(spark, sf).select("d").distinct()
    team = days.select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("team_no"))
    opp = F.pmod(F.col("d") - F.col("team_no"), F.lit(20))
    sides = team.where(opp != F.col("team_no")).select(
        (F.col("d") * 100 + F.least("team_no", opp)).alias("match_id"), "team_no"
    )
    return A.goals_for_against(sides, team_match(spark, sf))


@query(
    "q_distribution_profile",
    PM
    + """, m AS (SELECT match_id, team_no, floor(minutes) AS v FROM pm WHERE opp_no IS NOT NULL AND floor(minutes) > 0),
    t AS (SELECT *, sum(v) OVER (PARTITION BY match_id, team_no) AS total,
        row_number() OVER (PARTITION BY match_id, team_no ORDER BY v DESC) AS rn FROM m)
    SELECT match_id, team_no, round(avg(v), 6) AS mins_mean, quantile_cont(v, 0.5) AS mins_median, round(stddev_pop(v), 6) AS mins_std,
      max(v) AS mins_max, count(*) AS num_players_used, count(*) FILTER (WHERE v >= 89) AS num_full_90,
      greatest(count(*) - 11, 0) AS num_subs_made, round(sum(v) FILTER (WHERE rn <= 11) / max(total), 6) AS mins_concentration_top11,
      round(-sum(v / total * ln(v / total + 1e-12)), 6) AS mins_entropy
    FROM t GROUP BY match_id, team_no""",
)
def _profile(spark, sf):
    pm = player_match(spark, sf).where("opp_no IS NOT NULL").withColumn("v", F.floor("minutes").cast("double"))
    out = A.distribution_profile(pm, ["match_id", "team_no"], "v")
    exact = {"match_id", "team_no", "mins_median", "mins_max", "num_players_used", "num_full_90", "num_subs_made"}
    return out.select(*(c if c in exact else r6(c) for c in out.columns))


@query(
    "q_bounds",
    PM + "SELECT player_id, season, min(gameweek) AS gameweek_min, max(gameweek) AS gameweek_max FROM pm GROUP BY player_id, season",
)
def _bounds(spark, sf):
    return A.bounds(player_match(spark, sf), ["player_id", "season"], "gameweek")


@query(
    "q_season_rates",
    TM
    + """SELECT team_no, round(avg(goals), 6) AS season_goals_per_game, round(avg(shots), 6) AS season_shots_per_game
    FROM tm WHERE season = 2 GROUP BY team_no""",
)
def _season_rates(spark, sf):
    out = A.season_rates(team_match(spark, sf), "team_no", F.col("season") == 2, ["goals", "shots"])
    return out.select("team_no", r6("season_goals_per_game"), r6("season_shots_per_game"))


@query(
    "q_league_mean",
    TM
    + """, c AS (SELECT b.goals + a.own_goal AS gc FROM tm AS a LEFT JOIN tm AS b ON a.match_id = b.match_id AND b.team_no = a.opp_no)
    SELECT round(CASE WHEN avg(gc) < 0.5 THEN 1.3 ELSE COALESCE(avg(gc), 1.3) END, 6) AS league_mean FROM c""",
)
def _league_mean(spark, sf):
    return A.league_mean(A.goals_conceded(team_match(spark, sf)), "goals_conceded").select(r6("league_mean"))


@query(
    "q_aggregate_multi",
    PM
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY player_id, d ORDER BY ts, match_row) AS fx FROM pm WHERE opp_no IS NOT NULL)
    SELECT player_id, d, CAST(sum(goals) AS BIGINT) AS goals, round(avg(shots), 6) AS shots, arg_min(position, fx) AS position,
      string_agg(CAST(touches AS VARCHAR), ', ' ORDER BY fx) AS touches, list(is_home ORDER BY fx) AS is_home, count(*) AS fixture_num
    FROM n GROUP BY player_id, d""",
)
def _aggregate_multi(spark, sf):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("player_id", "d").orderBy("ts", "match_row"))
    df = player_match(spark, sf).where("opp_no IS NOT NULL").withColumn("fx", rn)
    out = A.aggregate_multi(df, ["player_id", "d"], "fx", ["goals"], ["shots"], ["position"], ["touches"], ["is_home"])
    return out.withColumn("shots", F.round("shots", 6))


@query("q_count_by", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def _count_by(spark, sf):
    return A.count_by(table(spark, sf, "events"), "event_type")


_MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "q_pivot_runs",
    RUNS
    + ", latest AS (SELECT run_id, row_number() OVER (ORDER BY started DESC, run_id DESC) AS k FROM runs) SELECT model, "
    + ", ".join(f"min(score) FILTER (WHERE k = {i}) AS run_{i}" for i in range(1, 6))
    + " FROM results JOIN latest ON results.run_id = latest.run_id WHERE k <= 5 GROUP BY model",
)
def _pivot(spark, sf):
    return A.compare_runs(run_results(spark, sf), runs(spark, sf), 5)


# ---- ranking -------------------------------------------------------------


@query("q_top_n", PM + "SELECT match_row, player_id, minutes, touches FROM pm ORDER BY minutes DESC, match_row LIMIT 30")
def _top_n(spark, sf):
    return K.top_n(player_match(spark, sf), 30, "minutes", ["match_row"], ["match_row", "player_id", "absent", "minutes", "touches"])


@query(
    "q_top_k_group",
    """SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""",
)
def _top_k(spark, sf):
    out = K.top_k_per(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)
    return out.select("p_brand", "p_partkey", "p_retailprice")


@query("q_best_run", RUNS + "SELECT model, run_id, score FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, run_id) AS rn FROM results) WHERE rn = 1")
def _best_run(spark, sf):
    return K.best_run(run_results(spark, sf)).select("model", "run_id", "score")


@query(
    "q_history_lookup",
    "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE lower(p_name) LIKE '%ring%' AND p_size = 7 ORDER BY p_retailprice DESC, p_partkey",
)
def _history_lookup(spark, sf):
    out = K.lookup_predictions(table(spark, sf, "part"), "p_retailprice", ["p_partkey"], p_name_contains="RING", p_size=7, p_brand=None)
    return out.select("p_partkey", "p_name", "p_size", "p_retailprice")


# ---- derived features ----------------------------------------------------


@query(
    "q_per90",
    PM
    + """SELECT match_row, round(CASE WHEN minutes >= 20 THEN least(shots / greatest(minutes / 90, 0.01), 8.0) END, 6) AS shots_per90,
      round(CASE WHEN minutes >= 20 THEN least(fouls / greatest(minutes / 90, 0.01), 6.0) END, 6) AS fouls_per90,
      round(tackles / greatest(minutes / 90, 0.01), 6) AS tackles_per90_raw FROM pm""",
)
def _per90(spark, sf):
    out = D.rate_per(player_match(spark, sf), ["shots", "fouls"])
    return out.select("match_row", r6("shots_per90"), r6("fouls_per90"), r6(D.per90("tackles", "minutes", None), "tackles_per90_raw"))


@query(
    "q_lifetime_rate",
    PM
    + """, l AS (SELECT match_row, sum(shots) OVER w AS s, COALESCE(CAST(sum(CAST(minutes AS DECIMAL(18, 2))) OVER w AS DOUBLE), 0) AS m FROM pm
      WINDOW w AS (PARTITION BY player_id ORDER BY ts, match_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT match_row, round(CASE WHEN m >= 90 THEN least(COALESCE(s, 0) / greatest(m / 90, 0.01), 8.0) ELSE 0 END, 6) AS lifetime_shots_per90 FROM l""",
)
def _lifetime_rate(spark, sf):
    pm = player_match(spark, sf).withColumn("exact_minutes", F.col("minutes").cast("decimal(18,2)"))
    out = add_prior(pm, PLAYER, [Expanding("shots", "s"), Expanding("exact_minutes", "m")])
    minutes = F.coalesce(F.col("m").cast("double"), F.lit(0.0))
    return out.select("match_row", r6(D.lifetime_rate("s", minutes, 8.0), "lifetime_shots_per90"))


@query(
    "q_share",
    PM
    + """, t AS (SELECT team_no, season, gameweek, sum(shots) AS ts_ FROM pm GROUP BY 1, 2, 3),
    s AS (SELECT pm.*, CASE WHEN minutes >= 20 AND ts_ > 0 THEN shots / greatest(ts_, 0.1) END AS shot_share
      FROM pm JOIN t ON pm.team_no = t.team_no AND pm.season = t.season AND pm.gameweek = t.gameweek)
    SELECT match_row, round(shot_share, 6) AS shot_share, round(avg(shot_share) OVER (PARTITION BY player_id ORDER BY ts, match_row
      ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS shot_share_roll5 FROM s""",
)
def _share(spark, sf):
    pm = player_match(spark, sf)
    keys = ["team_no", "season", "gameweek"]
    totals = pm.groupBy(*keys).agg(F.sum("shots").alias("team_shots"))
    shared = pm.join(totals, keys).withColumn("shot_share", D.share_of("shots", "team_shots", "minutes"))
    out = add_prior(shared, PLAYER, [Rolling("shot_share", 5, "shot_share_roll5")])
    return out.select("match_row", r6("shot_share"), r6("shot_share_roll5"))


_FORM_W = "PARTITION BY player_id ORDER BY ts, match_row ROWS BETWEEN"
_FORM = (
    PM
    + ", f AS (SELECT pm.*, "
    + ", ".join(
        f"avg({c}) OVER ({_FORM_W} {n} PRECEDING AND 1 PRECEDING) AS {c}{n}" for c in ("goals", "xg", "shots", "touches") for n in (3, 5, 10)
    )
    + " FROM pm) "
)


def _form(spark, sf):
    feats = [Rolling(c, n, f"{c}{n}") for c in ("goals", "xg", "shots", "touches") for n in (3, 5, 10)]
    return add_prior(player_match(spark, sf), PLAYER, feats)


@query("q_trend", _FORM + "SELECT match_row, round(shots3 - shots10, 6) AS shots_trend, round(touches5 - touches10, 6) AS touches_trend FROM f")
def _trend(spark, sf):
    return _form(spark, sf).select(
        "match_row", r6(D.trend("shots3", "shots10"), "shots_trend"), r6(D.trend("touches5", "touches10"), "touches_trend")
    )


@query("q_overperf", _FORM + "SELECT match_row, round(goals10 - xg10, 8) AS xg_overperformance_roll10 FROM f")
def _overperf(spark, sf):
    return _form(spark, sf).select(
        "match_row", F.round(D.overperformance("goals10", "xg10"), 8).alias("xg_overperformance_roll10")
    )


@query(
    "q_interact",
    _FORM
    + """SELECT match_row, round(COALESCE(shots5, 0) * COALESCE(touches5, 0), 6) AS shots_x_touches, round(shots5 * goals5, 6) AS shots_x_goals,
      round(COALESCE(shots5, 1.0) / (COALESCE(goals5, 1.0) + 0.01), 6) AS shots_div_goals FROM f""",
)
def _interact(spark, sf):
    return _form(spark, sf).select(
        "match_row",
        r6(D.interact("shots5", "touches5"), "shots_x_touches"),
        r6(D.interact("shots5", "goals5", None), "shots_x_goals"),
        r6(D.damped_ratio("shots5", "goals5"), "shots_div_goals"),
    )


@query(
    "q_weighted_score",
    _FORM
    + """SELECT match_row, round(COALESCE(touches5, 60) / 90 * 0.4 + COALESCE(goals5, 0.5) * 0.4 + COALESCE(goals3, 0.5) * 0.2, 6) AS starter_score FROM f""",
)
def _weighted(spark, sf):
    return _form(spark, sf).select("match_row", r6(D.starter_score("touches5", "goals5", "goals3"), "starter_score"))


_STATE = """, gc AS (SELECT a.*, b.goals + a.own_goal AS goals_conceded, b.shots AS xga
      FROM tm AS a LEFT JOIN tm AS b ON a.match_id = b.match_id AND b.team_no = a.opp_no),
    lg AS (SELECT CASE WHEN avg(goals_conceded) < 0.5 THEN 1.3 ELSE avg(goals_conceded) END AS m FROM gc),
    v AS (SELECT *, avg(goals_conceded) OVER (PARTITION BY team_no, season, is_home ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS here,
      avg(goals_conceded) OVER (PARTITION BY team_no, season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sc,
      avg(goals) OVER (PARTITION BY team_no, season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sg FROM gc)
"""


def _venue(spark, sf):
    from panelwright.operators.windows import conditional_expanding

    gc = A.goals_conceded(persisted(team_match(spark, sf), "sides"))
    tm = add_prior(
        gc, TEAM.within("season"), [Expanding("goals_conceded", "season_conceded", "avg"), Expanding("goals", "season_goals", "avg")]
    )
    out = conditional_expanding(tm, TEAM, "season", "is_home", ["goals_conceded"], {"goals_conceded": "season_conceded"})
    return gc, out


@query(
    "q_prior_rate",
    TM
    + _STATE
    + """, p AS (SELECT v.match_id, v.team_no, COALESCE(v.here, v.sc, m) * (COALESCE(o.sg, m) / m) AS lam
      FROM v CROSS JOIN lg LEFT JOIN v AS o ON o.match_id = v.match_id AND o.team_no = v.opp_no)
    SELECT match_id, team_no, round(lam, 6) AS prior_lambda, round(exp(-lam), 6) AS naive_cs_prob FROM p""",
)
def _prior_rate(spark, sf):
    gc, tm = _venue(spark, sf)
    opp = tm.select("match_id", F.col("team_no").alias("opp_no"), F.col("season_goals").alias("opp_season_goals"))
    df = tm.join(opp, ["match_id", "opp_no"], "left").withColumn("league", A.league_mean(gc, "goals_conceded").scalar())
    lam = D.prior_rate(["goals_conceded_here", "season_conceded"], ["opp_season_goals"], F.col("league"))
    return df.select("match_id", "team_no", r6(lam, "prior_lambda"), r6(F.exp(-lam), "naive_cs_prob"))


@query(
    "q_matchup",
    TM
    + _STATE
    + """, w AS (SELECT *, last_value(CASE WHEN is_home = 1 THEN here END IGNORE NULLS) OVER u AS hy,
        last_value(CASE WHEN is_home = 0 THEN here END IGNORE NULLS) OVER u AS hn,
        avg(goals) OVER (PARTITION BY team_no ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS scored5,
        avg(goals_conceded) OVER (PARTITION BY team_no ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS conceded5
      FROM v WINDOW u AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_no ORDER BY d DESC) AS rn FROM w) WHERE rn = 1),
    cur AS (SELECT team_no, avg(goals) AS g FROM tm WHERE season = (SELECT max(season) FROM tm) GROUP BY team_no),
    fx AS (SELECT DISTINCT match_id, team_no, opp_no, is_home FROM tm WHERE d = (SELECT max(d) FROM tm)),
    j AS (SELECT fx.*, a.conceded5 AS conceded5, COALESCE(b.scored5, c.g, m) AS opp_scored5,
      COALESCE(CASE WHEN fx.is_home = 1 THEN a.hy ELSE a.hn END, a.here, a.sc, m) * (COALESCE(c.g, m) / m) AS lam
      FROM fx CROSS JOIN lg LEFT JOIN st AS a ON a.team_no = fx.team_no LEFT JOIN st AS b ON b.team_no = fx.opp_no LEFT JOIN cur AS c ON c.team_no = fx.opp_no)
    SELECT match_id, team_no, round(lam, 6) AS prior_lambda, round(exp(-lam), 6) AS naive_cs_prob,
      round(COALESCE(conceded5, 1.0) * opp_scored5, 6) AS conceded_x_opp, round(COALESCE(conceded5, 1.0) / (opp_scored5 + 0.01), 6) AS conceded_div_opp FROM j""",
)
def _matchup(spark, sf):
    from panelwright.operators.matchups import latest_team_state, matchup_rows

    gc, tm = _venue(spark, sf)
    last = tm.agg(F.max("d")).scalar()
    fx = tm.where(F.col("d") == last).select("match_id", "team_no", "opp_no", "is_home")
    state = latest_team_state(tm, TEAM)
    rates = A.season_rates(gc, "team_no", F.col("season") == gc.agg(F.max("season")).scalar(), ["goals"])
    out = matchup_rows(state, rates, fx, A.league_mean(gc, "goals_conceded"))
    return out.select(
        "match_id", "team_no", r6("prior_lambda"), r6("naive_cs_prob"), r6("conceded_x_opp"), r6("conceded_div_opp")
    )


@query(
    "q_refresh_state",
    TM
    + """, r AS (SELECT team_no, avg(goals) OVER w AS g5, avg(shots) OVER w AS s5, row_number() OVER (PARTITION BY team_no ORDER BY d DESC) AS rn FROM tm
      WINDOW w AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT match_row, round(COALESCE(g5, -1.0), 6) AS opp_goals5, round(COALESCE(s5, -1.0), 6) AS opp_shots5
    FROM pm LEFT JOIN r ON pm.opp_no = r.team_no AND r.rn = 1""",
)
def _refresh(spark, sf):
    from panelwright.operators.matchups import refresh_state

    tm = add_prior(team_match(spark, sf), TEAM, rolling_features(["goals", "shots"], [5]))
    latest = K.latest_before(tm, ["team_no"], ["season", "gameweek", "match_id"], ["goals_roll5", "shots_roll5"])
    stale = player_match(spark, sf).withColumns({"opp_goals5": F.lit(-1.0), "opp_shots5": F.lit(-1.0)})
    out = refresh_state(stale, latest, "opp_no", "team_no", {"goals_roll5": "opp_goals5", "shots_roll5": "opp_shots5"})
    return out.select("match_row", r6("opp_goals5"), r6("opp_shots5"))


_BASE = ["key_passes", "tackles", "interceptions", "recoveries", "clearances", "blocks", "shots"]


@query(
    "q_baseline_points",
    PM
    + f"""SELECT match_row, round(CASE WHEN minutes >= 60 THEN 6.0 WHEN minutes >= 1 THEN 3.0 ELSE 0.0 END
      + minutes / 90 * (key_passes + 2 * tackles + interceptions + recoveries + clearances + blocks + 0.8 * shots), 6) AS baseline,
      CAST(greatest(touches - goals * CASE position WHEN 0 THEN 12 WHEN 1 THEN 12 WHEN 2 THEN 18 ELSE 24 END - assists * 9
        - own_goal * CASE position WHEN 0 THEN 12 WHEN 1 THEN 12 ELSE 0 END, 0) AS BIGINT) AS residual FROM pm""",
)
def _baseline(spark, sf):
    pm = player_match(spark, sf)
    rated = pm.select("*", *(F.col(c).alias(f"{c}_rate") for c in _BASE), M.position_label("position").alias("label"))
    residual = D.residual_points(
        "touches",
        "goals",
        "assists",
        "own_goal",
        M.by_class("label", M.AWARD_SCORE["goal"], 18),
        M.by_class("label", M.AWARD_SCORE["clean_sheet"], 0),
    )
    return rated.select("match_row", r6(D.linear_points(rated, suffix="_rate"), "baseline"), residual.alias("residual"))


@query(
    "q_reliability",
    PM
    + """SELECT match_row, round(CASE WHEN minutes >= 10 AND yellow = 0 THEN touches * least(greatest(value_ / 300, 0.3), 1.0)
      * least(minutes / 90, 1.0) ELSE 0.0 END, 6) AS scaled FROM (SELECT *, COALESCE(CAST(opp_no * 25 AS DOUBLE), 300) AS value_ FROM pm)""",
)
def _reliability(spark, sf):
    scaled = D.reliability_scale("touches", F.col("opp_no") * F.lit(25.0), "minutes", F.col("yellow") == 0)
    return player_match(spark, sf).select("match_row", r6(scaled, "scaled"))


# ---- probability ---------------------------------------------------------

_FACT = "1.0, 1.0, 2.0, 6.0, 24.0, 120.0, 720.0, 5040.0, 40320.0, 362880.0, 3628800.0"


def _pmf(k, lam="lam"):
    return f"exp(-{lam}) * power({lam}, {k}) / ([{_FACT}])[{k} + 1]"


_LAM = PM + ", l AS (SELECT match_row, touches, position, minutes, goals, (touches + 1) / 30.0 AS lam FROM pm) "


def _lam(spark, sf):
    return player_match(spark, sf).withColumn("lam", (F.col("touches") + 1) / F.lit(30.0))


@query(
    "q_poisson",
    _LAM
    + f"SELECT match_row, round({_pmf(0)}, 6) AS p0, round(1 - {_pmf(0)} - {_pmf(1)}, 6) AS two_plus, "
    + f"round(1 - {' - '.join(_pmf(k) for k in range(4))}, 6) AS four_plus FROM l",
)
def _poisson(spark, sf):
    return _lam(spark, sf).select(
        "match_row",
        r6(M.poisson_pmf(0, "lam"), "p0"),
        r6(1 - M.poisson_cdf(1, "lam"), "two_plus"),
        r6(1 - M.poisson_cdf(3, "lam"), "four_plus"),
    )


_FLOOR = (
    "-("
    + " + ".join(f"{_pmf(k)} * {k // 2}" for k in range(2, 11))
    + f" + (1 - ({' + '.join(_pmf(k) for k in range(11))})) * 5)"
)


@query("q_expected_floor", _LAM + f"SELECT match_row, round({_FLOOR}, 6) AS penalty FROM l")
def _floor(spark, sf):
    return _lam(spark, sf).select("match_row", r6(M.expected_floor("lam"), "penalty"))


# oracle by log-gamma, the engine by recurrence
_NB_PMF = "exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(r / (r + mu)) + i * ln(mu / (r + mu)))"


@query(
    "q_nb_tail",
    PM
    + f""", l AS (SELECT match_row, (touches + 1) / 10.0 AS mu, CASE WHEN position = 1 THEN 10 ELSE 12 END AS t, 2.5 AS r FROM pm),
    keys AS (SELECT DISTINCT mu, t, r FROM l), x AS (SELECT mu, t, r, unnest(range(0, t)) AS i FROM keys),
    p AS (SELECT mu, t, 1 - sum({_NB_PMF}) AS nb, 1 - sum(exp(i * ln(mu) - mu - lgamma(i + 1))) AS po FROM x GROUP BY mu, t)
    SELECT match_row, round(greatest(nb, 0), 6) AS nb_prob, round(greatest(po, 0), 6) AS poisson_prob FROM l JOIN p ON l.mu = p.mu AND l.t = p.t""",
)
def _nb_tail(spark, sf):
    pm = player_match(spark, sf).withColumn("mu", (F.col("touches") + 1) / F.lit(10.0))
    bar = F.when(F.col("position") == 1, 10).otherwise(12)
    return pm.select(
        "match_row",
        r6(M.nb_tail(bar, F.lit(2.5), "mu", most=12), "nb_prob"),
        r6(M.nb_tail(bar, F.lit(None).cast("double"), "mu", most=12), "poisson_prob"),
    )


@query(
    "q_dispersion",
    PM
    + """, a AS (SELECT sum(power(touches - mu, 2) / mu) / (count(*) - 1) AS phi, avg(mu) AS m FROM (SELECT touches, greatest((player_id + 1) / 2.0, 0.01) AS mu FROM pm))
    SELECT round(phi, 4) AS phi, round(CASE WHEN phi > 1 THEN greatest(m / (phi - 1), 0.5) END, 6) AS r FROM a""",
)
def _dispersion(spark, sf):
    pm = player_match(spark, sf).withColumn("mu", (F.col("player_id") + 1) / F.lit(2.0))
    return M.nb_dispersion(pm, "touches", "mu").select(F.round("phi", 4).alias("phi"), r6("r"))


@query(
    "q_sharpen",
    PM
    + """, p AS (SELECT match_row, least(greatest(touches / 99.0, 1e-6), 1 - 1e-6) AS p FROM pm)
    SELECT match_row, round(1 / (1 + exp(-ln(p / (1 - p)) / 0.3)), 6) AS sharp FROM p""",
)
def _sharpen(spark, sf):
    return player_match(spark, sf).select("match_row", r6(M.sharpen(F.col("touches") / F.lit(99.0)), "sharp"))


@query(
    "q_log_blend",
    _LAM + "SELECT match_row, round(least(greatest(sqrt(lam * least(greatest(minutes / 7, 1e-6), 10.0)), 1e-6), 10.0), 6) AS blended FROM l",
)
def _log_blend(spark, sf):
    return _lam(spark, sf).select("match_row", r6(M.log_blend("lam", F.col("minutes") / 7), "blended"))


@query("q_mix", PM + "SELECT match_row, round(touches / 99.0 * 80 + (1 - touches / 99.0) * minutes, 6) AS mixed FROM pm")
def _mix(spark, sf):
    return player_match(spark, sf).select("match_row", r6(M.mix(F.col("touches") / F.lit(99.0), F.lit(80.0), "minutes"), "mixed"))


@query(
    "q_cap_minutes",
    PM
    + """, x AS (SELECT match_row, minutes AS pred, touches % 8 AS apps, (touches % 8) * (touches % 91) AS m, touches % 91 AS avg_, player_id % 91 AS recent FROM pm),
    c AS (SELECT *, CASE WHEN apps = 0 THEN least(pred, 30.0) WHEN m < 90 THEN least(pred, greatest(avg_ * 1.2, 15.0))
        WHEN apps >= 3 THEN least(pred, greatest(least(90.0, avg_ * 1.2), 30.0)) ELSE pred END AS capped FROM x)
    SELECT match_row, round(least(greatest(CASE WHEN apps >= 5 AND avg_ >= 80 AND recent >= 80 THEN greatest(capped, 88.0)
        WHEN apps >= 5 AND avg_ >= 80 AND recent >= 70 THEN greatest(capped, 80.0) ELSE capped END, 1.0), 90.0), 6) AS capped FROM c""",
)
def _cap_minutes(spark, sf):
    t = F.col("touches")
    capped = M.cap_minutes("minutes", t % 8, (t % 8) * (t % 91), (t % 91).cast("double"), (F.col("player_id") % 91).cast("double"))
    return player_match(spark, sf).select("match_row", r6(capped, "capped"))


# One set of predictions and outcomes for all point queries.
_PRED = PM + """, s AS (SELECT pm.*, CASE position WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS label,
    least(CAST(touches AS DOUBLE), 90.0) AS pred_minutes, (touches % 10) / 10.0 AS pg, (touches % 7) / 10.0 AS pa, (touches % 5) / 5.0 AS pcs,
    (touches % 30) / 10.0 + 0.1 AS lam, (touches % 4) * 1.0 AS psv, (touches % 9) / 9.0 AS pdc, (touches % 3) * 0.5 AS pb, (touches % 6) / 10.0 AS py,
    (touches % 11) / 100.0 AS pr, touches % 4 AS gc, CAST(CASE WHEN position = 1 THEN clearances + blocks + interceptions + tackles >= 10
      ELSE clearances + blocks + interceptions + tackles + recoveries >= 12 END AS INTEGER) AS hit, CAST(touches % 3 AS BIGINT) AS bonus, 0 AS red FROM pm)
"""


def predicted(spark, sf):
    t = F.col("touches")
    df = D.conditional_metric(player_match(spark, sf))
    return df.withColumns(
        {
            "fpl_position": M.position_label("position"),
            "pred_minutes": F.least(t.cast("double"), F.lit(90.0)),
            "pred_exp_goals": (t % 10) / F.lit(10.0),
            "pred_exp_assists": (t % 7) / F.lit(10.0),
            "pred_cs_prob": (t % 5) / F.lit(5.0),
            "pred_goals_against": (t % 30) / F.lit(10.0) + 0.1,
            "pred_exp_saves": (t % 4) * F.lit(1.0),
            "pred_defcon_prob": (t % 9) / F.lit(9.0),
            "pred_bonus": (t % 3) * F.lit(0.5),
            "pred_yellow_prob": (t % 6) / F.lit(10.0),
            "pred_red_prob": (t % 11) / F.lit(100.0),
            "goals_conceded": t % 4,
            "bonus": t % 3,
            "red": F.lit(0),
        }
    )


_EXP = {
    "exp_goals_pts": "pg * CASE label WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END",
    "exp_assists_pts": "pa * 3",
    "exp_cs_pts": "CASE WHEN pred_minutes >= 60 THEN pcs * CASE label WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END",
    "exp_conceded_penalty": f"CASE WHEN pred_minutes >= 60 AND label IN ('GK', 'DEF') THEN {_FLOOR} ELSE 0 END",
    "exp_saves_pts": "CASE WHEN label = 'GK' THEN psv / 3 ELSE 0 END",
    "exp_defcon_pts": "CASE WHEN pred_minutes >= 60 AND label IN ('DEF', 'MID') THEN pdc * 2 ELSE 0 END",
    "exp_bonus_pts": "pb",
    "exp_yellow_pts": "-py",
    "exp_red_pts": "-3 * pr",
    "exp_appearance_pts": "CASE WHEN pred_minutes >= 60 THEN 2.0 WHEN pred_minutes >= 1 THEN 1.0 ELSE 0.0 END",
}
_ACT = """CASE WHEN minutes >= 1 THEN CASE WHEN minutes >= 60 THEN 2 ELSE 1 END
    + goals * CASE label WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END + assists * 3
    + CASE WHEN minutes >= 60 AND gc = 0 THEN CASE label WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END
    - CASE WHEN minutes >= 60 AND label IN ('GK', 'DEF') THEN gc // 2 ELSE 0 END + CASE WHEN label = 'GK' THEN saves // 3 ELSE 0 END
    + CASE WHEN minutes >= 60 AND label IN ('DEF', 'MID') THEN hit * 2 ELSE 0 END {cards} ELSE 0 END"""
_ACT_CARDS = _ACT.format(cards="- yellow")


@query(
    "q_expected_points",
    _PRED
    + "SELECT match_row, "
    + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _EXP.items())
    + f", round({' + '.join(f'({v})' for v in _EXP.values())}, 6) AS exp_total_pts FROM s",
)
def _expected(spark, sf):
    out = M.expected_points(predicted(spark, sf))
    return out.select("match_row", *(r6(c) for c in _EXP), r6("exp_total_pts"))


@query(
    "q_actual_points",
    _PRED + f"SELECT match_row, CAST({_ACT_CARDS} AS BIGINT) AS with_cards, CAST({_ACT.format(cards='')} AS BIGINT) AS without_cards FROM s",
)
def _actual(spark, sf):
    df = predicted(spark, sf)
    return df.select("match_row", M.actual_points(df).alias("with_cards"), M.actual_points(df, include_cards=False).alias("without_cards"))


@query("q_rate_to_prob", PM + "SELECT match_row, round(least(greatest(tackles, 0), 6) * (minutes / 90) * 0.004, 8) AS pred_red FROM pm")
def _rate_to_prob(spark, sf):
    return player_match(spark, sf).select(
        "match_row", F.round(M.rate_to_prob(F.col("tackles").cast("double"), "minutes"), 8).alias("pred_red")
    )


@query("q_scale_exposure", PM + "SELECT match_row, round(saves * (minutes / 90), 6) AS exp_saves, round(saves * (minutes / 90) / 3, 6) AS saves_pts FROM pm")
def _scale(spark, sf):
    e = M.scale_exposure("saves", "minutes")
    return player_match(spark, sf).select("match_row", r6(e, "exp_saves"), r6(e / 3, "saves_pts"))


@query(
    "q_any_of",
    PM + "SELECT player_id, d, round(1 - product(1 - touches / 99.0), 6) AS at_least_once FROM pm GROUP BY player_id, d",
)
def _any_of(spark, sf):
    df = player_match(spark, sf).withColumn("p", F.col("touches") / F.lit(99.0))
    return df.groupBy("player_id", "d").agg(r6(M.any_of("p"), "at_least_once"))


# ---- evaluation ----------------------------------------------------------

_YP = PM + ", yp AS (SELECT match_row, minutes, shots AS y, (touches % 10 + 1) / 2.0 AS p, touches * 1.0 AS pm_ FROM pm) "


def _yp(spark, sf):
    return player_match(spark, sf).select(
        "match_row", "minutes", F.col("shots").alias("y"), ((F.col("touches") % 10 + 1) / F.lit(2.0)).alias("p"), (F.col("touches") * F.lit(1.0)).alias("pm_")
    )


@query("q_mae_rmse", _YP + "SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg(power(p - y, 2))), 6) AS rmse, round(avg(p - y), 6) AS bias, count(*) AS n FROM yp")
def _mae(spark, sf):
    out = E.regression_metrics(_yp(spark, sf), "y", "p")
    return out.select(r6("mae"), r6("rmse"), r6("bias"), "n")


@query(
    "q_huber",
    _YP + "SELECT round(avg(CASE WHEN abs(pm_ - minutes) <= 10 THEN 0.5 * power(pm_ - minutes, 2) ELSE 10 * (abs(pm_ - minutes) - 5) END), 6) AS huber FROM yp",
)
def _huber(spark, sf):
    return _yp(spark, sf).agg(r6(E.huber("minutes", "pm_", 10.0), "huber"))


@query("q_poisson_dev", _YP + "SELECT round(2 * avg(CASE WHEN y > 0 THEN y * ln(y / p) - (y - p) ELSE p END), 6) AS deviance FROM yp")
def _pdev(spark, sf):
    return _yp(spark, sf).agg(r6(E.poisson_deviance("y", "p"), "deviance"))


@query(
    "q_auc_logloss",
    """WITH x AS (SELECT quality AS y, n_chars / (SELECT max(n_chars) + 1.0 FROM documents) AS p FROM labels JOIN documents USING (doc_id)),
    a AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM x AS a, x AS b WHERE a.y = 1 AND b.y = 0)
    SELECT round((SELECT auc FROM a), 6) AS auc, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)), 6) AS accuracy,
      round(-avg(CASE WHEN y = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(1 - greatest(p, 1e-15)) END), 6) AS log_loss FROM x""",
)
def _auc(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars") + F.lit(1.0)).scalar()
    df = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") / top).alias("p")
    )
    return E.binary_metrics(df, "y", "p").select(r6("auc"), r6("accuracy"), r6("log_loss"))


@query(
    "q_spearman",
    _YP
    + """, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
        rank() OVER (ORDER BY minutes) + (count(*) OVER (PARTITION BY minutes) - 1) / 2.0 AS rp FROM yp)
    SELECT round(corr(ry, rp), 6) AS spearman FROM r""",
)
def _spearman(spark, sf):
    return E.spearman(_yp(spark, sf), "y", "minutes").select(r6("spearman"))


@query(
    "q_naive_median",
    _YP
    + """, m AS (SELECT quantile_cont(y, 0.5) AS med FROM yp)
    SELECT max(med) AS median, round(2 * avg(CASE WHEN y > 0 THEN y * ln(y / greatest(med, 1e-3)) - y + greatest(med, 1e-3) ELSE greatest(med, 1e-3) END), 6) AS naive_deviance
    FROM yp, m""",
)
def _naive(spark, sf):
    return E.naive_median(_yp(spark, sf), "y").select("median", r6("naive_deviance"))


@query(
    "q_calibration",
    _YP
    + """, b AS (SELECT *, CASE WHEN p >= 6.5 THEN '6.5+' WHEN p >= 1 THEN
        (CASE WHEN floor(p) = p THEN CAST(CAST(p AS INTEGER) AS VARCHAR) ELSE CAST(CAST(p AS DECIMAL(4, 1)) AS VARCHAR) END) || '-' ||
        (CASE WHEN floor(p + 0.5) = p + 0.5 THEN CAST(CAST(p + 0.5 AS INTEGER) AS VARCHAR) ELSE CAST(CAST(p + 0.5 AS DECIMAL(4, 1)) AS VARCHAR) END) END AS bucket FROM yp)
    SELECT bucket, count(*) AS n, round(avg(p), 6) AS pred, round(avg(y), 6) AS actual FROM b WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def _calibration(spark, sf):
    out = E.calibration(_yp(spark, sf), "y", "p")
    return out.select("bucket", "n", r6("pred"), r6("actual"))


@query(
    "q_conditional_mae",
    _YP + "SELECT round(avg(abs(p - y)) FILTER (WHERE minutes >= 60), 6) AS starter_mae, round(avg(abs(p - y)) FILTER (WHERE minutes < 60), 6) AS sub_mae FROM yp",
)
def _conditional(spark, sf):
    m = F.col("minutes")
    out = E.metrics_where(_yp(spark, sf), "y", "p", {"starter": m >= 60, "sub": m < 60})
    return out.select(r6("starter_mae"), r6("sub_mae"))


_TOTAL = " + ".join(f"({v})" for k, v in _EXP.items() if k != "exp_bonus_pts")
_POINTS = _PRED + f", pt AS (SELECT s.*, CAST({_ACT_CARDS} AS BIGINT) AS a, round({_TOTAL}, 6) AS p, pb AS p_bonus FROM s) "


def _points(spark, sf):
    df = M.expected_points(predicted(spark, sf))
    return df.select(
        "match_row",
        "minutes",
        "gameweek",
        "fpl_position",
        M.actual_points(df).alias("actual_pts"),
        F.round(F.col("exp_total_pts") - F.col("exp_bonus_pts"), 6).alias("pred_pts"),
        F.col("bonus").alias("actual_bonus"),
        "pred_bonus",
    )


@query(
    "q_points_metrics",
    _POINTS
    + """, pl AS (SELECT a, p, bonus AS b, p_bonus AS pb, a + bonus AS ai, p + p_bonus AS pi, greatest(a + bonus, 0) AS an FROM pt WHERE minutes >= 1),
    med AS (SELECT quantile_cont(an, 0.5) AS m FROM pl),
    rk AS (SELECT rank() OVER (ORDER BY ai) + (count(*) OVER (PARTITION BY ai) - 1) / 2.0 AS x, rank() OVER (ORDER BY pi) + (count(*) OVER (PARTITION BY pi) - 1) / 2.0 AS y FROM pl)
    SELECT round(avg(abs(p - a)), 6) AS mae_ex_bonus, round(avg(abs(pi - ai)), 6) AS mae_inc_bonus,
      round(2 * avg(CASE WHEN an > 0 THEN an * ln(an / greatest(pi, 1e-3)) - an + greatest(pi, 1e-3) ELSE greatest(pi, 1e-3) END), 6) AS poisson_dev_inc_bonus,
      round(2 * avg(CASE WHEN an > 0 THEN an * ln(an / greatest(m, 1e-3)) - an + greatest(m, 1e-3) ELSE greatest(m, 1e-3) END), 6) AS poisson_dev_naive_median,
      max(m) AS naive_median_value, round(avg(abs(pb - b)), 6) AS bonus_mae, count(*) AS n_played, (SELECT round(corr(x, y), 6) FROM rk) AS spearman_inc_bonus
    FROM pl, med""",
)
def _points_metrics(spark, sf):
    out = E.points_metrics(_points(spark, sf))
    exact = {"naive_median_value", "n_played"}
    return out.select(*(c if c in exact else r6(c) for c in out.columns))


@query(
    "q_season_eval",
    _POINTS
    + """, e AS (SELECT gameweek, label AS fpl_position, a, p, minutes FROM pt)
    SELECT gameweek, fpl_position, count(*) AS matched, count(*) FILTER (WHERE minutes > 1) AS played,
      round(avg(abs(p - a)) FILTER (WHERE minutes > 1), 6) AS mae, round(avg(abs(p - a)), 6) AS mae_all, round(avg(p) FILTER (WHERE minutes > 1), 6) AS mean_pred,
      round(avg(a) FILTER (WHERE minutes > 1), 6) AS mean_actual, round(avg(p - a) FILTER (WHERE minutes > 1), 6) AS bias,
      CASE grouping(gameweek, fpl_position) WHEN 1 THEN 'gameweek' WHEN 2 THEN 'fpl_position' ELSE 'overall' END AS level
    FROM e GROUP BY GROUPING SETS ((gameweek), (fpl_position), ())""",
)
def _season_eval(spark, sf):
    df = _points(spark, sf).withColumn("actual_minutes", F.floor(F.col("minutes") - 0.005))
    df = df.withColumn("actual_minutes", F.when(F.col("minutes") > 1, 1).otherwise(0))
    out = E.evaluate_season(df)
    exact = {"gameweek", "fpl_position", "matched", "played", "level"}
    return out.select(*(c if c in exact else r6(c) for c in out.columns))


@query(
    "q_metric_rows",
    _YP
    + """, m AS (SELECT avg(abs(p - y)) AS mae, sqrt(avg(power(p - y, 2))) AS rmse, CAST(count(*) AS DOUBLE) AS n FROM yp)
    SELECT 'shots' AS section, 'mae' AS metric, round(mae, 6) AS value FROM m UNION ALL SELECT 'shots', 'rmse', round(rmse, 6) FROM m
    UNION ALL SELECT 'size', 'n', n FROM m""",
)
def _metric_rows(spark, sf):
    wide = E.regression_metrics(_yp(spark, sf), "y", "p")
    out = E.metric_rows(wide, {"shots": ["mae", "rmse", "absent"], "size": ["n"]})
    return out.select("section", "metric", r6("value"))


_CATS = {
    "Appearance": ("TRUE", "pred_minutes", _EXP["exp_appearance_pts"], "minutes", "CASE WHEN minutes >= 60 THEN 2 ELSE 1 END"),
    "Goals": ("TRUE", "pg", _EXP["exp_goals_pts"], "goals", "goals * CASE label WHEN 'GK' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END"),
    "Assists": ("TRUE", "pa", "pa * 3", "assists", "assists * 3"),
    "Clean Sheet": (
        "TRUE",
        "pcs",
        _EXP["exp_cs_pts"],
        "CAST(minutes >= 60 AND gc = 0 AS INTEGER)",
        "CAST(minutes >= 60 AND gc = 0 AS INTEGER) * CASE label WHEN 'GK' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END",
    ),
    "Goals Conceded": (
        "minutes >= 60 AND label IN ('GK', 'DEF')",
        "lam",
        f"CASE WHEN minutes >= 60 AND label IN ('GK', 'DEF') THEN {_FLOOR} ELSE 0 END",
        "gc",
        "CASE WHEN minutes >= 60 AND label IN ('GK', 'DEF') THEN -(gc // 2) ELSE 0 END",
    ),
    "Saves": (
        "label = 'GK'",
        "psv * (pred_minutes / 90)",
        "CASE WHEN label = 'GK' THEN psv * (pred_minutes / 90) / 3 ELSE 0 END",
        "saves",
        "CASE WHEN label = 'GK' THEN saves // 3 ELSE 0 END",
    ),
    "Defcon": (
        "label IN ('DEF', 'MID') AND pred_minutes >= 60",
        "hp",
        "CASE WHEN label IN ('DEF', 'MID') AND pred_minutes >= 60 THEN hp * 2 ELSE 0 END",
        "hit",
        "CASE WHEN label IN ('DEF', 'MID') AND pred_minutes >= 60 THEN hit * 2 ELSE 0 END",
    ),
    "Yellow Cards": ("TRUE", "py", "-py", "yellow", "-yellow"),
    "Red Cards": ("TRUE", "pr", "-3 * pr", "red", "-3 * red"),
    "Bonus": ("TRUE", "pb", "pb", "bonus", "bonus"),
}


@query(
    "q_points_breakdown",
    _PRED
    + """, q AS (SELECT *, greatest(defcon_mu, 0.01) AS mu, CASE WHEN label = 'DEF' THEN 10 ELSE 12 END AS t, 3.0 AS r
        FROM (SELECT *, (touches % 20) * 1.0 AS defcon_mu FROM s WHERE minutes >= 1)),
      kx AS (SELECT DISTINCT mu, t, r FROM q), kp AS (SELECT mu, t, greatest(1 - sum("""
    + _NB_PMF
    + """), 0) AS hp FROM (SELECT mu, t, r, unnest(range(0, t)) AS i FROM kx) GROUP BY mu, t),
      z AS (SELECT q.*, hp FROM q JOIN kp ON q.mu = kp.mu AND q.t = kp.t),
      c AS ("""
    + " UNION ALL ".join(
        f"SELECT '{n}' AS category, COALESCE(avg({pv}) FILTER (WHERE {cond}), 0) AS pv, avg({pp}) AS pp, COALESCE(avg({av}) FILTER (WHERE {cond}), 0) AS av, avg({ap}) AS ap FROM z"
        for n, (cond, pv, pp, av, ap) in _CATS.items()
    )
    + """)
    SELECT category, round(pv, 6) AS pred_value_avg, round(pp, 6) AS pred_pts_avg, round(av, 6) AS actual_value_avg, round(ap, 6) AS actual_pts_avg,
      round(pp - ap, 6) AS pts_diff, round(abs(pp - ap), 6) AS abs_pts_diff FROM c
    UNION ALL SELECT 'TOTAL', NULL, round(sum(pp), 6), NULL, round(sum(ap), 6), round(sum(pp - ap), 6), round(sum(abs(pp - ap)), 6) FROM c""",
)
def _breakdown(spark, sf):
    df = predicted(spark, sf).withColumnsRenamed(
        {"pred_exp_goals": "pred_goals", "pred_exp_assists": "pred_assists", "pred_exp_saves": "pred_saves", "pred_yellow_prob": "pred_yellow", "pred_red_prob": "pred_red"}
    )
    df = df.withColumn("pred_defcon", (F.col("touches") % 20) * F.lit(1.0))
    out = A.points_breakdown(df, dispersion=F.lit(3.0))
    return out.select("category", *(r6(c) for c in out.columns if c != "category"))
