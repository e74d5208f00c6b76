"""Learning queries: folds, out-of-fold features, fits, rankings, the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import chain as C, learning as L, metrics as E, owners as O
from panelwright.operators.ordering import time_folds
from panelwright.operators.windows import Expanding, Lag, add_prior, rolling_features
from panelwright.plans import features as T, future as N, models as M
from panelwright.plans.queries.scoring import r6
from panelwright.plans.registry import query
from panelwright.plans.standins import PLAYER, PM, SIDES, TEAM, TM, player_match, sides, table
from panelwright.semantics import persisted

_FOLDS = PM + """, n AS (SELECT *, row_number() OVER (ORDER BY ts, match_row) - 1 AS i, count(*) OVER () AS c FROM pm),
  f AS (SELECT *, CASE WHEN i < c - 5 * (c // 6) THEN 0 ELSE CAST((i - (c - 5 * (c // 6))) // (c // 6) + 1 AS INTEGER) END AS fold FROM n)
"""


def _folds(spark, sf):
    return time_folds(player_match(spark, sf), ["slot"], ["ts", "match_row"])


@query("q_time_folds", _FOLDS + "SELECT match_row, fold FROM f")
def _time_folds(spark, sf):
    return _folds(spark, sf).select("match_row", "fold")


@query(
    "q_oof_mean",
    _FOLDS + "SELECT a.match_row, round(CASE WHEN a.fold > 0 THEN (SELECT avg(b.goals) FROM f AS b WHERE b.fold < a.fold AND b.position = a.position) END, 6) AS oof FROM f AS a",
)
def _oof_mean(spark, sf):
    """Fold model: prior mean of the position."""

    def fit(train):
        means = train.groupBy("position").agg(F.avg("goals").alias("__m"))
        return lambda df, out: df.join(means, "position", "left").select(*df.columns, F.col("__m").alias(out))

    folds = persisted(_folds(spark, sf).select("match_row", "position", "goals", "fold"), "folds")
    return L.oof_predict(folds, "fold", 5, fit, "oof").select("match_row", r6("oof"))


_FORM = ["goals_roll5", "shots_roll5", "touches_roll10", "minutes_roll5", "saves_roll5"]


def _form(spark, sf):
    """A small feature frame, staged once because every fit reads it."""
    feats = [
        *rolling_features(["goals", "shots", "minutes", "saves"], [5]),
        *rolling_features(["touches"], [10]),
        Lag("minutes", "last_minutes"),
        Expanding("minutes", "current_season_minutes", default=0.0, within=("season",)),
        Expanding(None, "current_season_apps", "rows", within=("season",)),
    ]
    df = add_prior(player_match(spark, sf), PLAYER, feats)
    df = df.withColumn("current_season_mins_per_app", F.col("current_season_minutes") / F.greatest("current_season_apps", F.lit(1)))
    keep = ["match_row", "player_id", "match_id", "team_no", "opp_no", "season", "gameweek", "slot", "ts", "position", "minutes", "goals", "assists", "shots", "yellow", "saves", "fouls", "touches", "is_home"]
    return persisted(df.select(*keep, *_FORM, "last_minutes", "current_season_minutes", "current_season_apps", "current_season_mins_per_app"), "form")


@query("q_fit_count")
def _fit_count(spark, sf):
    df = _form(spark, sf)
    model = L.fit_count(df.where("season < 2"), _FORM, "shots", 4.0)
    scored = model.predict(df.where("season = 2"), "pred")
    return scored.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("pred"), "mean_pred"), r6(F.avg("shots"), "mean_actual"), r6(E.poisson_deviance("shots", "pred"), "deviance")
    )


@query("q_fit_offset")
def _fit_offset(spark, sf):
    df = persisted(T.team_panel_features(player_match(spark, sf), TEAM, (5,), (5,)).where("team_conceded_roll5 IS NOT NULL"), "panel")
    model = L.fit_offset(df.where("season < 2"), ["team_conceded_roll5", "opp_scored_roll5", "is_home"], "goals_conceded", "prior_lambda")
    return model.predict(df.where("season = 2"), "pred_goals_against").select(
        "match_id", "team_no", "goals_conceded", r6("prior_lambda"), r6("pred_goals_against"), r6(F.exp(-F.col("pred_goals_against")), "pred_cs_prob")
    )


@query("q_fit_binary")
def _fit_binary(spark, sf):
    df = L.single_match_labels(_form(spark, sf), ["player_id", "season", "gameweek"], ["yellow"])
    model = L.fit_binary(df.where("season < 2"), _FORM, "yellow")
    scored = model.predict(df.where("season = 2 AND yellow IS NOT NULL"), "p")
    return E.binary_metrics(scored, "yellow", "p").select(r6("auc"), r6("accuracy"), r6("log_loss"))


@query("q_fit_piecewise")
def _fit_piecewise(spark, sf):
    df = _form(spark, sf)
    start = F.col("minutes") >= 60
    model = L.fit_piecewise(df.where("season < 2"), _FORM, "minutes", start, L.piecewise_weight(), 60.0, 90.0)
    scored = model.predict(df.where(start & (F.col("season") == 2)), "pred")
    return scored.agg(F.count(F.lit(1)).alias("n"), r6(F.min("pred"), "low"), r6(F.max("pred"), "high"), r6(E.mae("minutes", "pred"), "mae"))


@query("q_two_stage")
def _two_stage(spark, sf):
    df = _form(spark, sf)
    model = L.fit_minutes(df.where("season < 2"), _FORM)
    scored = model.predict(df.where("season = 2"))
    m = F.col("minutes")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        r6(E.huber("minutes", "pred_minutes"), "huber"),
        r6(E.mae("minutes", "pred_minutes", m >= 60), "starter_mae"),
        r6(E.mae("minutes", "pred_minutes", m < 60), "sub_mae"),
    )


@query("q_fit_rate")
def _fit_rate(spark, sf):
    df = _form(spark, sf).withColumn("saves_per90", F.col("saves") / F.greatest(F.col("minutes") / 90, F.lit(0.01)))
    keeper = (F.col("position") == 0) & (F.col("minutes") >= 20)
    model = L.fit_rate(df.where("season < 2"), _FORM, "saves_per90", keeper, 12.0)
    scored = model.predict(df.where(keeper & (F.col("season") == 2)), "pred")
    return scored.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("pred"), "mean_pred"), r6(E.mae("saves_per90", "pred"), "mae"))


def owner_table(spark, sf):
    """The embedding of every side's manager, staged (one row per side), and its basis."""
    pm = player_match(spark, sf)
    listed = sides(pm)
    stays = O.spells(listed, ["team_no"], "manager_id", "d")
    out, basis = O.owner_embedding(pm, listed.drop("manager_id"), stays, ["d", "match_id", "team_no"], "d")
    return persisted(out, "owners"), basis


@query("q_embedding")
def _embedding(spark, sf):
    out, _ = owner_table(spark, sf)
    return out.select("match_id", "team_no", *(r6(c) for c in M.EMBEDDING))


def _form_folds(spark, sf):
    """The small feature frame with five folds along the calendar, staged."""
    df = _form(spark, sf)
    return C.with_folds(df, C.period_folds(df, M.CALENDAR, 5), M.CALENDAR)


@query("q_search")
def _search(spark, sf):
    """Number of inputs, best first by mutual information on the first fold, times the penalty; five folds, the better third goes on."""
    df = _form_folds(spark, sf)
    ranking = L.rank_table(L.mutual_information(df.where("fold = 0"), _FORM, "goals", bins=8)).orderBy("position").collect()
    best = [r.feature for r in ranking]
    space = [{"features": n, "reg": reg} for n in range(1, len(best) + 1) for reg in (0.001, 0.01, 0.1, 1.0)]

    def fit(train, params):
        return L.fit_count(train, best[: params["features"]], "goals", 4.0, reg=params["reg"]).predict

    return L.search(df.where("minutes >= 1"), space, "fold", 5, fit, E.poisson_deviance("goals", "__pred")).withColumn("score", F.round("score", 6))


@query("q_importance")
def _importance(spark, sf):
    df = _form(spark, sf)
    model = L.fit_piecewise(df, _FORM, "minutes", F.col("minutes") >= 1, F.lit(1.0), 1.0, 90.0)
    return L.importance_table(spark, model).where("position <= 5")


@query("q_permutation")
def _permutation(spark, sf):
    """All inputs, five repeats, on the last fold."""
    df = _form_folds(spark, sf).where("minutes >= 1")
    model = L.fit_count(df.where("fold < 5"), _FORM, "shots", 4.0)
    return L.rank_table(L.permutation_importance(df.where("fold = 5"), "match_row", model, lambda p: E.mae("shots", p)))


@query(
    "q_mutual_info",
    PM
    + ", t AS (SELECT count(*) AS t FROM pm) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(sum(n * 1.0 / t * ln(n * t * 1.0 / (nx * ny))), 6) AS score FROM
      (SELECT {c}, goals, count(*) AS n FROM pm GROUP BY 1, 2) AS j JOIN (SELECT {c} AS x, count(*) AS nx FROM pm GROUP BY 1) AS a ON a.x = j.{c}
      JOIN (SELECT goals AS y, count(*) AS ny FROM pm GROUP BY 1) AS b ON b.y = j.goals, t"""
        for c in ("shots", "assists", "position", "tackles")
    ),
)
def _mutual(spark, sf):
    out = L.mutual_information(player_match(spark, sf), ["shots", "assists", "position", "tackles"], "goals", bins=None)
    return out.select("feature", r6("score"))


@query(
    "q_select_features",
    """WITH r AS (SELECT p_type AS feature, max(p_retailprice * p_size) AS score FROM part GROUP BY p_type),
    k AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS position FROM r)
    SELECT feature, CAST(position AS INTEGER) AS position FROM k WHERE feature = 'PROMO'
    UNION ALL SELECT feature, CAST(position AS INTEGER) FROM (SELECT *, row_number() OVER (ORDER BY position) AS i FROM k WHERE feature <> 'PROMO') WHERE i <= 2""",
)
def _select(spark, sf):
    scores = table(spark, sf, "part").groupBy(F.col("p_type").alias("feature")).agg(F.max(F.col("p_retailprice") * F.col("p_size")).alias("score"))
    return L.select_features(L.rank_table(scores), 2, ["PROMO"]).select("feature", "position")


def _tables(spark, sf):
    """The feature table and the team panel, whole, staged once."""
    pm = player_match(spark, sf)
    owners, _ = owner_table(spark, sf)
    players = persisted(T.player_features(pm, PLAYER, TEAM, owners=owners), "players")
    return M.prepared(players), persisted(T.team_panel_features(pm, TEAM, owners=owners), "teams")


def _held_out(spark, sf):
    """Fitted on the seasons before the last, and the last one's tables with every prediction."""
    players, teams = _tables(spark, sf)
    chain = M.train_chain(players.where("season < 2"), teams.where("season < 2"))
    rows, sides = M.read_by_chain(players.where("season = 2")), M.read_by_chain(teams.where("season = 2"))
    return chain, chain.predict({"teams": sides, "players": rows})


@query("q_train_all")
def _train_all(spark, sf):
    """Every model of the chain, cross-fitted on two seasons, on the rows of the third."""
    _, scored = _held_out(spark, sf)
    cols = [c for c in scored["players"].columns if c.startswith("pred_")]
    return scored["players"].select("match_row", *(r6(c) for c in cols))


@query("q_holdout_eval")
def _holdout_eval(spark, sf):
    """Every model of the chain, fitted as deployed, scored on the last season: errors of each, then points."""
    _, scored = _held_out(spark, sf)
    played = persisted(M.points(scored["players"].where("minutes >= 1"), scored["teams"]), "scored")
    return M.evaluate(played, scored["teams"]).select("section", "metric", r6("value"))


# ---- feature tables ------------------------------------------------------

_W = "(PARTITION BY player_id ORDER BY ts, match_row ROWS BETWEEN"


_EXACT = ["match_row", "goals_roll10", "lifetime_saves", "current_season_apps", "is_def"]
_ROUNDED = [
    "shots_per90_roll5",
    "tackles_per90_roll3",
    "defcon_roll7",
    "team_goals_roll5",
    "team_conceded_roll30",
    "opp_conceded_roll5",
    "team_goals_x_opp_conceded",
    "last_minutes",
]
_FEATURE_SQL = (
    SIDES
    + f""", om AS (SELECT match_id, team_no, row_number() OVER (PARTITION BY manager_id ORDER BY d, match_id, team_no) > 3 AS has_form FROM games),
    x AS (SELECT pm.*, CASE WHEN minutes >= 20 THEN least(shots / greatest(minutes / 90, 0.01), 8.0) END AS sp, tackles / greatest(minutes / 90, 0.01) AS tp,
        CASE WHEN position = 1 THEN clearances + blocks + interceptions + tackles ELSE clearances + blocks + interceptions + tackles + recoveries END AS dc FROM pm),
    p AS (SELECT match_row, player_id, season, gameweek, match_id, team_no, opp_no, avg(sp) OVER {_W} 5 PRECEDING AND 1 PRECEDING) AS sp5, avg(tp) OVER {_W} 3 PRECEDING AND 1 PRECEDING) AS tp3,
        avg(dc) OVER {_W} 7 PRECEDING AND 1 PRECEDING) AS dc7, sum(goals) OVER {_W} 10 PRECEDING AND 1 PRECEDING) AS g10, sum(saves) OVER {_W} UNBOUNDED PRECEDING AND 1 PRECEDING) AS lsv,
        row_number() OVER (PARTITION BY player_id, season ORDER BY ts, match_row) - 1 AS apps, CAST(position = 1 AS INTEGER) AS is_def FROM x),
    c AS (SELECT a.*, b.goals + a.own_goal AS gc, b.own_goal AS gift FROM tm AS a LEFT JOIN tm AS b ON a.match_id = b.match_id AND b.team_no = a.opp_no),
    t AS (SELECT match_id, team_no, avg(goals + COALESCE(gift, 0)) OVER w5 AS tg5, avg(gc) OVER w30 AS gc30, avg(gc) OVER w5 AS gc5 FROM c
      WINDOW w5 AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w30 AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT player_id, season, gameweek, sum(minutes) AS m FROM pm GROUP BY 1, 2, 3),
    lm AS (SELECT a.player_id, a.season, a.gameweek, CASE WHEN (SELECT min(gameweek) FROM s AS z WHERE z.player_id = a.player_id AND z.season = a.season) < a.gameweek THEN COALESCE(b.m, 0) END AS last_minutes
      FROM s AS a LEFT JOIN s AS b ON a.player_id = b.player_id AND a.season = b.season AND b.gameweek = a.gameweek - 1)
    SELECT p.match_row, round(COALESCE(sp5, 0), 6) AS shots_per90_roll5, round(COALESCE(tp3, 0), 6) AS tackles_per90_roll3, round(COALESCE(dc7, 0), 6) AS defcon_roll7,
      CAST(COALESCE(g10, 0) AS BIGINT) AS goals_roll10, CAST(COALESCE(lsv, 0) AS BIGINT) AS lifetime_saves, apps AS current_season_apps, is_def,
      round(COALESCE(a.tg5, 0), 6) AS team_goals_roll5, round(COALESCE(a.gc30, 0), 6) AS team_conceded_roll30, round(COALESCE(o.gc5, 0), 6) AS opp_conceded_roll5,
      round(COALESCE(a.tg5 * o.gc5, 0), 6) AS team_goals_x_opp_conceded, round(COALESCE(lm.last_minutes, 0), 6) AS last_minutes, COALESCE(om.has_form, false) AS has_manager_form
    FROM p LEFT JOIN t AS a ON a.match_id = p.match_id AND a.team_no = p.team_no LEFT JOIN t AS o ON o.match_id = p.match_id AND o.team_no = p.opp_no
    LEFT JOIN lm ON lm.player_id = p.player_id AND lm.season = p.season AND lm.gameweek = p.gameweek
    LEFT JOIN om ON om.match_id = p.match_id AND om.team_no = p.team_no"""
)


@query("q_feature_table", _FEATURE_SQL)
def _feature_table(spark, sf):
    """The whole feature table; columns of each family are compared."""
    out = T.player_features(player_match(spark, sf), PLAYER, TEAM, owners=owner_table(spark, sf)[0])
    known = F.greatest(*(F.abs(c) for c in M.EMBEDDING)) > 0
    out = out.withColumn("has_manager_form", known)
    return out.select(*_EXACT, "has_manager_form", *(r6(c) for c in _ROUNDED))


@query(
    "q_future_rows",
    f"""SELECT * EXCLUDE (has_manager_form) FROM ({_FEATURE_SQL} WHERE p.match_row IN
    (SELECT arg_min(match_row, (ts, match_row)) FROM pm WHERE d = (SELECT max(d) FROM pm) GROUP BY player_id))""",
)
def _future_rows(spark, sf):
    """Each player's first row of the last day, from state: the days before in one build and one update."""
    pm = player_match(spark, sf)
    last = pm.agg(F.max("d")).first()[0]
    state = N.build(pm.where(F.col("d") < last - 1), PLAYER, TEAM).updated(pm.where(F.col("d") == last - 1))
    known = ["match_row", "player_id", "ts", "slot", "d", "season", "gameweek", "team_no", "opp_no", "match_id", "is_home", "position"]
    first = F.min_by(F.struct(*known), F.struct("ts", "match_row")).alias("r")
    coming = pm.where(F.col("d") == last).groupBy("player_id").agg(first).select("r.*")
    out = N.future_features(coming, state)
    return out.select(*(F.col(c).cast("long").alias(c) if c.endswith(("roll10", "saves", "apps")) else F.col(c) for c in _EXACT), *(r6(c) for c in _ROUNDED))


@query("q_feature_table_full")
def _feature_table_full(spark, sf):
    """Every column of the feature table."""
    return T.player_features(player_match(spark, sf), PLAYER, TEAM, owners=owner_table(spark, sf)[0])


@query(
    "q_team_panel",
    TM
    + """, c AS (SELECT a.*, b.goals + a.own_goal AS gc, b.xg AS xga FROM tm AS a LEFT JOIN tm AS b ON a.match_id = b.match_id AND b.team_no = a.opp_no),
    lg AS (SELECT avg(gc) AS m FROM c),
    r AS (SELECT *, avg(gc) OVER w10 AS gc10, avg(xga) OVER w5 AS xga5, avg(xg) OVER w5 AS xg5, avg(shots) OVER w5 AS sh5, avg(tackles + interceptions + clearances + blocks) OVER w5 AS da5,
        avg(saves + COALESCE(gc, 0)) OVER w5 AS sf5, avg(CASE WHEN gc IS NOT NULL THEN CAST(gc = 0 AS INTEGER) END) OVER ws AS cs, avg(xga) OVER ws AS sx, avg(goals) OVER ws AS sg,
        avg(xga) OVER wv AS vx, avg(goals) OVER wv AS vg FROM c
      WINDOW w5 AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        ws AS (PARTITION BY team_no, season ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wv AS (PARTITION BY team_no, season, is_home ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT a.match_id, a.team_no, round(a.gc10, 6) AS team_conceded_roll10, round(a.sf5, 6) AS team_shots_faced_roll5, round(a.cs, 6) AS season_cs_rate,
      round(COALESCE(a.vx, a.sx), 6) AS ha_season_xga, round(COALESCE(a.xga5, 0) * COALESCE(o.xg5, 0), 6) AS xga_x_opp_xg_roll5, round(COALESCE(a.da5, 0) * COALESCE(o.sh5, 0), 6) AS def_actions_x_opp_shots_roll5,
      round(COALESCE(a.vx, a.sx, m) * (COALESCE(o.vg, o.sg, m) / m), 6) AS prior_lambda
    FROM r AS a CROSS JOIN lg LEFT JOIN r AS o ON o.match_id = a.match_id AND o.team_no = a.opp_no""",
)
def _team_panel(spark, sf):
    out = T.team_panel_features(player_match(spark, sf), TEAM)
    cols = ["team_conceded_roll10", "team_shots_faced_roll5", "season_cs_rate", "ha_season_xga", "xga_x_opp_xg_roll5", "def_actions_x_opp_shots_roll5", "prior_lambda"]
    return out.select("match_id", "team_no", *(r6(c) for c in cols))


@query("q_oof_team_goals")
def _oof_team_goals(spark, sf):
    """Goals a team should score = out-of-fold goals its opponent should concede."""
    pm = player_match(spark, sf)
    panel = T.team_panel_features(pm, TEAM, (5,), (5,)).where("team_conceded_roll5 IS NOT NULL AND goals_conceded IS NOT NULL")
    folds = persisted(time_folds(panel, ["season", "gameweek"], ["match_id", "team_no"]), "folds")
    fit = lambda train: L.fit_offset(train, ["team_conceded_roll5", "opp_scored_roll5", "is_home"], "goals_conceded", "prior_lambda").predict
    oof = L.oof_predict(folds, "fold", 5, fit, "oof").select("match_id", F.col("team_no").alias("opp_no"), F.col("oof").alias("pred_team_goals"))
    from panelwright.operators.joins import lookup

    out = lookup(pm, oof, ["match_id", "opp_no"], ["pred_team_goals"], {"pred_team_goals": 1.3})
    return out.select("match_row", r6("pred_team_goals"))
