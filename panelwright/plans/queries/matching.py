"""Joins, entity resolution and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.text import last_token
from panelwright.operators import aggregates as A
from panelwright.operators import joins as J
from panelwright.operators.ranking import latest_before
from panelwright.operators.windows import add_prior, rolling_features
from panelwright.plans.registry import query
from panelwright.plans.standins import (
    ALIASES,
    FX,
    PM,
    RUNS,
    TEAM,
    TM,
    aliases,
    fixtures,
    player_match,
    run_results,
    runs,
    table,
    team_match,
)


@query(
    "q_attach_period",
    """SELECT l_orderkey AS match_id, l_linenumber, l_partkey, month(o_orderdate) AS gameweek
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'F'""",
)
def _attach_period(spark, sf):
    fx = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("match_id"), F.month("o_orderdate").cast("long").alias("gameweek")
    )
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), "l_linenumber", "l_partkey")
    return J.attach_period(facts, fx)


@query(
    "q_attach_opponent",
    FX
    + ", "
    + ALIASES
    + """, f AS (SELECT l_orderkey AS match_id, l_partkey, l_linenumber, 'N' || s_nationkey AS team
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
      fc AS (SELECT f.*, COALESCE(canonical, lower(team)) AS ct FROM f LEFT JOIN al ON alias = lower(team)),
      sides AS (SELECT match_id, home_team AS team, away_team AS opponent, 1 AS is_home FROM fx
        UNION ALL SELECT match_id, away_team, home_team, 0 FROM fx),
      sc AS (SELECT match_id, canonical AS ct, opponent, is_home FROM sides JOIN al ON alias = lower(team)),
      one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, ct ORDER BY is_home, opponent) AS rn FROM sc) WHERE rn = 1)
    SELECT fc.match_id, l_partkey, l_linenumber, team, COALESCE(opponent, 'Unknown') AS opponent, COALESCE(is_home, 0) AS is_home
    FROM fc LEFT JOIN one ON fc.match_id = one.match_id AND fc.ct = one.ct""",
)
def _attach_opponent(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("team")
    )
    facts = table(spark, sf, "lineitem").join(s, "l_suppkey").select(
        F.col("l_orderkey").alias("match_id"), "l_partkey", "l_linenumber", "team"
    )
    return J.attach_opponent(facts, fixtures(spark, sf), aliases(spark, sf))


@query(
    "q_goals_conceded",
    TM
    + """SELECT a.match_id, a.team_no, b.goals + a.own_goal AS goals_conceded, round(b.xg, 8) AS xga
    FROM tm AS a LEFT JOIN tm AS b ON a.match_id = b.match_id AND a.team_no <> b.team_no""",
)
def _goals_conceded(spark, sf):
    return A.goals_conceded(team_match(spark, sf)).select("match_id", "team_no", "goals_conceded", F.round("xga", 8).alias("xga"))


@query(
    "q_pair_theta",
    TM
    + """SELECT a.match_id, a.team_no, b.team_no AS other_team_no, b.goals AS other_goals
    FROM tm AS a JOIN tm AS b ON a.match_id = b.match_id AND a.team_no <> b.team_no""",
)
def _pair(spark, sf):
    out = J.pair_rows(team_match(spark, sf), "match_id", "team_no", ["goals"])
    return out.select("match_id", "team_no", "other_team_no", "other_goals")


@query(
    "q_opp_features",
    TM
    + """, r AS (SELECT match_id, team_no, avg(goals) OVER w AS g5, avg(shots) OVER w AS s5 FROM tm
      WINDOW w AS (PARTITION BY team_no ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT match_row, round(g5, 6) AS opp_goals_roll5, round(s5, 6) AS opp_shots_roll5
    FROM pm LEFT JOIN r ON pm.match_id = r.match_id AND pm.opp_no = r.team_no""",
)
def _opp_features(spark, sf):
    pm = player_match(spark, sf)
    tm = add_prior(A.team_match(pm.where("opp_no IS NOT NULL"), ["match_id", "season", "gameweek", "team_no"], ["goals", "shots"], [], "match_row"), TEAM, rolling_features(["goals", "shots"], [5]))
    out = J.attach_opponent_features(pm, tm, {"goals_roll5": "opp_goals_roll5", "shots_roll5": "opp_shots_roll5"})
    return out.select("match_row", F.round("opp_goals_roll5", 6).alias("opp_goals_roll5"), F.round("opp_shots_roll5", 6).alias("opp_shots_roll5"))


# Official rows per customer: some under the full name, some under the short
# name only, some under neither.
_OFFICIAL = """l AS (SELECT c_custkey, c_nationkey AS team, lower(c_mktsegment || ' ' || c_name) AS name FROM customer),
  r AS (SELECT c_custkey AS fpl_id, c_nationkey AS team,
      CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment || ' ' || c_name) WHEN 1 THEN 'first ' || lower(c_name) ELSE 'other ' || c_custkey END AS name,
      CASE WHEN c_custkey % 3 = 2 THEN 'web' ELSE lower(c_name) END AS web, c_custkey % 7 AS points FROM customer),
  k AS (SELECT team, name AS k, 0 AS p, fpl_id, points FROM r UNION ALL SELECT team, web, 1, fpl_id, points FROM r
    UNION ALL SELECT team, string_split(name, ' ')[-1], 2, fpl_id, points FROM r),
  look AS (SELECT team, k, fpl_id, points FROM (
    SELECT *, row_number() OVER (PARTITION BY team, k ORDER BY p, fpl_id) AS rn FROM k) WHERE rn = 1)
"""


def _resolve_inputs(spark, sf):
    c = table(spark, sf, "customer")
    full = F.lower(F.concat_ws(" ", "c_mktsegment", "c_name"))
    key = F.col("c_custkey")
    left = c.select("c_custkey", F.col("c_nationkey").alias("team"), full.alias("name"))
    right = c.select(
        key.alias("fpl_id"),
        F.col("c_nationkey").alias("team"),
        F.when(key % 3 == 0, full)
        .when(key % 3 == 1, F.concat(F.lit("first "), F.lower("c_name")))
        .otherwise(F.concat(F.lit("other "), key.cast("string")))
        .alias("name"),
        F.when(key % 3 == 2, "web").otherwise(F.lower("c_name")).alias("web"),
        (key % 7).alias("points"),
    )
    return left, right


def resolved(spark, sf):
    left, right = _resolve_inputs(spark, sf)
    keys = [F.col("name"), last_token("name")]
    return J.resolve(left, right, ["team"], keys, [F.col("name"), F.col("web"), last_token("name")], ["fpl_id", "points"], ["fpl_id"])


@query(
    "q_resolve_fallback",
    f"""WITH {_OFFICIAL} SELECT c_custkey, COALESCE(a.fpl_id, b.fpl_id) AS fpl_id, COALESCE(a.points, b.points) AS points,
      CASE WHEN a.fpl_id IS NOT NULL THEN 0 WHEN b.fpl_id IS NOT NULL THEN 1 END AS resolved_by
    FROM l LEFT JOIN look AS a ON a.team = l.team AND a.k = l.name
    LEFT JOIN look AS b ON b.team = l.team AND b.k = string_split(l.name, ' ')[-1]""",
)
def _resolve(spark, sf):
    return resolved(spark, sf).select("c_custkey", "fpl_id", "points", "resolved_by")


@query(
    "q_match_report",
    f"""WITH {_OFFICIAL} SELECT count(*) FILTER (WHERE COALESCE(a.fpl_id, b.fpl_id) IS NOT NULL) AS matched, count(*) AS total,
      count(*) FILTER (WHERE COALESCE(a.fpl_id, b.fpl_id) IS NULL) AS unmatched,
      count(*) FILTER (WHERE COALESCE(a.points, b.points) > 0) AS positives
    FROM l LEFT JOIN look AS a ON a.team = l.team AND a.k = l.name
    LEFT JOIN look AS b ON b.team = l.team AND b.k = string_split(l.name, ' ')[-1]""",
)
def _match_report(spark, sf):
    return A.match_report(resolved(spark, sf), F.col("fpl_id").isNotNull(), F.col("points") > 0)


@query(
    "q_contains_join",
    """WITH c AS (SELECT item_id, doc_id, b.text = d.text AS exact FROM benchmark AS b JOIN documents AS d
        ON contains(d.text, b.text) OR contains(b.text, d.text))
    SELECT item_id, doc_id, exact FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, doc_id) AS rn FROM c) WHERE rn = 1""",
)
def _contains(spark, sf):
    return J.contains_join(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


@query(
    "q_contains_names",
    """WITH n AS (SELECT DISTINCT p_brand AS brand FROM part), t AS (SELECT DISTINCT p_name FROM part),
      w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part),
      c AS (SELECT word, p_name FROM w JOIN t ON contains(p_name, word) OR contains(word, p_name))
    SELECT word, min(p_name) AS p_name, false AS exact FROM c GROUP BY word""",
)
def _contains_names(spark, sf):
    """Short needles: one word inside two-word names."""
    names = table(spark, sf, "part").select("p_name").distinct()
    words = table(spark, sf, "part").select(F.get(F.split("p_name", " "), 1).alias("word")).distinct()
    a = words.withColumn("word_text", F.col("word"))
    b = names.withColumn("name_text", F.col("p_name"))
    return J.contains_join(a, b, "word", "word_text", "p_name", "name_text")


@query(
    "q_fixture_fanout",
    FX
    + """, sides AS (SELECT match_id, season, round, match_date, home_team AS team, away_team AS opponent, 1 AS is_home FROM fx
        UNION ALL SELECT match_id, season, round, match_date, away_team, home_team, 0 FROM fx)
    SELECT s_suppkey, match_id, opponent, is_home,
      row_number() OVER (PARTITION BY s_suppkey, season, round ORDER BY match_date, match_id, is_home) AS fixture_num
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN sides ON sides.team = n_name""",
)
def _fanout(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team"))
    ents = table(spark, sf, "supplier").join(n, "s_nationkey").select("s_suppkey", "team")
    out = J.expand_fixtures(ents, fixtures(spark, sf), "s_suppkey", "team", "match_id", ["match_date", "match_id"], ["season", "round"])
    return out.select("s_suppkey", "match_id", "opponent", "is_home", F.col("fixture_num").cast("long").alias("fixture_num"))


@query(
    "q_lookup_unique",
    """SELECT o_orderkey, COALESCE(ship, 'none') AS ship FROM orders
    LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS ship FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
def _lookup(spark, sf):
    dim = table(spark, sf, "lineitem").where("l_quantity > 25").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("ship")
    )
    return J.lookup(table(spark, sf, "orders").select("o_orderkey"), dim, ["o_orderkey"], ["ship"], {"ship": "none"})


@query(
    "q_latest_before",
    PM
    + """, x AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, match_row DESC) AS rn FROM pm WHERE NOT (season = 2 AND gameweek >= 5)),
      o AS (SELECT player_id, opp_no, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, match_row DESC) AS rn FROM pm
        WHERE NOT (season = 2 AND gameweek >= 5) AND opp_no IS NOT NULL)
    SELECT x.player_id, x.minutes, o.opp_no FROM x LEFT JOIN o ON x.player_id = o.player_id AND o.rn = 1 WHERE x.rn = 1""",
)
def _latest(spark, sf):
    cut = ~((F.col("season") == 2) & (F.col("gameweek") >= 5))
    return latest_before(player_match(spark, sf), ["player_id"], ["ts", "match_row"], ["minutes", "opp_no"], cut)


@query(
    "q_owner_state",
    TM
    + """, o AS (SELECT *, team_no % 7 + season AS owner FROM tm),
      latest AS (SELECT team_no, owner FROM (SELECT *, row_number() OVER (PARTITION BY team_no ORDER BY season DESC, gameweek DESC, match_id DESC) AS rn FROM o) WHERE rn = 1),
      st AS (SELECT owner, avg(goals) AS goals, avg(shots) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY season DESC, gameweek DESC, match_id DESC, team_no DESC) AS rn FROM o)
        WHERE rn <= 20 GROUP BY owner HAVING count(*) >= 3)
    SELECT team_no, latest.owner, round(COALESCE(goals, 0), 6) AS goals, round(COALESCE(shots, 0), 6) AS shots
    FROM latest LEFT JOIN st ON latest.owner = st.owner""",
)
def _owner(spark, sf):
    tm = team_match(spark, sf).withColumn("owner", F.col("team_no") % 7 + F.col("season"))
    out = J.carry_forward_owner(tm, "team_no", "owner", ["season", "gameweek", "match_id", "team_no"], ["goals", "shots"])
    return out.select("team_no", "owner", F.round("goals", 6).alias("goals"), F.round("shots", 6).alias("shots"))


@query("q_unmatched", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _unmatched(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unmatched(table(spark, sf, "orders"), lines, ["o_orderkey"]).select("o_orderkey")


@query(
    "q_resolve_matches",
    FX
    + """SELECT a.season, a.round, a.home_team, a.away_team, b.match_id
    FROM (SELECT DISTINCT season, round, home_team, away_team FROM fx) AS a
    JOIN fx AS b ON a.season = b.season AND a.round = b.round AND lower(a.home_team) = lower(b.home_team) AND lower(a.away_team) = lower(b.away_team)""",
)
def _resolve_matches(spark, sf):
    fx = fixtures(spark, sf)
    ext = fx.select("season", "round", "home_team", "away_team").distinct()
    out = J.resolve_matches(ext, fx, aliases(spark, sf), context=["season", "round"])
    return out.select("season", "round", "home_team", "away_team", "match_id")


@query(
    "q_score_distinct",
    PM + "SELECT match_row, round(exp(-(team_no + COALESCE(opp_no, 0)) / 20.0) + is_home, 6) AS score FROM pm",
)
def _score_distinct(spark, sf):
    def scorer(req):
        lam = (F.col("team_no") + F.coalesce("opp_no", F.lit(0))) / 20.0
        return req.withColumn("score", F.exp(-lam) + F.col("is_home"))

    out = J.score_distinct(player_match(spark, sf), ["team_no", "opp_no", "is_home"], scorer)
    return out.select("match_row", F.round("score", 6).alias("score"))


@query(
    "q_run_history",
    RUNS
    + """, h AS (SELECT runs.run_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, n_rows, model, score
      FROM runs JOIN results ON runs.run_id = results.run_id)
    SELECT *, 'all' AS listing FROM h UNION ALL SELECT *, 'one' FROM h WHERE model = '2-HIGH'""",
)
def _run_history(spark, sf):
    heads, res = runs(spark, sf), run_results(spark, sf)
    whole = J.run_history(heads, res).withColumn("listing", F.lit("all"))
    out = whole.unionByName(J.run_history(heads, res, model="2-HIGH").withColumn("listing", F.lit("one")))
    return out.select("run_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "n_rows", "model", "score", "listing")


# ---- set operations ------------------------------------------------------


@query(
    "q_union_flag",
    """SELECT o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS DOUBLE) AS balance, false AS is_new FROM orders
    UNION ALL SELECT c_custkey, NULL, c_acctbal, true FROM customer""",
)
def _union(spark, sf):
    hist = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return J.union_flagged(hist, new, "is_new").select("id", "status", "balance", "is_new")


@query(
    "q_unpivot_sides",
    FX
    + """SELECT match_id, home_team AS team, away_team AS opponent, 1 AS is_home FROM fx
    UNION ALL SELECT match_id, away_team, home_team, 0 FROM fx""",
)
def _unpivot(spark, sf):
    return J.unpivot_sides(
        fixtures(spark, sf), ["match_id"], {"team": ("home_team", "away_team"), "opponent": ("away_team", "home_team")}
    )


@query("q_key_except", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def _key_except(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.key_diff(table(spark, sf, "orders"), lines, ["o_orderkey"])


@query("q_distinct", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def _distinct(spark, sf):
    return J.distinct_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "q_key_intersect",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _members(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.members(table(spark, sf, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")
