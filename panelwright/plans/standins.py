"""Player-match and team-match panels derived from the ``events`` table.

``PM`` and ``TM`` state the same views as DuckDB CTEs for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.operators.windows import Panel

PLAYER = Panel(("player_id",), ("ts", "match_row"), ("slot",))
TEAM = Panel(("team_no",), ("season", "gameweek", "match_id"))

#: counting stats of the player view: name -> modulus applied to the json value
MODULI = {
    "shots": 7,
    "key_passes": 5,
    "tackles": 11,
    "interceptions": 6,
    "clearances": 9,
    "blocks": 4,
    "recoveries": 13,
    "saves": 8,
    "fouls": 3,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def player_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    step1 = e.select(
        F.col("event_id").alias("match_row"),
        F.col("user_id").alias("player_id"),
        "ts",
        (d * 24 + F.hour("ts")).alias("slot"),
        d.alias("d"),
        (F.col("user_id") % 20).alias("team_no"),
        F.pmod(d - F.col("user_id") % 20, F.lit(20)).alias("__opp"),
        "event_type",
        "value",
        k.alias("touches"),
    )
    opp = F.when(F.col("__opp") != F.col("team_no"), F.col("__opp"))
    flag = lambda kind: (F.col("event_type") == kind).cast("long")
    return step1.select(
        "match_row",
        "player_id",
        "ts",
        "slot",
        "d",
        F.floor(F.col("d") / 10).cast("long").alias("season"),
        (F.col("d") % 10 + 1).alias("gameweek"),
        "team_no",
        opp.alias("opp_no"),
        (F.col("d") * 100 + F.least("team_no", opp)).alias("match_id"),
        F.coalesce((F.col("team_no") < opp).cast("long"), F.lit(0).cast("long")).alias("is_home"),
        (F.col("player_id") % 4).alias("position"),
        F.least(F.col("value"), F.lit(90.0)).alias("minutes"),
        flag("purchase").alias("goals"),
        flag("click").alias("assists"),
        flag("error").alias("yellow"),
        ((F.col("event_type") == "view") & (F.col("touches") % 20 == 0)).cast("long").alias("own_goal"),
        (F.col("value") / 100).alias("xg"),
        (F.col("value") / 200).alias("xa"),
        "touches",
        *((F.col("touches") % m).alias(n) for n, m in MODULI.items()),
    )


_SUMS = ["goals", "own_goal", "yellow", "touches", *MODULI]


def team_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per team and match; byes have no opponent and are left out."""
    return team_panel(player_match(spark, sf_dir))


def team_panel(pm: DataFrame) -> DataFrame:
    return (
        pm.where(F.col("opp_no").isNotNull())
        .groupBy("match_id", "d", "season", "gameweek", "team_no", "opp_no", "is_home")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("xg").alias("xg"), *(F.sum(c).alias(c) for c in _SUMS))
    )


def sides(pm: DataFrame) -> DataFrame:
    """Both sides of every match with formation; ``manager_id`` is the sighting of that day."""
    d, t = F.col("d"), F.col("team_no")
    listed = pm.where(F.col("opp_no").isNotNull()).select("match_id", "d", "season", "gameweek", "team_no").distinct()
    return listed.select(
        "*",
        ((t + 3 * F.floor((d + t) / 12)) % 20).alias("manager_id"),
        F.concat_ws("-", 3 + d % 3, 4 - t % 2, 3 - d % 3 + t % 2).alias("formation"),
    )


_stats_sql = ", ".join(f"touches % {m} AS {n}" for n, m in MODULI.items())
PM = f"""WITH pm_k AS (
  SELECT event_id AS match_row, user_id AS player_id, ts,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS d,
         user_id % 20 AS team_no, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS touches
  FROM events),
pm_o AS (SELECT *, ((d - team_no) % 20 + 20) % 20 AS opp_raw FROM pm_k),
pm AS (
  SELECT match_row, player_id, ts, d * 24 + hour(ts) AS slot, d, d // 10 AS season, d % 10 + 1 AS gameweek,
         team_no, CASE WHEN opp_raw <> team_no THEN opp_raw END AS opp_no,
         d * 100 + least(team_no, opp_raw) AS match_id,
         CAST(CASE WHEN team_no < opp_raw THEN 1 ELSE 0 END AS BIGINT) AS is_home,
         player_id % 4 AS position, least(value, 90.0) AS minutes,
         CAST(event_type = 'purchase' AS BIGINT) AS goals, CAST(event_type = 'click' AS BIGINT) AS assists,
         CAST(event_type = 'error' AS BIGINT) AS yellow,
         CAST(event_type = 'view' AND touches % 20 = 0 AS BIGINT) AS own_goal,
         value / 100 AS xg, value / 200 AS xa, touches, {_stats_sql}
  FROM pm_o)
"""
_sums_sql = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)
TM = (
    PM
    + f""", tm AS (
  SELECT match_id, d, season, gameweek, team_no, opp_no, is_home, count(*) AS n, sum(xg) AS xg, {_sums_sql}
  FROM pm WHERE opp_no IS NOT NULL
  GROUP BY match_id, d, season, gameweek, team_no, opp_no, is_home)
"""
)

#: Both sides of every match, as SQL.
SIDES = (
    TM
    + """, sides AS (SELECT match_id, d, season, gameweek, team_no, (team_no + 3 * ((d + team_no) // 12)) % 20 AS manager_id,
      CAST(3 + d % 3 AS DOUBLE) AS form_def, CAST(4 - team_no % 2 AS DOUBLE) AS form_mid, CAST(3 - d % 3 + team_no % 2 AS DOUBLE) AS form_fwd FROM tm),
  mins AS (SELECT match_id, team_no, minutes AS v, sum(minutes) OVER (PARTITION BY match_id, team_no) AS total,
      row_number() OVER (PARTITION BY match_id, team_no ORDER BY minutes DESC) AS rn FROM pm WHERE opp_no IS NOT NULL AND minutes > 0),
  shape AS (SELECT match_id, team_no, avg(v) AS mins_mean, quantile_cont(v, 0.5) AS mins_median, stddev_pop(v) AS mins_std, max(v) AS mins_max,
      count(*) AS num_players_used, count(*) FILTER (WHERE v >= 89) AS num_full_90, greatest(count(*) - 11, 0) AS num_subs_made,
      sum(v) FILTER (WHERE rn <= 11) / max(total) AS mins_concentration_top11, -sum(v / total * ln(v / total + 1e-12)) AS mins_entropy
    FROM mins GROUP BY match_id, team_no),
  games AS (SELECT s.*, a.goals + COALESCE(b.own_goal, 0) AS gf, COALESCE(b.goals, 0) + a.own_goal AS ga, p.* EXCLUDE (match_id, team_no)
    FROM sides AS s JOIN tm AS a ON a.match_id = s.match_id AND a.team_no = s.team_no LEFT JOIN tm AS b ON b.match_id = s.match_id AND b.team_no <> s.team_no
    JOIN shape AS p ON p.match_id = s.match_id AND p.team_no = s.team_no)
"""
)

# ---- fixtures derived from the order tables -------------------------------


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home side: the customer's nation; away side: nation of the order's first supplier."""
    t = lambda n: table(spark, sf_dir, n)
    home = t("customer").join(
        t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_team")), "c_nationkey"
    )
    away = t("supplier").join(
        t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("away_team")), "s_nationkey"
    )
    first = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    return (
        t("orders")
        .join(home.select(F.col("c_custkey").alias("o_custkey"), "home_team"), "o_custkey")
        .join(first, "o_orderkey")
        .join(away.select("s_suppkey", "away_team"), "s_suppkey")
        .select(
            F.col("o_orderkey").alias("match_id"),
            "home_team",
            "away_team",
            F.year("o_orderdate").cast("long").alias("season"),
            F.month("o_orderdate").cast("long").alias("round"),
            F.col("o_orderdate").alias("match_date"),
        )
    )


FX = """WITH fx AS (
  SELECT o_orderkey AS match_id, hn.n_name AS home_team, an.n_name AS away_team, year(o_orderdate) AS season,
         month(o_orderdate) AS round, o_orderdate AS match_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation AS hn ON c_nationkey = hn.n_nationkey
  JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) AS m ON m.l_orderkey = o_orderkey
  JOIN supplier ON sk = s_suppkey JOIN nation AS an ON s_nationkey = an.n_nationkey)
"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alias dimension: every nation under three spellings."""
    n = table(spark, sf_dir, "nation")
    number = F.element_at(F.split("n_name", "_"), -1)
    spellings = F.array(F.lower("n_name"), F.concat(F.lit("n"), number), F.concat(F.lit("the_nation_"), number))
    return n.select(F.explode(spellings).alias("alias"), F.concat(F.lit("team "), number).alias("canonical"))


ALIASES = """al AS (
  SELECT unnest([lower(n_name), 'n' || split_part(n_name, '_', 2), 'the_nation_' || split_part(n_name, '_', 2)]) AS alias,
         'team ' || split_part(n_name, '_', 2) AS canonical FROM nation)
"""


# ---- runs and their results, derived from the orders ----------------------


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 40).alias("run_id")).agg(
        F.max("o_orderdate").alias("started"), F.count(F.lit(1)).alias("n_rows")
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 40).alias("run_id"), F.col("o_orderpriority").alias("model")).agg(
        F.min("o_totalprice").alias("score")
    )


RUNS = """WITH runs AS (SELECT o_custkey % 40 AS run_id, max(o_orderdate) AS started, count(*) AS n_rows FROM orders GROUP BY 1),
  results AS (SELECT o_custkey % 40 AS run_id, o_orderpriority AS model, min(o_totalprice) AS score FROM orders GROUP BY 1, 2)
"""
