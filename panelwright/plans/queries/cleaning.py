"""Cleaning, projection and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.functions.rates import AWARD_CAPS, conditional_metric
from panelwright.operators import clean as C
from panelwright.operators.windows import Expanding, add_prior, rolling_features
from panelwright.plans.registry import query
from panelwright.plans.standins import ALIASES, PLAYER, PM, FX, aliases, fixtures, player_match, table


@query("q_rename", "SELECT p_partkey AS player_id, p_name AS player_name, p_brand AS team FROM part")
def _rename(spark, sf):
    names = {"p_partkey": "player_id", "p_name": "player_name", "p_brand": "team", "absent": "ignored"}
    return C.rename(table(spark, sf, "part"), names).select("player_id", "player_name", "team")


@query(
    "q_coerce",
    """SELECT event_id, COALESCE(TRY_CAST(split_part(props, ' ', 2) AS DOUBLE), 0.0) AS raw_number,
       COALESCE(TRY_CAST(replace(split_part(props, ' ', 2), '}', '') AS DOUBLE), 0.0) AS number, 0.0::DOUBLE AS absent
    FROM events""",
)
def _coerce(spark, sf):
    raw = F.get(F.split("props", " "), 1)
    df = table(spark, sf, "events").select("event_id", raw.alias("raw_number"), F.replace(raw, F.lit("}"), F.lit("")).alias("number"))
    return C.coerce_numeric(df, ["raw_number", "number", "absent"])


@query("q_surrogate", "SELECT p_partkey, p_name || '_' || p_brand AS player_id FROM part")
def _surrogate(spark, sf):
    return C.surrogate_key(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], "player_id").select(
        "p_partkey", "player_id"
    )


_LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


@query(
    "q_dedupe_norm",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, trim(lower(l_returnflag))
        ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""",
)
def _dedupe(spark, sf):
    out = C.dedupe(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"], _LINE_ORDER, ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "q_season_floor",
    PM + "SELECT match_row, season, season = (SELECT max(season) FROM pm) AS is_current FROM pm WHERE season >= 1",
)
def _season_floor(spark, sf):
    pm = player_match(spark, sf)
    return C.since(pm, "season", 1).select(
        "match_row", "season", (F.col("season") == C.latest_value(pm, "season")).alias("is_current")
    )


@query(
    "q_active_semi",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
      SELECT o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))""",
)
def _active(spark, sf):
    return C.active_entities(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey")


_NAMED = "SELECT c_custkey, c_nationkey, c_mktsegment || ' ' || c_name AS player_name FROM customer"


def _named(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("player_name")
    )


@query(
    "q_label_resolve",
    f"""WITH p AS ({_NAMED}), l AS (
      SELECT lower(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END) AS name,
        CASE c_custkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS label
      FROM customer WHERE c_custkey % 3 < 2)
    SELECT p.c_custkey, COALESCE(a.label, b.label, CASE c_nationkey WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID'
       WHEN 3 THEN 'FWD' END, 'MID') AS label
    FROM p LEFT JOIN l AS a ON a.name = lower(player_name) LEFT JOIN l AS b ON b.name = lower(split_part(player_name, ' ', 2))""",
)
def _label(spark, sf):
    p = _named(spark, sf)
    c = table(spark, sf, "customer").where(F.col("c_custkey") % 3 < 2)
    full = F.concat_ws(" ", "c_mktsegment", "c_name")
    four = F.element_at(F.array(*(F.lit(x) for x in ("GK", "DEF", "MID", "FWD"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    lookup = c.select(F.lower(F.when(F.col("c_custkey") % 3 == 0, full).otherwise(F.col("c_name"))).alias("name"), four.alias("label"))
    codes = {0: "GK", 1: "DEF", 2: "MID", 3: "FWD"}
    return C.resolve_label(p, "player_name", lookup, "c_nationkey", codes, "MID", "label").select("c_custkey", "label")


@query(
    "q_one_hot",
    PM
    + """SELECT match_row, CAST(position = 0 AS INTEGER) AS is_gk, CAST(position = 1 AS INTEGER) AS is_def,
    CAST(position = 2 AS INTEGER) AS is_mid, CAST(position = 3 AS INTEGER) AS is_fwd FROM pm""",
)
def _one_hot(spark, sf):
    out = C.one_hot(player_match(spark, sf), "position", {0: "is_gk", 1: "is_def", 2: "is_mid", 3: "is_fwd"}, 2)
    return out.select("match_row", "is_gk", "is_def", "is_mid", "is_fwd")


@query(
    "q_defcon",
    PM
    + """, c AS (SELECT match_row, position, clearances + blocks + interceptions + tackles AS cbit, recoveries FROM pm),
    m AS (SELECT match_row, CASE WHEN position = 1 THEN cbit ELSE cbit + recoveries END AS defcon,
      CASE WHEN position = 1 THEN 10 ELSE 12 END AS defcon_threshold FROM c)
    SELECT match_row, defcon, defcon_threshold, CAST(defcon >= defcon_threshold AS INTEGER) AS hit_threshold FROM m""",
)
def _defcon(spark, sf):
    return conditional_metric(player_match(spark, sf)).select("match_row", "defcon", "defcon_threshold", "hit_threshold")


@query(
    "q_fill_pattern",
    PM
    + """SELECT match_row, COALESCE(round(avg(touches) OVER w, 6), 0) AS touches_roll3,
      COALESCE(CAST(sum(goals) OVER u AS BIGINT), 0) AS lifetime_goals, opp_no
    FROM pm WINDOW w AS (PARTITION BY player_id ORDER BY ts, match_row ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
      u AS (PARTITION BY player_id ORDER BY ts, match_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _fill(spark, sf):
    feats = [*rolling_features(["touches"], [3]), Expanding("goals", "lifetime_goals")]
    out = add_prior(player_match(spark, sf), PLAYER, feats).select(
        "match_row", F.round("touches_roll3", 6).alias("touches_roll3"), "lifetime_goals", "opp_no"
    )
    return C.fill_by_pattern(out)


@query(
    "q_clip_pattern",
    PM
    + """SELECT match_row, least(shots * 3.0, 8.0)::DOUBLE AS shots_per90_roll3, tackles::DOUBLE AS tackles, (goals * 120.0)::DOUBLE AS lifetime_goals,
    least(goals * 120.0, 3.0)::DOUBLE AS lifetime_goals_per90, touches FROM pm""",
)
def _clip(spark, sf):
    df = player_match(spark, sf).select(
        "match_row",
        (F.col("shots") * F.lit(3.0)).alias("shots_per90_roll3"),
        F.col("tackles").cast("double").alias("tackles"),
        (F.col("goals") * F.lit(120.0)).alias("lifetime_goals"),
        (F.col("goals") * F.lit(120.0)).alias("lifetime_goals_per90"),
        "touches",
    )
    return C.clip_by_pattern(df, AWARD_CAPS)


@query(
    "q_holdout",
    PM
    + """, n AS (SELECT match_row, season, gameweek, row_number() OVER (ORDER BY ts, match_row) AS i, count(*) OVER () AS c FROM pm)
    SELECT match_row, season = 2 AS by_season, season = 2 AND gameweek >= 6 AS by_start, i > c - floor(c * 0.2) AS by_fraction FROM n""",
)
def _holdout(spark, sf):
    pm = player_match(spark, sf).select("match_row", "season", "gameweek", "slot", "ts")
    train, test = C.holdout(pm, fraction=0.2, periods=["slot"], order=["ts", "match_row"])
    both = train.withColumn("by_fraction", F.lit(False)).unionByName(test.withColumn("by_fraction", F.lit(True)))
    parts = []
    for start in (None, ("gameweek", 6)):
        tr, te = C.holdout(pm, "season", 2, start)
        name = "by_season" if start is None else "by_start"
        parts.append(tr.select("match_row", F.lit(False).alias(name)).unionByName(te.select("match_row", F.lit(True).alias(name))))
    out = both.join(parts[0], "match_row").join(parts[1], "match_row")
    return out.select("match_row", "by_season", "by_start", "by_fraction")


@query(
    "q_availability",
    f"""WITH p AS ({_NAMED}), a AS (
      SELECT lower(CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END) AS name,
        CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'i' WHEN 2 THEN 's' ELSE 'u' END AS status,
        CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 75 END AS chance
      FROM customer WHERE c_custkey % 5 < 2),
    v AS (SELECT name, CASE WHEN status <> 'a' AND chance = 0 THEN 0 ELSE COALESCE(chance, 100) END AS v FROM a)
    SELECT c_custkey, COALESCE(f.v, l.v, 100) AS chance_of_playing
    FROM p LEFT JOIN v AS f ON f.name = lower(player_name) LEFT JOIN v AS l ON l.name = lower(split_part(player_name, ' ', 2))
    WHERE COALESCE(f.v, l.v, 100) > 0""",
)
def _availability(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_custkey") % 5 < 2)
    key = F.col("c_custkey")
    avail = c.select(
        F.lower(F.when(key % 5 == 0, F.concat_ws(" ", "c_mktsegment", "c_name")).otherwise(F.col("c_name"))).alias("name"),
        F.element_at(F.array(*(F.lit(x) for x in "aisu")), (key % 4 + 1).cast("int")).alias("status"),
        F.when(key % 3 == 0, 0).when(key % 3 == 1, 75).alias("chance"),
    )
    return C.availability_filter(_named(spark, sf), "player_name", avail).select("c_custkey", "chance_of_playing")


@query(
    "q_feature_frame",
    PM + "SELECT match_row, CAST(touches AS DOUBLE) AS touches, CAST(COALESCE(opp_no, 0) AS DOUBLE) AS opp_no, 0.0::DOUBLE AS missing FROM pm",
)
def _feature_frame(spark, sf):
    return C.feature_frame(player_match(spark, sf), ["touches", "opp_no", "missing"], keep=["match_row"])


# ---- text ----------------------------------------------------------------


@query(
    "q_norm_key",
    """SELECT p_partkey, replace(replace(lower(p_name), ' ', '_'), '''', '') AS name_key,
       replace(replace(lower(p_type), ' ', '_'), '''', '') AS type_key FROM part""",
)
def _norm_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.norm_key("p_name").alias("name_key"), T.norm_key("p_type").alias("type_key"))


@query(
    "q_alias",
    "WITH "
    + ALIASES
    + """, t AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Nation_' WHEN 1 THEN 'N' ELSE 'X' END || s_nationkey AS team FROM supplier)
    SELECT s_suppkey, COALESCE(canonical, lower(team)) AS team FROM t LEFT JOIN al ON alias = lower(team)""",
)
def _alias(spark, sf):
    k = F.col("s_suppkey") % 3
    prefix = F.when(k == 0, "Nation_").when(k == 1, "N").otherwise("X")
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(prefix, F.col("s_nationkey").cast("string")).alias("raw"))
    return T.canonical(s, "raw", aliases(spark, sf), "team").select("s_suppkey", "team")


# Test rules, in priority order.
_RULES = {"small ring": "ring", "red": "crimson", "large widget": "widget", "bolt": "fastener"}


def _rule_sql(col: str) -> str:
    exact = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in _RULES.items())
    part = " ".join(f"WHEN contains({col}, '{k}') THEN '{v}'" for k, v in _RULES.items())
    return (
        f"CASE {exact} {part} WHEN len(string_split({col}, ' ')) = 2 AND split_part({col}, ' ', 1) = 'small' THEN {col} "
        f"ELSE split_part({col}, ' ', 1) END"
    )


@query("q_alias_contains", f"SELECT p_partkey, {_rule_sql('p_name')} AS short_name FROM part")
def _alias_contains(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.canonical_contains("p_name", _RULES, keep_two=["small"]).alias("short_name"))


@query("q_fold", "SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents")
def _fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_accents("text")).alias("folded_md5"))


@query("q_last_token", "SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN string_split(p_name, ' ')[-1] END AS last_word FROM part")
def _last_token(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.last_token("p_name").alias("last_word"))


@query(
    "q_formation",
    """WITH f AS (SELECT event_id, CASE event_id % 5
        WHEN 0 THEN (event_id % 6) || '-' || (event_id % 4) || '-' || (event_id % 3) WHEN 1 THEN 'x-' || event_id
        WHEN 2 THEN CAST(event_id % 9 AS VARCHAR) WHEN 3 THEN (event_id % 5) || '-' || (event_id % 2) || '-3-' || (event_id % 3)
        ELSE (event_id % 7) || '-' || (event_id % 5) END AS s FROM events),
      n AS (SELECT event_id, list_transform(string_split(s, '-'), lambda x: TRY_CAST(x AS INTEGER)) AS l FROM f),
      ok AS (SELECT *, len(l) >= 2 AND len(list_filter(l, lambda x: x IS NULL)) = 0 AS good FROM n)
    SELECT event_id, CASE WHEN good THEN CAST(l[1] AS DOUBLE) END AS form_def,
      CASE WHEN good THEN CAST(list_sum(l) - l[1] - l[-1] AS DOUBLE) END AS form_mid,
      CASE WHEN good THEN CAST(l[-1] AS DOUBLE) END AS form_fwd FROM ok""",
)
def _formation(spark, sf):
    e = F.col("event_id")
    s = lambda m: (e % m).cast("string")
    text = (
        F.when(e % 5 == 0, F.concat_ws("-", s(6), s(4), s(3)))
        .when(e % 5 == 1, F.concat(F.lit("x-"), e.cast("string")))
        .when(e % 5 == 2, s(9))
        .when(e % 5 == 3, F.concat_ws("-", s(5), s(2), F.lit("3"), s(3)))
        .otherwise(F.concat_ws("-", s(7), s(5)))
    )
    df = table(spark, sf, "events").select("event_id", text.alias("formation"))
    return df.select("event_id", T.parse_formation("formation").alias("f")).select("event_id", "f.*")


@query(
    "q_pair_key",
    FX + "SELECT match_id, least(home_team, away_team) || '_vs_' || greatest(home_team, away_team) AS pair FROM fx",
)
def _pair_key(spark, sf):
    return fixtures(spark, sf).select("match_id", T.pair_key("home_team", "away_team").alias("pair"))


@query(
    "q_concat_group",
    """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey) AS parts
    FROM lineitem GROUP BY l_orderkey""",
)
def _concat_group(spark, sf):
    """Lines of an order as text: a group is one order, as the text must hold all of it."""
    order = F.struct("l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(T.concat_group("l_partkey", order).alias("parts"))


@query(
    "q_parse_ts",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no date ' || o_orderkey
        ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw FROM orders)
    SELECT o_orderkey, strftime(TRY_CAST(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM s""",
)
def _parse_ts(spark, sf):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("no date "), F.col("o_orderkey").cast("string"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    df = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return df.select("o_orderkey", F.date_format(T.parse_ts("raw"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))
