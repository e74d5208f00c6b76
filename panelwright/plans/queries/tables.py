"""Sources and sinks. Files are written from the given tables to shared scratch space and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import metrics as E
from panelwright.plans.queries.scoring import _POINTS, _points, r6
from panelwright.plans.registry import query
from panelwright.plans.standins import FX, PM, RUNS, fixtures, player_match, run_results, runs, table
from panelwright.semantics import scratch_dir
from panelwright.sources import files as S, payload as P, sinks as K

_FACTS = "match_row bigint, player_id bigint, season bigint, gameweek bigint, minutes_played double, touches bigint"


def _fact_rows(spark, sf):
    return player_match(spark, sf).select(
        "match_row", "player_id", "season", "gameweek", F.col("minutes").alias("minutes_played"), "touches"
    )


@query(
    "q_scan_facts",
    PM + "SELECT match_row, player_id, season, gameweek, minutes, touches FROM pm WHERE touches % 10 <> 3",
)
def _scan_facts(spark, sf):
    """Two snapshots, the newer one with damaged lines: only its good lines count."""
    root = scratch_dir(spark, "facts")
    df = _fact_rows(spark, sf)
    df.where("season = 0").write.option("header", True).csv(f"{root}/facts_20240101.csv")
    damaged = F.col("touches") % 10 == 3
    target = f"{root}/facts_20240201.csv"
    df.where(~damaged).write.option("header", True).csv(target)
    # a surplus field, as in a broken export
    lines = df.where(damaged).select(F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns), F.lit("surplus")).alias("value"))
    lines.write.mode("append").text(target)
    return S.read_facts(spark, root, _FACTS, snapshots="facts_*.csv", pattern=r"facts_[^/]+")


@query(
    "q_fixtures",
    FX + "SELECT match_id, home_team, away_team, season, round AS gameweek FROM fx",
)
def _fixtures(spark, sf):
    root = scratch_dir(spark, "fixtures")
    fx = fixtures(spark, sf).select("match_id", "home_team", "away_team", "season", "round")
    twice = fx.unionByName(fx.where("match_id % 3 = 0"))
    twice.write.option("header", True).csv(f"{root}/fixtures.csv")
    schema = "match_id bigint, home_team string, away_team string, season bigint, round bigint"
    return S.read_fixtures(spark, f"{root}/fixtures.csv", schema)


@query("q_scan_keyed_files", PM + "SELECT match_row, touches, CAST(gameweek AS INTEGER) AS gameweek, CAST(season AS VARCHAR) AS season FROM pm WHERE gameweek IN (2, 5)")
def _scan_keyed(spark, sf):
    root = scratch_dir(spark, "keyed")
    df = player_match(spark, sf).select("match_row", "touches", "gameweek", "season")
    df.write.option("header", True).partitionBy("gameweek", "season").csv(root)
    pattern = r"gameweek=(\d+)/season=(\d+)"
    return S.read_partitioned_by_name(
        spark, f"{root}/*/*/*.csv", "match_row bigint, touches bigint", pattern, {"gameweek": "int", "season": "string"}, {"gameweek": [2, 5]}
    )


def _stat(c):
    """The payload's way of writing one number."""
    value = F.col(c) if isinstance(c, str) else c
    return F.struct(F.struct(value.cast("double").alias("value")).alias("stat"))


def _documents(spark, sf):
    """One nested document per event, as JSON text."""
    # a gzip file is read by one task: rows are dealt evenly first, however few the files of the source are
    pm = player_match(spark, sf).repartition("match_row", "player_id")
    t = F.col("touches")
    stats = F.array(
        F.struct(F.create_map(F.lit("Total Shots"), _stat("shots"), F.lit("Tackles"), _stat("tackles")).alias("stats")),
        F.struct(F.create_map(F.lit("Touches"), _stat("touches")).alias("stats")),
    )
    packed = F.when(t % 10 == 0, F.slice(stats, 1, 0)).otherwise(stats)
    player = F.struct(
        F.concat(F.lit("P"), F.col("player_id")).alias("name"),
        F.concat(F.lit("T"), F.col("team_no")).alias("teamName"),
        F.col("position").cast("int").alias("usualPosition"),
        F.lit("9").alias("shirtNumber"),
        packed.alias("stats"),
    )
    side = lambda no, score: F.struct(F.concat(F.lit("T"), no).alias("name"), score.cast("int").alias("score"))
    shot = F.struct(
        F.col("match_row").alias("id"),
        F.col("player_id").alias("playerId"),
        (t % 90).cast("int").alias("min"),
        F.col("xg").alias("expectedGoals"),
        (F.col("goals") == 1).alias("isOnTarget"),
    )
    coach = lambda no: F.struct(
        F.struct((no + 100).alias("id"), F.concat(F.lit("M"), no).alias("name")).alias("coach"), F.lit("4-4-2").alias("formation")
    )
    doc = F.struct(
        F.struct(
            F.col("match_row").alias("matchId"),
            side(F.col("team_no"), F.col("goals")).alias("homeTeam"),
            F.when(F.col("opp_no").isNotNull(), side(F.col("opp_no"), F.col("assists"))).alias("awayTeam"),
        ).alias("general"),
        F.struct(
            F.create_map(F.col("player_id").cast("string"), player).alias("playerStats"),
            F.struct(F.when(F.col("shots") > 0, F.array(shot)).alias("shots")).alias("shotmap"),
            F.struct(coach(F.col("team_no")).alias("homeTeam"), coach(F.col("opp_no")).alias("awayTeam")).alias("lineup"),
        ).alias("content"),
    )
    return pm.select(F.to_json(doc).alias("value"))


def _landed(spark, sf):
    root = scratch_dir(spark, "payloads")
    _documents(spark, sf).write.option("compression", "gzip").text(f"{root}/raw")
    return S.read_payloads(spark, f"{root}/raw", one_per_file=False)


@query(
    "q_payload_scan",
    PM
    + """SELECT match_row AS match_id, 'T' || team_no AS home_team, 'T' || opp_no AS away_team, CAST(goals AS INTEGER) AS home_score,
      CASE WHEN opp_no IS NOT NULL THEN CAST(assists AS INTEGER) END AS away_score, CAST(NULL AS VARCHAR) AS match_date FROM pm""",
)
def _payload_scan(spark, sf):
    return P.project_struct(_landed(spark, sf), P.MATCH_FIELDS, root="doc.")


@query(
    "q_payload_stats",
    PM
    + """SELECT match_row AS match_id, CAST(player_id AS VARCHAR) AS player_id, 'P' || player_id AS player_name, 'T' || team_no AS team,
      CAST(shots AS DOUBLE) AS total_shots, CAST(tackles AS DOUBLE) AS tackles, CAST(touches AS DOUBLE) AS touches FROM pm WHERE touches % 10 <> 0""",
)
def _payload_stats(spark, sf):
    flat = P.flatten_stats(_landed(spark, sf))
    wide = P.promote_stats(flat, ["total_shots", "tackles", "touches"])
    return wide.select("match_id", "player_id", "player_name", "team", "total_shots", "tackles", "touches")


@query(
    "q_payload_shots",
    PM + "SELECT match_row AS match_id, match_row AS shot_id, player_id, CAST(touches % 90 AS INTEGER) AS minute, xg AS \"xG\", goals = 1 AS is_on_target FROM pm WHERE shots > 0",
)
def _payload_shots(spark, sf):
    return P.flatten_shots(_landed(spark, sf)).select("match_id", "shot_id", "player_id", "minute", "xG", "is_on_target")


@query(
    "q_sides_extract",
    PM
    + """SELECT match_row AS match_id, 'T' || team_no AS team, team_no + 100 AS manager_id, 'M' || team_no AS manager_name, '4-4-2' AS formation, 1 AS is_home FROM pm
    UNION ALL SELECT match_row, 'T' || opp_no, opp_no + 100, 'M' || opp_no, '4-4-2', 0 FROM pm""",
)
def _sides(spark, sf):
    return P.extract_sides(_landed(spark, sf))


@query(
    "q_json_stats_pivot",
    """WITH k AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value FROM events)
    SELECT event_id, CAST(user_id AS VARCHAR) AS player_id, k AS k_value, value AS big_value FROM k""",
)
def _stats_pivot(spark, sf):
    """Stat names with capitals and spaces become snake-case columns; a repeated name keeps its first value."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "map<string,double>")
    entry = lambda name, v: F.struct(F.create_map(F.lit(name), _stat(v)).alias("stats"))
    stats = F.array(entry("K Value", k["k"]), entry("Big Value", "value"), entry("k value", F.lit(-1.0)))
    player = F.struct(
        F.lit("n").alias("name"), F.lit("t").alias("teamName"), F.lit(1).alias("usualPosition"), F.lit("1").alias("shirtNumber"), stats.alias("stats")
    )
    doc = F.struct(
        F.struct(F.col("event_id").alias("matchId")).alias("general"),
        F.struct(F.create_map(F.col("user_id").cast("string"), player).alias("playerStats")).alias("content"),
    )
    flat = P.flatten_stats(e.select(doc.alias("doc")), keep={"event_id": "general.matchId"})
    return P.promote_stats(flat, ["k_value", "big_value"]).select("event_id", "player_id", "k_value", "big_value")


@query(
    "q_inline_array",
    "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS weight FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
)
def _inline(spark, sf):
    items = F.transform("embedding", lambda x, i: F.struct(i.alias("index"), x.cast("double").alias("v")))
    df = table(spark, sf, "embeddings").select("vec_id", items.alias("items"))
    return P.flatten_array(df, "items", {"index": "pos", "v": "weight"}, {"vec_id": "vec_id"})


@query(
    "q_json_project",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS home_score, CAST(NULL AS VARCHAR) AS home_team, CAST(NULL AS INTEGER) AS away_score FROM events",
)
def _project(spark, sf):
    text = F.concat(F.lit('{"general":{"homeTeam":'), F.replace("props", F.lit('"k"'), F.lit('"score"')), F.lit("}}"))
    df = table(spark, sf, "events").select("event_id", F.from_json(text, S.PAYLOAD_SCHEMA).alias("doc"))
    names = {c: P.MATCH_FIELDS[c] for c in ("home_score", "home_team", "away_score")}
    return P.project_struct(df, names, ["event_id"], "doc.")


@query(
    "q_finished_only",
    """SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Round ' || month(o_orderdate) ELSE CAST(month(o_orderdate) AS VARCHAR) END AS round,
      o_orderpriority AS home_team, o_orderstatus AS away_team, CAST(o_orderkey % 6 AS INTEGER) AS home_score, CAST(o_orderkey % 4 AS INTEGER) AS away_score
    FROM orders WHERE o_orderstatus <> 'P'""",
)
def _finished(spark, sf):
    key, month = F.col("o_orderkey"), F.month("o_orderdate")
    item = F.struct(
        key.alias("id"),
        F.when(key % 5 != 0, month).alias("round"),
        F.concat(F.lit("Round "), month).alias("roundName"),
        F.struct((F.col("o_orderstatus") != "P").alias("finished")).alias("status"),
        F.struct(F.col("o_orderpriority").alias("name"), (key % 6).cast("int").alias("score")).alias("home"),
        F.struct(F.col("o_orderstatus").alias("name"), (key % 4).cast("int").alias("score")).alias("away"),
    )
    return P.flatten_fixtures(table(spark, sf, "orders").select(F.array(item).alias("matches")), "matches")


@query(
    "q_points_flatten",
    """SELECT o_custkey AS fpl_id, month(o_orderdate) AS gameweek, COALESCE(c_name, '') AS player_name, COALESCE(c_mktsegment, '') AS web_name,
      COALESCE(n_name, '') AS team, o_orderkey % 13 AS actual_total_points, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 91 END AS minutes
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _points_flatten(spark, sf):
    key = F.col("o_orderkey")
    element = F.struct(
        F.col("o_custkey").alias("id"),
        F.struct((key % 13).alias("actual_total_points"), F.when(key % 4 != 0, key % 91).alias("minutes")).alias("stats"),
    )
    live = table(spark, sf, "orders").select(F.month("o_orderdate").cast("long").alias("gameweek"), F.array(element).alias("elements"))
    players = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("fpl_id"), F.col("c_name").alias("player_name"), F.col("c_mktsegment").alias("web_name"), F.col("c_nationkey").alias("team_id")
    )
    teams = table(spark, sf, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team"))
    return P.flatten_points(live, players, teams)


# ---- sinks ---------------------------------------------------------------

_OLD_NEW = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, year(o_orderdate) AS season FROM orders),
  old AS (SELECT o_orderkey, status, season, 1 AS seq FROM o WHERE o_orderkey % 4 <> 0),
  new AS (SELECT o_orderkey, status || '!' AS status, season, 2 AS seq FROM o WHERE o_orderkey % 3 = 0 AND season >= 1996
    UNION ALL SELECT o_orderkey, status || '?', season, 3 FROM o WHERE o_orderkey % 9 = 0 AND season >= 1996)
"""


def _old_new(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("long").alias("season")
    )
    old = o.where("o_orderkey % 4 <> 0").withColumn("seq", F.lit(1))
    late = o.where("season >= 1996")
    new = late.where("o_orderkey % 3 = 0").withColumns({"status": F.concat("status", F.lit("!")), "seq": F.lit(2)})
    newer = late.where("o_orderkey % 9 = 0").withColumns({"status": F.concat("status", F.lit("?")), "seq": F.lit(3)})
    return old, new.unionByName(newer)


_UPSERTED = _OLD_NEW + """SELECT o_orderkey, status, season FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS rn FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) WHERE rn = 1"""


@query("q_upsert_last", _UPSERTED)
def _upsert(spark, sf):
    old, new = _old_new(spark, sf)
    return K.upsert(old, new, ["o_orderkey"], "seq").select("o_orderkey", "status", "season")


@query("q_upsert_table", _UPSERTED)
def _upsert_table(spark, sf):
    """The same through a partitioned table: only the seasons in the new data are rewritten."""
    old, new = _old_new(spark, sf)
    path = scratch_dir(spark, "upsert") + "/orders"
    K.write_partitions(old, path, ["season"])
    schema = spark.read.parquet(path).schema
    K.upsert_table(spark, path, old.schema, new, ["o_orderkey"], "seq", ["season"])
    return spark.read.schema(schema).parquet(path).select("o_orderkey", "status", F.col("season").cast("long").alias("season"))


@query("q_missing_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _missing(spark, sf):
    stored = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.missing_keys(table(spark, sf, "orders"), stored, ["o_orderkey"])


@query(
    "q_missing_limited",
    """WITH m AS (SELECT year(o_orderdate) AS season, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
    t AS (SELECT * FROM m ORDER BY season, o_orderkey LIMIT 700) SELECT season, count(*) AS n FROM t GROUP BY season""",
)
def _missing_limited(spark, sf):
    stored = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    cand = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("season"), "o_orderkey")
    return K.per_group(K.missing_keys_limited(cand, stored, "season", "o_orderkey", 700), "season")


@query(
    "q_cache_append",
    """WITH o AS (SELECT o_orderkey, o_totalprice, year(o_orderdate) * 100 + month(o_orderdate) AS gw FROM orders)
    SELECT o_orderkey, o_totalprice, gw FROM o WHERE gw <= 199606 UNION ALL SELECT o_orderkey, -o_totalprice, gw FROM o WHERE gw > 199606""",
)
def _cache_append(spark, sf):
    gw = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", gw.alias("gw"))
    fresh = o.withColumn("o_totalprice", -F.col("o_totalprice"))
    return K.append_missing_partitions(o.where("gw <= 199606"), fresh, "gw").select("o_orderkey", "o_totalprice", "gw")


@query("q_sink_roundtrip", PM + "SELECT season, gameweek, match_row, CASE WHEN season = 2 THEN touches + 1000 ELSE touches END AS touches FROM pm")
def _roundtrip(spark, sf):
    """Write all periods, then write one season again: the others stay."""
    path = scratch_dir(spark, "predictions") + "/log"
    df = player_match(spark, sf).select("season", "gameweek", "match_row", "touches")
    K.write_predictions(df, path)
    K.write_predictions(df.where("season = 2").withColumn("touches", F.col("touches") + 1000), path)
    back = spark.read.parquet(path)
    return back.select(F.col("season").cast("long").alias("season"), F.col("gameweek").cast("long").alias("gameweek"), "match_row", "touches")


@query(
    "q_replace_partition",
    PM
    + """, old AS (SELECT gameweek, season, player_id, goals FROM pm), new AS (SELECT gameweek, season, player_id, goals + 5 AS goals FROM pm WHERE season = 1 AND gameweek < 4 AND goals = 1)
    SELECT CAST(gameweek AS INTEGER) AS gameweek, CAST(season AS VARCHAR) AS season, CAST(player_id AS VARCHAR) AS player_id, CAST(goals AS DOUBLE) AS pred_exp_goals, 'MID' AS fpl_position, 0.0::DOUBLE AS pred_bonus
    FROM (SELECT * FROM old WHERE NOT (season = 1 AND gameweek < 4) UNION ALL SELECT * FROM new)""",
)
def _replace(spark, sf):
    pm = player_match(spark, sf).select("gameweek", "season", "player_id", F.col("goals").alias("pred_exp_goals"))
    fresh = pm.where("season = 1 AND gameweek < 4 AND pred_exp_goals = 1").withColumn("pred_exp_goals", F.col("pred_exp_goals") + 5)
    out = K.replace_partition(K.log_projection(pm), K.log_projection(fresh), ["gameweek", "season"])
    return out.select("gameweek", "season", "player_id", "pred_exp_goals", "fpl_position", "pred_bonus")


@query(
    "q_run_log",
    RUNS
    + """, p AS (SELECT run_id, model, 'score<' || CAST(score AS VARCHAR) AS params FROM results WHERE model < '4'), m AS (SELECT run_id, model, score FROM results WHERE model > '2')
    SELECT runs.run_id, n_rows, COALESCE(p.model, m.model) AS model, params IS NOT NULL AS has_params, score
    FROM p FULL JOIN m ON p.run_id = m.run_id AND p.model = m.model JOIN runs ON runs.run_id = COALESCE(p.run_id, m.run_id)""",
)
def _run_log(spark, sf):
    res = run_results(spark, sf)
    params = res.where("model < '4'").select("run_id", "model", F.to_json(F.struct("score")).alias("params"))
    root, heads, scores = scratch_dir(spark, "runs"), runs(spark, sf), res.where("model > '2'")
    for half in ("run_id < 20", "run_id >= 20"):  # two appends
        K.append_run(heads.where(half), params.where(half), scores.where(half), root)
    out = spark.read.parquet(f"{root}/runs").join(spark.read.parquet(f"{root}/results"), "run_id")
    return out.select("run_id", "n_rows", "model", F.col("params").isNotNull().alias("has_params"), "score")


@query("q_clear", RUNS + "SELECT 'results' AS name, 0::BIGINT AS n UNION ALL SELECT 'runs', count(*) FROM runs")
def _clear(spark, sf):
    root = scratch_dir(spark, "clear")
    K.append_rows(run_results(spark, sf), f"{root}/results")
    K.append_rows(runs(spark, sf), f"{root}/runs")
    K.clear_table(spark, f"{root}/results")
    count = lambda t: spark.read.parquet(f"{root}/{t}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
    return count("results").unionByName(count("runs"))


@query(
    "q_eval_store",
    _POINTS
    + """SELECT '2024' AS season, CAST(NULL AS BIGINT) AS gameweek, count(*) AS matched, round(avg(abs(p - a)), 6) AS mae_all FROM pt
    UNION ALL SELECT '2024', gameweek, count(*), round(avg(abs(p - a)), 6) FROM pt GROUP BY gameweek""",
)
def _eval_store(spark, sf):
    root = scratch_dir(spark, "eval")
    df = _points(spark, sf).withColumn("actual_minutes", F.when(F.col("minutes") > 1, 1).otherwise(0))
    summary, per_gw = K.eval_tables(E.evaluate_season(df), "2024")
    K.append_rows(summary, f"{root}/summary")
    K.append_rows(per_gw, f"{root}/gw")
    a = spark.read.parquet(f"{root}/summary").withColumn("gameweek", F.lit(None).cast("long"))
    both = a.unionByName(spark.read.parquet(f"{root}/gw"), allowMissingColumns=True)
    return both.select("season", "gameweek", "matched", r6("mae_all"))


@query(
    "q_run_catalog",
    RUNS
    + """SELECT CAST(runs.run_id AS VARCHAR) AS run, n_rows, model, score, CASE WHEN model < '4' THEN runs.run_id % 7 END AS depth
    FROM runs JOIN results ON runs.run_id = results.run_id""",
)
def _catalog(spark, sf):
    root = scratch_dir(spark, "runs")
    res = run_results(spark, sf)
    # three kinds of documents per run: its header, and scores and parameters of each model
    heads = runs(spark, sf).select(F.col("run_id").alias("run"), "n_rows")
    scores = res.select(F.col("run_id").alias("run"), F.col("model").alias("m"), "model", "score")
    params = scores.where("m < '4'").select("run", "m", "model", (F.col("run") % 7).alias("depth"))
    for name, part in (("meta", heads), ("metrics", scores), ("params", params)):
        part.write.partitionBy(*(c for c in ("run", "m") if c in part.columns)).json(f"{root}/{name}")
    out = S.read_run_catalog(
        spark,
        {"meta": f"{root}/meta/run=*/*.json", "metrics": f"{root}/metrics/run=*/*/*.json", "params": f"{root}/params/run=*/*/*.json"},
        {"meta": "n_rows long", "metrics": "model string, score double", "params": "model string, depth long"},
        r"run=([^/]+)/",
    )
    return out.select("run", "n_rows", "model", "score", "depth")
