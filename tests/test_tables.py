"""Sources, sinks and the stream that keeps tables up to date."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from panelwright.sources import files as S, payload as P, sinks as K
from panelwright.streaming.ingest import landed_payloads, maintain_table


def document(match, goals, seq=1):
    stat = lambda v: {"stat": {"value": v}}
    return {
        "general": {"matchId": match, "homeTeam": {"name": "A", "score": goals}, "matchTimeUTCDate": f"d{seq}"},
        "content": {
            "playerStats": {
                "7": {"name": "Ann", "teamName": "A", "stats": [{"stats": {"Goals": stat(goals), "Total Shots": stat(3)}}, {"stats": {"goals": stat(99)}}]},
                "8": {"name": "Bob", "teamName": "A", "stats": []},
            },
            "shotmap": {"shots": [{"id": 1, "min": 3, "expectedGoals": 0.5}]},
        },
    }


def write(path, doc):
    with gzip.open(path, "wt") as f:
        f.write(json.dumps(doc, indent=1))


def test_payload_files(spark, tmp_path):
    write(tmp_path / "1.json.gz", document(1, 2))
    write(tmp_path / "2.json.gz", document(2, 0))
    with gzip.open(tmp_path / "bad.json.gz", "wt") as f:
        f.write("not json")
    docs = S.read_payloads(spark, str(tmp_path))
    assert docs.count() == 2
    flat = P.flatten_stats(docs)
    assert P.stat_names(flat) == ["goals", "total_shots"]
    rows = sorted(tuple(r) for r in P.promote_stats(flat, ["goals", "total_shots"]).select("match_id", "player_id", "goals", "total_shots").collect())
    assert rows == [(1, "7", 2.0, 3.0), (2, "7", 0.0, 3.0)]
    assert P.flatten_shots(docs).where("xG = 0.5 AND minute = 3").count() == 2
    home = P.project_struct(docs.where("doc.general.matchId = 1"), P.MATCH_FIELDS, root="doc.").first()
    assert (home.home_score, home.away_team) == (2, None)


def test_facts_snapshot_and_nan(spark, tmp_path):
    (tmp_path / "facts_1.csv").write_text("id,minutes_played\n1,5\n")
    (tmp_path / "facts_2.csv").write_text("id,minutes_played\n1,NaN\n2,7.5\n3,1,9\nx,1\n")
    schema = "id int, minutes_played double"
    out = S.read_facts(spark, str(tmp_path), schema, snapshots="facts_*.csv", pattern=r"facts_[^/]+")
    assert sorted((tuple(r) for r in out.collect()), key=str) == [(1, None), (2, 7.5)]
    assert S.read_facts(spark, str(tmp_path), schema, canonical="facts_1.csv").count() == 1


def test_upsert_touches_only_named_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1), (3, "c", 1, 2)], "id int, v string, seq int, season int")
    K.write_partitions(old, path, ["season"])
    before = {p.name for p in (tmp_path / "t" / "season=2").glob("*.parquet")}
    new = spark.createDataFrame([(2, "B", 2, 1), (2, "BB", 3, 1), (4, "d", 2, 1)], "id int, v string, seq int, season int")
    for _ in range(2):  # a second run changes nothing
        K.upsert_table(spark, path, old.schema, new, ["id"], "seq", ["season"])
        got = sorted((r.id, r.v) for r in spark.read.parquet(path).collect())
        assert got == [(1, "a"), (2, "BB"), (3, "c"), (4, "d")]
    assert {p.name for p in (tmp_path / "t" / "season=2").glob("*.parquet")} == before


def test_clear_keeps_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    K.append_rows(spark.range(3), path)
    K.clear_table(spark, path)
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 0


def test_limited_work_list(spark):
    cand = spark.createDataFrame([("s1", k) for k in range(4)] + [("s2", k) for k in range(10, 15)], "g string, k int")
    stored = spark.createDataFrame([(1,), (11,)], "k int")
    todo = K.missing_keys_limited(cand, stored, "g", "k", 5)
    assert sorted(tuple(r) for r in todo.collect()) == [("s1", 0), ("s1", 2), ("s1", 3), ("s2", 10), ("s2", 12)]
    assert {r.g: r.n for r in K.per_group(todo, "g").collect()} == {"s1": 3, "s2": 2}


def test_stream_keeps_the_table(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")

    def flatten(batch):
        flat = P.project_struct(batch, P.MATCH_FIELDS, root="doc.")
        return flat.select("match_id", "home_score", F.col("match_date").alias("seq"), (F.col("match_id") % 2).alias("part"))

    def run():
        stream = landed_payloads(spark, str(landing), files_per_batch=1)
        q = maintain_table(stream, flatten, table, checkpoint, ["match_id"], "seq", ["part"])
        q.awaitTermination(120)
        return {r.match_id: r.home_score for r in spark.read.parquet(table).collect()}

    write(landing / "1.json.gz", document(1, 2))
    write(landing / "2.json.gz", document(2, 0))
    assert run() == {1: 2, 2: 0}
    write(landing / "3.json.gz", document(1, 5, seq=2))
    write(landing / "4.json.gz", document(3, 1))
    assert run() == {1: 5, 2: 0, 3: 1}


def test_log_projection_defaults(spark):
    row = K.log_projection(spark.createDataFrame([(7, None)], "gameweek int, pred_bonus double")).first()
    assert (row.gameweek, row.pred_bonus, row.fpl_position, row.is_home) == (7, 0.0, "MID", None)
    assert len(K.PREDICTION_LOG) == 20


def test_scratch_needs_shared_storage(spark, monkeypatch):
    from panelwright import semantics

    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("X", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        semantics.scratch_dir(Remote(), "x")


def test_a_payload_is_parsed_once_and_rows_are_dealt_before_files(spark, tmp_path):
    from panelwright.plans.queries.tables import _documents

    text = spark.createDataFrame([(json.dumps(document(1, 2)),), ("{broken",), (None,), ("{}",), ('{"general":{}}',)], "value string")
    docs = S.parse_documents(text)
    got = P.project_struct(docs, P.MATCH_FIELDS, root="doc.")
    assert [tuple(r)[:4] for r in got.orderBy("match_id").collect()] == [(None, None, None, None), (1, "A", None, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1

    ts = F.timestamp_seconds(F.col("id") + 1704067200)
    props = F.concat(F.lit('{"k": '), F.col("id"), F.lit("}"))
    spark.range(50).select(
        F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), props.alias("props")
    ).write.parquet(f"{tmp_path}/events.parquet")
    made = _documents(spark, str(tmp_path))
    assert made.count() == 50
    assert "Repartition" in made._jdf.queryExecution().optimizedPlan().toString()
