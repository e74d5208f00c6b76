"""Joins, resolution, text and cleaning on hand-made frames."""

import itertools
import random

from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.operators import clean as C, joins as J, ranking as K


def test_contained_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["ab", "b", "abc", "é", "cab", "", "d'a", "bca"]
    hay = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for i in range(60)}
    needles = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for i in range(80)}
    needles |= {100: "b c", 101: "a", 102: "bc", 103: hay[7], 104: "zzz", 105: ""}
    # parts of longer texts, cut inside words
    needles |= {200 + i: hay[i][1:-1] for i in range(20)}
    n = spark.createDataFrame(list(needles.items()), "nid int, nt string")
    h = spark.createDataFrame(list(hay.items()), "hid int, ht string")
    got = sorted(tuple(r) for r in J.contained_pairs(n, "nid", "nt", h, "hid", "ht").collect())
    want = sorted((i, j) for (i, a), (j, b) in itertools.product(needles.items(), hay.items()) if a and a in b)
    assert got == want


def test_contains_join_prefers_equality(spark):
    a = spark.createDataFrame([(1, "city"), (2, "man city"), (3, "old man city hall"), (4, "none")], "a int, t string")
    b = spark.createDataFrame([(10, "man city"), (11, "city"), (12, "city hall")], "b int, u string")
    got = {r.a: (r.b, r.exact) for r in J.contains_join(a, b, "a", "t", "b", "u").collect()}
    assert got == {1: (11, True), 2: (10, True), 3: (10, False)}


def test_contained_pairs_empty(spark):
    n = spark.createDataFrame([], "nid int, nt string")
    h = spark.createDataFrame([(1, "x")], "hid int, ht string")
    assert J.contained_pairs(n, "nid", "nt", h, "hid", "ht").count() == 0


def test_resolve_priority_and_row_count(spark):
    left = spark.createDataFrame([(1, "ann lee", "x"), (2, "bob ray", "x"), (3, "zed", "x"), (4, "ann lee", None)], "id int, name string, team string")
    right = spark.createDataFrame(
        [(1, "bob ray", "", "x", 5), (2, "q lee", "lee", "x", 6), (3, "ann lee", "al", "y", 7), (4, "lee", "w", "x", 8)],
        "rid int, full string, web string, team string, pts int",
    )
    out = J.resolve(left, right, ["team"], [F.col("name"), T.last_token("name")], [F.col("full"), F.col("web")], ["pts"], ["rid"])
    got = {r.id: (r.pts, r.resolved_by) for r in out.collect()}
    # row 1: no full name in its team, last word: the full name 'lee' beats the web name 'lee'
    assert got == {1: (8, 1), 2: (5, 0), 3: (None, None), 4: (None, None)}


def test_lookup_never_multiplies(spark):
    left = spark.createDataFrame([(i % 3,) for i in range(30)], "k int")
    dim = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k int, v string")
    out = J.lookup(left, dim, ["k"], ["v"], {"v": "-"})
    assert out.count() == 30
    assert sorted(r.v for r in out.distinct().collect()) == ["-", "a", "c"]


def test_fixtures_are_numbered_before_they_multiply(spark):
    rng = random.Random(3)
    games = [(i, *rng.sample("abcd", 2), rng.randrange(2), rng.randrange(6)) for i in range(40)]
    fx = spark.createDataFrame(games, "match_id int, home_team string, away_team string, season int, day int")
    listed = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, "c"), (4, "d"), (None, "a"), (5, None), (6, "z"), (4, "c"), (7, "d")]
    ents = spark.createDataFrame(listed, "e int, team string")

    def plain(rows):
        sides = [(m, s, d, t, o, h) for m, a, b, s, d in games for t, o, h in ((a, b, 1), (b, a, 0))]
        found = sorted((e, s, d, m, h, t, o) for e, t in rows for m, s, d, u, o, h in sides if u == t)
        out, n = [], {}
        for e, s, d, m, h, t, o in found:
            n[e, s] = n.get((e, s), 0) + 1
            out.append((e, s, n[e, s], m, h, o))
        return sorted(out)

    cols = ["e", "season", "fixture_num", "match_id", "is_home", "opponent"]
    got = J.expand_fixtures(ents, fx, "e", "team", "match_id", ["day", "match_id"], ["season"])
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert sorted(r for r in rows if r[0] is not None) == plain([r for r in listed if r[0] is not None])
    assert sorted((0, *r[1:]) for r in rows if r[0] is None) == plain([(0, "a")])
    single = J.expand_fixtures(ents.where("e < 4"), fx, "e", "team", "match_id", ["day", "match_id"], ["season"])
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("Window")


def test_two_matches_in_a_period_stay_apart(spark):
    tm = spark.createDataFrame(
        [(1, "a", "b", 2), (1, "b", "a", 0), (2, "a", "c", 1), (2, "c", "a", 3)], "match_id int, team_no string, opp_no string, goals int"
    )
    got = sorted(tuple(r) for r in J.pair_rows(tm, "match_id", "team_no", ["goals"]).select("match_id", "team_no", "other_goals").collect())
    assert got == [(1, "a", 0), (1, "b", 2), (2, "a", 3), (2, "c", 1)]


def test_dedupe_normalises_and_keeps_first_or_last(spark):
    df = spark.createDataFrame([(1, " Ann "), (2, "ann"), (3, "Bob"), (4, None), (5, None)], "i int, n string")
    first = sorted(r.i for r in C.dedupe(df, ["n"], ["i"], ["n"]).collect())
    last = sorted(r.i for r in C.dedupe(df, ["n"], ["i"], ["n"], keep="last").collect())
    assert first == [1, 3, 4] and last == [2, 3, 5]


def test_dedupe_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = C.dedupe(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_before_is_per_column(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, None, "y"), ("a", 3, 9, None)], "e string, t int, v int, s string")
    assert K.latest_before(df, ["e"], ["t"], ["v", "s"], F.col("t") < 3).first() == ("a", 5, "y")


def test_texts(spark):
    df = spark.createDataFrame([("O'Neil  Müller",), ("Çelik",), (None,)], "n string")
    rows = df.select(T.norm_key("n"), T.fold_accents("n"), T.last_token("n")).collect()
    assert [tuple(r) for r in rows] == [("oneil__müller", "o'neil  muller", "Müller"), ("çelik", "celik", None), ("", "", None)]
    df = spark.createDataFrame([("4-2-3-1",), ("4-4-2",), ("3-5",), ("442",), ("a-b",), ("",), (None,)], "f string")
    got = [tuple(r.x) for r in df.select(T.parse_formation("f").alias("x")).collect()]
    none = (None, None, None)
    assert got == [(4, 5, 1), (4, 4, 2), (3, 0, 5), none, none, none, none]


def test_availability(spark):
    df = spark.createDataFrame([("Ann Lee",), ("Bob Ray",), ("Cy Fox",), ("Di Roe",)], "n string")
    avail = spark.createDataFrame(
        [("ann lee", "i", 0), ("ray", "d", 25), ("cy fox", "a", None)], "name string, status string, chance int"
    )
    got = {r.n: r.chance_of_playing for r in C.availability_filter(df, "n", avail).collect()}
    assert got == {"Bob Ray": 25, "Cy Fox": 100, "Di Roe": 100}


def test_coerce_and_fill(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("x", 2.0), (None, None)], "a string, b double")
    got = [tuple(r) for r in C.coerce_numeric(df, ["a", "b", "c"]).collect()]
    assert got == [(1.5, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 0.0)]
