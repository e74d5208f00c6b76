"""Coming rows from kept state against the whole history; owners; cross-fitted chains."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import chain as C, owners as O
from panelwright.operators.state import build_state, from_state, merge_states
from panelwright.operators.windows import Expanding, FillPrior, Lag, Panel, Rolling, add_prior
from panelwright.plans import features as T, future as N
from panelwright.plans.standins import PLAYER, TEAM, player_match, sides

SF = "/root/testdata/sf0.001"
SCHEMA = "who int, season int, t int, a double, b long"
PANEL = Panel(("who",), ("t",))
FEATURES = [
    Rolling("a", 3, "a3"),
    Rolling("b", 2, "b2", agg="sum", default=0),
    Rolling("a", 4, "a4_min", agg="min", min_count=2),
    Rolling("a", 5, "a5_in", within=("season",)),
    Lag("b", "last", default=-1),
    Lag("a", "second", k=2),
    Lag("a", "last_in", within=("season",)),
    FillPrior("a", "filled"),
    Expanding("b", "total"),
    Expanding("a", "mean", "avg"),
    Expanding("a", "known", "count"),
    Expanding(None, "rows", "rows"),
    Expanding("b", "in_season", default=0, within=("season",)),
    Expanding(None, "rows_in_season", "rows", within=("season",)),
]


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_state_gives_what_the_history_gives(spark, parts):
    rng = random.Random(parts)
    rows = []
    for who in range(12):
        for i in range(rng.choice([0, 1, 2, 5, 40])):
            rows.append((who, i // 6, i, rng.choice([None, 1.5, -2.0, 7.25]), rng.choice([None, 1, 5])))
    ahead = [(w, s, 1000 + k, None, None) for w in range(14) for k, s in enumerate(rng.choice([(6,), (6, 6), (9, 9, 10)]))]
    past, future = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(ahead, SCHEMA)
    want = add_prior(past.unionByName(future), PANEL, FEATURES).where("t >= 1000")
    cuts = [r % parts for r in range(40)] if parts > 1 else [0] * 40
    state = None
    for p in range(parts):
        part = spark.createDataFrame([r for r in rows if cuts[r[2]] == p], SCHEMA)
        new = build_state(part, PANEL, FEATURES)
        state = new if state is None else merge_states(state, new, PANEL, FEATURES)
    got = from_state(future, state, PANEL, FEATURES)
    assert set(got.columns) == set(want.columns)
    assert rounded(map(tuple, got.select(want.columns).collect())) == rounded(map(tuple, want.collect()))


def test_future_features_equal_the_table_once_played(spark):
    """Every column of the feature table, the state built in three batches of whole days."""
    pm = player_match(spark, SF).cache()
    last = pm.agg(F.max("d")).first()[0]
    listed = sides(pm)
    owners, _ = O.owner_embedding(pm, listed.drop("manager_id"), O.spells(listed, ["team_no"], "manager_id", "d"), ["d", "match_id", "team_no"], "d")
    owners = owners.cache()
    table = T.player_features(pm, PLAYER, TEAM, owners=owners)
    first = pm.where(F.col("d") == last).groupBy("player_id").agg(F.min(F.struct("ts", "match_row")).alias("f")).select(F.col("f.match_row").alias("match_row"))
    state = None
    for lo, hi in ((0, 9), (9, 17), (17, last)):
        part = pm.where((F.col("d") >= lo) & (F.col("d") < hi))
        state = N.build(part, PLAYER, TEAM) if state is None else state.updated(part)
    known = ["match_row", "player_id", "ts", "slot", "d", "season", "gameweek", "team_no", "opp_no", "match_id", "is_home", "position"]
    coming = pm.join(first, "match_row", "left_semi").select(*known)
    got = N.future_features(coming, state, owners)
    names = [c for c in table.columns if c not in pm.columns and c not in ("defcon", "hit_threshold", "defcon_threshold") and not (c.endswith("_per90") and not c.startswith("lifetime"))]
    assert len(names) > 250 and set(names) <= set(got.columns)
    want = {r.match_row: r for r in table.join(first, "match_row", "left_semi").collect()}
    found = got.collect()
    assert len(found) == len(want) > 10
    # the table knows nothing of an opponent without rows in the match, the state does
    there = {(r.match_id, r.team_no) for r in pm.where(F.col("d") == last).select("match_id", "team_no").distinct().collect()}
    compared = [r for r in found if (r.match_id, r.opp_no) in there or r.match_id is None]
    assert len(compared) > 5
    for r in compared:
        for c in names:
            x, y = r[c], want[r.match_row][c]
            assert x == y or (x is not None and y is not None and abs(x - y) < 1e-9 * max(1, abs(y))), (c, x, y)


# ---- owners --------------------------------------------------------------


def test_spells_and_point_in_time(spark):
    seen = spark.createDataFrame(
        [("x", 1, 5), ("x", 1, 9), ("x", 2, 20), ("x", 1, 300), ("y", 7, 4), ("y", 8, 4), (None, 3, 2), ("x", None, 400), ("z", 1, None)],
        "team string, owner int, at long",
    )
    found = O.spells(seen, ["team"], "owner", "at")
    assert {(r.team, r.owner, r.start, r.stop) for r in found.collect()} == {
        (None, 3, 2, None), ("x", 1, 5, 20), ("x", 1, 300, None), ("x", 2, 20, 300), ("y", 8, 4, None)
    }
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None, "w"]), rng.choice([None, *range(0, 500)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, team string, at long")
    spans = [(r.team, r.owner, r.start, r.stop) for r in found.collect()]
    for width in (1, 7, 1000):
        got = {r.i: r.owner for r in O.point_in_time(df, found, ["team"], "at", ["owner"], width=width).collect()}
        assert len(got) == len(rows)
        for i, team, at in rows:
            inside = [o for t, o, s, e in spans if t == team and at is not None and s <= at and (e is None or at < e)]
            assert got[i] == (inside[0] if inside else None)


def test_overlapping_spells_end_as_the_next_starts(spark):
    spans = spark.createDataFrame([("x", 1, 0, 100), ("x", 2, 40, 60), ("x", 3, 90, None)], "team string, owner int, start long, stop long")
    df = spark.createDataFrame([("x", t) for t in (0, 39, 40, 59, 60, 89, 90, 500)], "team string, at long")
    got = {r.at: r.owner for r in O.point_in_time(df, spans, ["team"], "at", ["owner"], width=16).collect()}
    assert got == {0: 1, 39: 1, 40: 2, 59: 2, 60: None, 89: None, 90: 3, 500: 3}


def test_basis_is_orthonormal_stored_and_frozen(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    x[:, 4] = 3.0  # constant
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double, e double")
    basis = O.fit_basis(df, list("abcde"), 3)
    load = np.array(basis.loadings)
    assert np.allclose(load @ load.T, np.eye(3), atol=1e-9) and np.allclose(load[:, 4], 0)
    basis.save(spark, str(tmp_path / "basis"))
    assert O.Basis.load(spark, str(tmp_path / "basis")) == basis
    z = (x[:, :4] - x[:, :4].mean(0)) / x[:, :4].std(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    out = basis.project(df, F.col("i") >= 10, "e_", 3).orderBy("i").toPandas()
    for i in range(3):
        v = vectors[:, -1 - i]
        v = v if v[np.abs(v).argmax()] > 0 else -v
        assert np.allclose(out[f"e_{i}"][10:], (z @ v)[10:], atol=1e-9) and (out[f"e_{i}"][:10] == 0).all()
    few = O.fit_basis(df.limit(2), list("abcde"), 3)
    assert few.loadings == () and few.project(df.limit(4), F.lit(True), "e_", 3).where("e_0 <> 0").count() == 0


def test_sides_to_come_have_their_owners_present_form(spark):
    pm = player_match(spark, SF).cache()
    listed = sides(pm)
    stays = O.spells(listed, ["team_no"], "manager_id", "d")
    order = ["d", "match_id", "team_no"]
    all_sides = listed.drop("manager_id")
    last = pm.agg(F.max("d")).first()[0]
    whole, basis = O.owner_embedding(pm, all_sides, stays, order, "d")
    ahead, same = O.owner_embedding(pm.where(F.col("d") < last), all_sides, stays, order, "d", basis)
    assert same is basis
    # an owner with two sides on the last day has seen the first of them only in the whole table
    day = listed.where(F.col("d") == last)
    single = day.join(day.groupBy("manager_id").count().where("count = 1"), "manager_id", "left_semi").select("match_id", "team_no")
    a = rounded(map(tuple, whole.join(single, ["match_id", "team_no"], "left_semi").collect()))
    b = rounded(map(tuple, ahead.join(single, ["match_id", "team_no"], "left_semi").select(whole.columns).collect()))
    assert len(a) > 3 and a == b


# ---- chain ---------------------------------------------------------------


def _mean_step(out, target, needs=(), **kw):
    """A model that can only repeat what it saw: the mean target, plus the mean of its inputs."""

    def fit(train):
        m = train.agg(F.avg(target)).first()[0]
        extra = sum(train.agg(F.avg(c)).first()[0] or 0.0 for c in needs)
        return lambda df, name: df.withColumn(name, F.lit(float(m if m is not None else -1.0) + extra))

    return C.Step(out, fit, needs=tuple(needs), **kw)


def test_period_folds_never_divide_a_period(spark):
    rows = [(p, i) for p in range(20) for i in range(30 if p == 3 else 4)] + [(None, 0)]
    df = spark.createDataFrame(rows, "period int, i int")
    folds = {r.period: r.fold for r in C.period_folds(df, ["period"], 4).collect()}
    assert folds[None] == 0 and set(folds.values()) == set(range(5))
    order = [folds[p] for p in range(20)]
    assert order == sorted(order)


def test_a_leak_would_show(spark):
    """The target is the period itself: a prediction made from any period at or after its own would reach it."""
    rows = [(p, float(p)) for p in range(24) for _ in range(5)]
    df = spark.createDataFrame(rows, "period int, y double")
    calendar = C.period_folds(df, ["period"], 5)
    table = C.with_folds(df, calendar, ["period"])
    steps = [_mean_step("p3", "y", ["p2"]), _mean_step("p1", "y", early=F.lit(0.0)), _mean_step("p2", "y", ["p1"], early=F.lit(0.0))]
    fitted = C.fit_chain({"rows": table}, steps, 5)
    assert [s.out for s, _ in fitted.steps] == ["p1", "p2", "p3"]
    train = fitted.training["rows"].select("period", "fold", "p1", "p2").distinct().collect()
    assert len(train) == 24
    fold_of = {r.period: r.fold for r in train}
    p1 = {p: 0.0 for p in range(24)}
    for r in sorted(train):
        if r.fold == 0:
            assert (r.p1, r.p2) == (0.0, 0.0)
            continue
        earlier = [p for p in range(24) if fold_of[p] < r.fold]
        assert max(earlier) < r.period
        p1[r.period] = float(np.mean(earlier))
        assert r.p1 == pytest.approx(p1[r.period])
        # the second step's inputs are honest as well: the first step's predictions of those periods
        assert r.p2 == pytest.approx(np.mean(earlier) + np.mean([p1[p] for p in earlier]))
        assert r.p1 < r.period
    deployed = fitted.predict({"rows": df.limit(1)})["rows"].first()
    assert deployed.p1 == pytest.approx(11.5)


def test_steps_of_two_tables_share_folds(spark):
    rows = [(p, s) for p in range(12) for s in range(4)]
    teams = spark.createDataFrame([(p, s, float(p * 10 + s)) for p, s in rows], "period int, side int, conceded double")
    players = spark.createDataFrame([(p, s, s ^ 1, 1.0) for p, s in rows for _ in range(3)], "period int, side int, opp int, y double")
    calendar = C.period_folds(players, ["period"], 3)
    shared = {"players": ("pred_for", ("period", "opp"), ("period", "side"), 1.3)}
    by_side = C.Step("against", lambda t: (lambda m: lambda df, out: df.withColumn(out, F.lit(m)))(t.agg(F.max("conceded")).first()[0]), "teams", shared=shared)
    steps = [C.Step("goal", _mean_step("goal", "y", ["pred_for"]).fit, "players", ("pred_for",)), by_side]
    tables = {"teams": C.with_folds(teams, calendar, ["period"]), "players": C.with_folds(players, calendar, ["period"])}
    fitted = C.fit_chain(tables, steps, 3)
    for r in fitted.training["players"].select("period", "fold", "pred_for").distinct().collect():
        assert r.pred_for == (1.3 if r.fold == 0 else r.pred_for) and (r.fold == 0 or r.pred_for < r.period * 10)
    assert "goal" in fitted.predict({"teams": teams, "players": players})["players"].columns


def test_steps_that_do_not_need_each_other_are_staged_once(spark, monkeypatch):
    rows = [(p, s, float(p)) for p in range(12) for s in range(4)]
    df = spark.createDataFrame(rows, "period int, side int, y double")
    calendar = C.period_folds(df, ["period"], 3)
    table, other = (C.with_folds(df, calendar, ["period"]) for _ in range(2))
    written, fitted_on = [], []
    stage = C.persisted
    monkeypatch.setattr(C, "persisted", lambda d, label: (written.append(set(d.columns)), stage(d, label))[1])

    def mean(name, on="rows", needs=(), **more):
        def fit(train):
            fitted_on.append(train.count())
            value = train.agg(F.avg("y")).first()[0]
            return lambda d, out: d.withColumn(out, F.lit(value))

        return C.Step(name, fit, on, tuple(needs), **more)

    shared = {"rows": ("seen", ("period", "side"), ("period", "side"), None)}
    steps = [mean("p1"), mean("p2"), mean("q", "other", shared=shared), mean("end", needs=("p1", "p2", "seen"))]
    fitted = C.fit_chain({"rows": table, "other": other}, steps, 3, workers=1)
    # each table once, with all that was added to it
    assert len(written) == 2 and {"q"} < written[0] and {"p1", "p2", "seen"} < written[1]
    # the fold with the most to learn from is not the last to start
    assert fitted_on[0] == max(fitted_on[:9]) > fitted_on[8]
    fold_of = {r.period: r.fold for r in calendar.collect()}
    for r in fitted.training["rows"].collect():
        earlier = [p for p in range(12) if fold_of[p] < r.fold]
        want = pytest.approx(np.mean(earlier)) if earlier else None
        assert (r.p1, r.p2, r.seen) == (want, want, want)
    assert fitted.training["rows"].count() == 48


def test_a_step_without_needs_does_not_wait_for_staged_predictions(spark):
    rows = [(p, float(p)) for p in range(12) for _ in range(3)]
    df = spark.createDataFrame(rows, "period int, y double")
    table = C.with_folds(df, C.period_folds(df, ["period"], 3), ["period"])
    seen = []

    def step(name, needs=()):
        def fit(train):
            seen.append((name, set(train.columns), train.count()))
            value = train.agg(F.avg("y")).first()[0]
            return lambda d, out: d.withColumn(out, F.lit(value))

        return C.Step(name, fit, "rows", tuple(needs))

    fitted = C.fit_chain({"rows": table}, [step("p1"), step("alone"), step("end", ["p1"])], 3, workers=2)
    assert [s.out for s, _ in fitted.steps] == ["p1", "alone", "end"]
    whole = {name: cols for name, cols, n in seen if n == 36}
    assert "p1" not in whole["alone"] | whole["p1"] and "p1" in whole["end"]
    assert len(seen) == 6 and fitted.training["rows"].count() == 36


def test_needs_nobody_makes_are_an_error():
    with pytest.raises(ValueError, match="nothing makes"):
        C.ordered([C.Step("a", None, needs=("b",)), C.Step("b", None, needs=("a",))])


def test_unknown_features_are_an_error(spark):
    from panelwright.operators.learning import with_vector

    with pytest.raises(ValueError, match="no such features"):
        with_vector(spark.range(2), ["id", "idd"])
