"""Ranks, folds, probabilities, draws and fits against known answers."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import probability as M
from panelwright.operators import draws as X, learning as L, metrics as E
from panelwright.operators.ordering import global_row_index, time_folds, value_ranks


@pytest.mark.parametrize("heavy_rows", [3, 1_000_000])
def test_global_row_index(spark, heavy_rows):
    rnd = random.Random(5)
    rows = sorted((min(int(rnd.expovariate(1.0)), 3), rnd.randint(0, 20), i) for i in range(120))
    df = spark.createDataFrame(rows, "p int, x int, id int").repartition(5)
    out = global_row_index(df, ["p"], ["x", "id"], "i", heavy_rows=heavy_rows, parts=8)
    assert out.columns == ["p", "x", "id", "i"]
    assert [tuple(r)[:3] for r in out.orderBy("i").collect()] == rows
    assert sorted(r.i for r in out.collect()) == list(range(120))


def test_fold_sizes(spark):
    df = spark.range(103).select(F.floor(F.col("id") / 10).alias("p"), "id")
    folds = {r.fold: (r["n"], r.lo) for r in time_folds(df, ["p"], ["id"], 5).groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("lo")).collect()}
    assert folds == {0: (18, 0), **{f: (17, 18 + 17 * (f - 1)) for f in range(1, 6)}}


def test_ranks_median_and_spearman(spark):
    rnd = random.Random(9)
    xs = [float(rnd.choice([1, 1, 1, 1, 2, 3, 50, rnd.random()])) for _ in range(301)]
    ys = [x + rnd.choice([0.0, 1.0]) for x in xs]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    for r in value_ranks(df, "x", buckets=8).collect():
        assert r.n_below == sum(v < r.value for v in xs) and r.n == xs.count(r.value)
    assert E.median(df, "x").first()[0] == statistics.median(xs)

    def ranks(v):
        return np.array([sum(a < b for a in v) + (v.count(b) + 1) / 2 for b in v])

    want = np.corrcoef(ranks(xs), ranks(ys))[0, 1]
    assert E.spearman(df, "x", "y").first()[0] == pytest.approx(want, abs=1e-12)


def test_auc_edges(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert E.auc(df, "y", "p").first()[0] == 0.5
    assert E.auc(df.where("y = 1"), "y", "p").first()[0] is None


def test_distributions(spark):
    lams = [0.01, 0.4, 1.3, 3.7]
    df = spark.createDataFrame([(x,) for x in lams], "l double")
    pmf = lambda k, l: math.exp(-l) * l**k / math.factorial(k)
    for r in df.select("l", M.poisson_cdf(3, "l").alias("c"), M.expected_floor("l").alias("e")).collect():
        assert r.c == pytest.approx(sum(pmf(k, r.l) for k in range(4)), abs=1e-14)
        want = sum(pmf(k, r.l) * (k // 2) for k in range(2, 11)) + 5 * (1 - sum(pmf(k, r.l) for k in range(11)))
        assert r.e == pytest.approx(-want, abs=1e-13)
    nb = lambda k, n, m: math.exp(math.lgamma(k + n) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(n / (n + m)) + k * math.log(m / (n + m)))
    got = df.select("l", M.nb_tail(F.lit(10), F.lit(2.0), F.col("l") * 3).alias("t"), M.nb_tail(F.lit(4), F.lit(None).cast("double"), "l").alias("p")).collect()
    for r in got:
        assert r.t == pytest.approx(1 - sum(nb(k, 2.0, 3 * r.l) for k in range(10)), abs=1e-12)
        assert r.p == pytest.approx(1 - sum(pmf(k, r.l) for k in range(4)), abs=1e-12)


def test_nb_tail_rejects_larger_thresholds_than_declared(spark):
    with pytest.raises(Exception, match="threshold"):
        spark.range(1).select(M.nb_tail(F.lit(13), F.lit(2.0), F.lit(1.0), most=12)).collect()
    both = spark.range(1).select(M.nb_tail(F.lit(12), F.lit(2.0), F.lit(1.0), most=12).alias("a"), M.nb_tail(F.lit(12), F.lit(2.0), F.lit(1.0)).alias("b")).first()
    assert both.a == pytest.approx(both.b, abs=1e-14)


def test_draws_have_the_right_moments_and_are_stable(spark):
    df = spark.createDataFrame([(1, 0.1, 0.3), (2, 1.0, 0.9), (3, 2.7, 0.0), (4, 0.0, 1.0)], "id int, lam double, p double")
    made = X.draws(df, 20_000, "id", rates={"goals": "lam"}, probs={"flag": "p"})
    stats = {r.id: r for r in made.groupBy("id").agg(F.avg("goals").alias("m"), F.var_samp("goals").alias("v"), F.avg("flag").alias("f")).collect()}
    for i, lam, p in ((1, 0.1, 0.3), (2, 1.0, 0.9), (3, 2.7, 0.0), (4, 0.0, 1.0)):
        assert stats[i].m == pytest.approx(lam, rel=0.08, abs=1e-9)
        assert stats[i].v == pytest.approx(lam, rel=0.08, abs=1e-9)
        assert stats[i].f == pytest.approx(p, abs=0.02)
    again = X.draws(df.repartition(3), 50, "id", rates={"goals": "lam"}).orderBy("id", "draw_id").collect()
    assert again == X.draws(df.coalesce(1), 50, "id", rates={"goals": "lam"}).orderBy("id", "draw_id").collect()


def test_fit_count_finds_the_truth(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 2))
    y = rnd.poisson(np.exp(0.3 * x[:, 0] - 0.5 * x[:, 1] - 0.2))
    df = spark.createDataFrame([(float(a), float(b), int(c), 90.0) for (a, b), c in zip(x, y)], "a double, b double, y int, minutes double")
    model = L.fit_count(df, ["a", "b"], "y", 50.0, reg=0.0)
    assert model.stages[0].coefficients.toArray() == pytest.approx([0.3, -0.5], abs=0.05)
    assert dict(model.importance())["b"] > dict(model.importance())["a"]


def test_embedding_equals_eigenvectors(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 4)) @ rnd.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double")
    out = L.fit_embedding(df, list("abcd"), 2, F.col("i") >= 10).orderBy("i").toPandas()
    fit = x[10:]
    z = (fit - fit.mean(0)) / fit.std(0)
    _, vec = np.linalg.eigh(np.cov(z.T))
    for k, v in enumerate((vec[:, -1], vec[:, -2])):
        v = v * np.sign(v[np.abs(v).argmax()])
        assert out[f"manager_emb_{k}"][10:].to_numpy() == pytest.approx(z @ v, abs=1e-8)
    assert (out.manager_emb_0[:10] == 0).all()
    few = L.fit_embedding(df, list("abcd"), 2, F.col("i") > 198)
    assert few.agg(F.max(F.abs("manager_emb_1"))).first()[0] == 0.0


def test_oof_uses_earlier_rows_only(spark):
    df = spark.range(60).select("id", (F.col("id") * 1.0).alias("y"), F.floor(F.col("id") / 10).cast("int").alias("fold"))

    def fit(train):
        top = train.agg(F.max("id")).first()[0]
        return lambda part, out: part.withColumn(out, F.lit(float(top)))

    got = {r.id: r.o for r in L.oof_predict(df, "fold", 5, fit, "o", early=F.lit(-1.0)).collect()}
    assert all(got[i] == (-1.0 if i < 10 else i // 10 * 10 - 1) for i in range(60))


def test_single_match_labels(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 2, 1)], "p string, gw int, yellow int")
    got = sorted(((r.gw, r.yellow) for r in L.single_match_labels(df, ["p", "gw"], ["yellow"]).collect()), key=str)
    assert got == [(1, None), (1, None), (2, 1)]


def test_mutual_information_binned(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(b), float(a + 0.1 * c)) for a, b, c in zip(x, rnd.normal(size=3000), rnd.normal(size=3000))], "x double, noise double, y double")
    got = {r.feature: r.score for r in L.mutual_information(df, ["x", "noise"], "y", 8).collect()}
    assert got["x"] > 1.0 and got["noise"] < 0.05
