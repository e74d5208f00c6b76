"""Scenario tables and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import probability as M
from panelwright.operators import draws as X
from panelwright.plans.queries.scoring import r6
from panelwright.plans.registry import query
from panelwright.plans.standins import PM, player_match

_SCORED = PM + """, p AS (SELECT match_row, match_id, team_no, position, touches, CASE position WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS label FROM pm),
  dr AS (SELECT p.*, n.range + 1 AS draw_id, (touches * (n.range + 1)) % 3 AS goals, (touches + n.range + 1) % 2 AS assists,
      CAST((touches + n.range + 1) % 5 = 0 AS INTEGER) AS cs, CAST((touches + n.range + 1) % 7 = 0 AS INTEGER) AS yellow FROM p, range(20) AS n),
  sc AS (SELECT *, CASE WHEN touches % 6 <> 0 THEN touches % 10 + goals * CASE label WHEN 'GK' THEN 12 WHEN 'DEF' THEN 12 WHEN 'MID' THEN 18 ELSE 24 END + assists * 9
      + cs * CASE label WHEN 'GK' THEN 12 WHEN 'DEF' THEN 12 ELSE 0 END - 3 * yellow ELSE 0 END AS score FROM dr)
"""


def _drawn(spark, sf, n=20):
    """Draws supplied as a table: a fixed function of row and draw number."""
    t, d = F.col("touches"), F.col("draw_id")
    df = player_match(spark, sf).select("match_row", "match_id", "team_no", M.position_label("position").alias("fpl_position"), "touches")
    df = df.withColumn("draw_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return df.withColumns(
        {
            "baseline": t % 10,
            "goals": (t * d) % 3,
            "assists": (t + d) % 2,
            "clean_sheet": ((t + d) % 5 == 0).cast("int"),
            "yellow": ((t + d) % 7 == 0).cast("int"),
            "playing": t % 6 != 0,
        }
    )


@query("q_draws")
def _draws(spark, sf):
    """500 draws per player: observed mean and variance next to the parameter."""
    df = player_match(spark, sf).groupBy("player_id").agg((F.avg("shots")).alias("lam"), F.avg("yellow").alias("p_yellow"))
    drawn = X.draws(df, 500, "player_id", rates={"goals": "lam"}, probs={"yellow": "p_yellow"})
    return drawn.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.max("lam"), "lam"),
        r6(F.avg("goals"), "mean_goals"),
        r6(F.var_samp("goals"), "var_goals"),
        r6(F.max("p_yellow"), "p_yellow"),
        r6(F.avg("yellow"), "rate_yellow"),
    )


@query(
    "q_award_draws",
    _SCORED
    + """, aw AS (SELECT *, CASE WHEN score > 0 THEN greatest(0, 4 - dense_rank() OVER (PARTITION BY draw_id, match_id ORDER BY CASE WHEN score > 0 THEN score END DESC NULLS LAST)) ELSE 0 END AS award FROM sc)
    SELECT match_row, round(avg(award), 6) AS mean_award FROM aw GROUP BY match_row""",
)
def _award(spark, sf):
    return X.award_over_draws(_drawn(spark, sf), "match_row").select("match_row", r6("mean_award"))


def _totals(spark, sf):
    t, d = F.col("touches"), F.col("draw_id")
    return _drawn(spark, sf).select("team_no", "match_row", ((t * d) % 23 - 2).alias("total"))


_TOTALS = _SCORED + ", tt AS (SELECT team_no, match_row, (touches * draw_id) % 23 - 2 AS total FROM dr) "


@query(
    "q_draw_summary",
    _TOTALS
    + """SELECT team_no, quantile_cont(total, 0.5) AS median, round(quantile_cont(total, 0.1), 6) AS p10, round(quantile_cont(total, 0.9), 6) AS p90,
      round(avg(CAST(total >= 10 AS INTEGER)), 6) AS p_10plus, round(avg(CAST(total >= 15 AS INTEGER)), 6) AS p_15plus FROM tt GROUP BY team_no""",
)
def _summary(spark, sf):
    out = X.summarise_draws(_totals(spark, sf), ["team_no"], "total")
    return out.select("team_no", "median", r6("p10"), r6("p90"), r6("p_10plus"), r6("p_15plus"))


@query(
    "q_exceedance",
    _TOTALS
    + """, g AS (SELECT team_no, unnest(range(min(total), max(total) + 2)) AS x FROM tt GROUP BY team_no), c AS (SELECT team_no, total, count(*) AS n FROM tt GROUP BY 1, 2),
    a AS (SELECT team_no, sum(n) AS n FROM c GROUP BY 1)
    SELECT g.team_no, g.x, round(COALESCE(sum(c.n) FILTER (WHERE c.total >= g.x), 0) / max(a.n), 6) AS p_at_least
    FROM g JOIN a ON a.team_no = g.team_no LEFT JOIN c ON c.team_no = g.team_no GROUP BY g.team_no, g.x""",
)
def _exceed(spark, sf):
    return X.exceedance(_totals(spark, sf), ["team_no"], "total").select("team_no", "x", r6("p_at_least"))


@query(
    "q_density",
    _TOTALS
    + """, s AS (SELECT team_no, count(*) AS n, stddev_samp(total) * 0.35 AS h, min(total) - 1 AS lo, least(max(total) + 1, 30) AS hi FROM tt GROUP BY team_no),
    c AS (SELECT team_no, total, count(*) AS k FROM tt GROUP BY 1, 2), g AS (SELECT s.*, r.range AS i, lo + (hi - lo) * r.range / 199.0 AS x FROM s, range(200) AS r)
    SELECT g.team_no, CAST(i AS INTEGER) AS i, round(max(x), 6) AS x, round(sum(k * exp(-power((x - total) / h, 2) / 2)) / max(g.n * h * sqrt(2 * pi())), 6) AS density
    FROM g JOIN c ON g.team_no = c.team_no GROUP BY g.team_no, i""",
)
def _density(spark, sf):
    return X.density(_totals(spark, sf), ["team_no"], "total").select("team_no", "i", r6("x"), r6("density"))
