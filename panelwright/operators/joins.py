"""Joins between the two sides of a match, entity resolution, set operations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.text import canonical
from panelwright.operators.clean import dedupe
from panelwright.operators.windows import Panel, tail_mean
from panelwright.semantics import broadcast_if_small, persisted


# ---- set operations ------------------------------------------------------


def union_flagged(hist: DataFrame, new: DataFrame, flag: str) -> DataFrame:
    """All rows; columns missing on one side are null; new rows carry the flag."""
    return hist.withColumn(flag, F.lit(False)).unionByName(new.withColumn(flag, F.lit(True)), allowMissingColumns=True)


def unpivot_sides(fx: DataFrame, keep: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Two rows per fixture. ``pairs``: output column -> (home column, away column)."""
    sides = [
        F.struct(*(F.col(cols[i]).alias(out) for out, cols in pairs.items()), F.lit(1 - i).alias("is_home")) for i in (0, 1)
    ]
    return fx.select(*keep, F.inline(F.array(*sides)))


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return distinct_keys(a, keys).join(b.select(*keys), list(keys), "left_anti")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def members(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_of.select(*keys), list(keys), "left_semi")


# ---- joins ---------------------------------------------------------------


def attach_period(facts: DataFrame, fx: DataFrame, match: str = "match_id", cols: Sequence[str] = ("gameweek",)) -> DataFrame:
    return lookup(facts, fx, [match], cols, order=list(cols))


def lookup(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    defaults: Mapping[str, object] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Left join against a side made unique first: the row count cannot grow."""
    unique = dedupe(dim.select(*dict.fromkeys([*keys, *cols, *order])), keys, order or cols).select(*keys, *cols)
    out = df.join(unique, list(keys), "left")
    defaults = defaults or {}
    filled = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in cols]
    return out.select(*df.columns, *filled)


def attach_opponent(facts: DataFrame, fx: DataFrame, aliases: DataFrame, match: str = "match_id", team: str = "team") -> DataFrame:
    """Opponent and venue of each row by match and canonical team name."""
    sides = unpivot_sides(fx, [match], {team: ("home_team", "away_team"), "opponent": ("away_team", "home_team")})
    sides = canonical(sides, team, aliases, "__team").select(match, "__team", "opponent", "is_home")
    named = canonical(facts, team, aliases, "__team")
    out = lookup(
        named, sides, [match, "__team"], ["opponent", "is_home"], {"opponent": "Unknown", "is_home": 0}, order=["is_home", "opponent"]
    )
    return out.drop("__team")


def pair_rows(df: DataFrame, key: str, side: str, cols: Sequence[str], prefix: str = "other_") -> DataFrame:
    """Rows of the same match with another side; sides are unique per match (two)."""
    other = df.select(key, *(F.col(c).alias(f"{prefix}{c}") for c in [side, *cols]))
    return df.join(other, key).where(F.col(side) != F.col(f"{prefix}{side}"))


def attach_opponent_features(
    df: DataFrame, panel: DataFrame, mapping: Mapping[str, str], match: str = "match_id", team: str = "team_no", opp: str = "opp_no"
) -> DataFrame:
    """The opponent's own rolled features of the same match, renamed."""
    other = panel.select(match, F.col(team).alias(opp), *(F.col(c).alias(o) for c, o in mapping.items()))
    return df.join(other, [match, opp], "left")


def resolve(
    left: DataFrame,
    right: DataFrame,
    context: Sequence[str],
    left_keys: Sequence[Column],
    right_keys: Sequence[Column],
    cols: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Match by the first of several keys that hits.

    The right side becomes one lookup table: a key claimed by an earlier
    right key wins over a later one, then row order decides. Each left key is
    one equi-join against it; left rows are never multiplied, unmatched ones
    stay with nulls. ``resolved_by`` is the number of the key that hit.
    """
    entries = [
        F.struct(F.lit(i).alias("__p"), k.alias("__k"), F.struct(*order).alias("__o"), F.struct(*cols).alias("__v"))
        for i, k in enumerate(right_keys)
    ]
    table = (
        right.select(*context, F.inline(F.array(*entries)))
        .where(F.col("__k").isNotNull() & (F.col("__k") != ""))
        .groupBy(*context, "__k")
        .agg(F.min_by("__v", F.struct("__p", "__o")).alias("__v"))
    )
    out = left
    for i, k in enumerate(left_keys):
        step = table.withColumnRenamed("__k", f"__k{i}").withColumnRenamed("__v", f"__v{i}")
        out = out.withColumn(f"__k{i}", k).join(step, [*context, f"__k{i}"], "left")
    hits = [F.col(f"__v{i}") for i in range(len(left_keys))]
    which = F.coalesce(*(F.when(h.isNotNull(), F.lit(i)) for i, h in enumerate(hits)))
    best = F.coalesce(*hits)
    return out.select(*left.columns, *(best[c].alias(c) for c in cols), which.alias("resolved_by"))


def contains_join(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str) -> DataFrame:
    """For each left row the right row whose text equals it, contains it or lies
    in it; equality first, then the smallest right id.

    Never a nested loop: a text inside another leaves a rare anchor there. An
    exact match and the two directions are three equi-joins.
    """
    a = left.select(F.col(left_id).alias("a_id"), F.col(left_text).alias("a_text"))
    b = right.select(F.col(right_id).alias("b_id"), F.col(right_text).alias("b_text"))
    equal = a.join(b, F.col("a_text") == F.col("b_text")).select("a_id", "b_id", F.lit(0).alias("kind"))
    inside = contained_pairs(a, "a_id", "a_text", b, "b_id", "b_text")
    around = contained_pairs(b, "b_id", "b_text", a, "a_id", "a_text")
    pairs = equal.unionByName(inside.withColumn("kind", F.lit(1))).unionByName(around.withColumn("kind", F.lit(1)))
    best = pairs.groupBy("a_id").agg(F.min(F.struct("kind", "b_id")).alias("best"))
    return best.select(
        F.col("a_id").alias(left_id), F.col("best.b_id").alias(right_id), (F.col("best.kind") == 0).alias("exact")
    )


def contained_pairs(needles: DataFrame, nid: str, ntext: str, hay: DataFrame, hid: str, htext: str) -> DataFrame:
    """All (needle, hay) ids where the hay text contains the needle text.

    Split at single spaces, the inner words of a needle appear in the hay text
    as whole words. Needles of four words or more are anchored on their rarest
    inner pair of words, those of three on the middle word, shorter ones on
    their rarest run of three characters. Candidates are then verified on the
    full texts.
    """
    needle = needles.select(F.col(nid).alias("n_id"), F.col(ntext).alias("n_text")).where(F.length("n_text") > 0)
    text = hay.select(F.col(hid).alias("h_id"), F.col(htext).alias("h_text"))
    # a needle is no longer than the text around it: prune both sides first
    needle = needle.where(F.length("n_text") <= text.agg(F.max(F.length("h_text"))).scalar())
    text = text.where(F.length("h_text") >= needle.agg(F.min(F.length("n_text"))).scalar())
    words = F.split("n_text", " ")
    count = F.size(words)

    def grams(seq: Column, size: int, sep: str) -> Column:
        """Distinct runs of ``size`` neighbours, built by zipping shifted copies (linear time)."""
        n = F.greatest(F.size(seq) - (size - 1), F.lit(0))
        runs = F.slice(seq, 1, n)
        for j in range(1, size):
            runs = F.zip_with(runs, F.slice(seq, j + 1, n), lambda x, y: F.concat_ws(sep, x, y))
        return runs

    inner = F.slice(words, 2, F.greatest(count - 2, F.lit(0)))
    h_words = F.split("h_text", " ")
    # (condition on the needle, needle anchors, hay anchors)
    plans: list[tuple[Column, Column, Column]] = [
        (count >= 4, grams(inner, 2, " "), grams(h_words, 2, " ")),
        (count == 3, grams(inner, 1, " "), grams(h_words, 1, " ")),
    ]
    for size in (3, 2, 1):
        fits = F.length("n_text") >= 3 if size == 3 else F.length("n_text") == size
        plans.append(((count <= 2) & fits, grams(F.split("n_text", ""), size, ""), grams(F.split("h_text", ""), size, "")))
    # one number per plan: which kinds of needle exist at all
    present = needle.agg(*(F.count_if(cond) for cond, _, _ in plans)).first()
    pairs = None
    for (cond, n_anchor, h_anchor), number in zip(plans, present):
        if not number:
            continue
        mine = needle.where(cond)
        wanted = mine.select("n_id", F.explode(F.array_distinct(n_anchor)).alias("g"))
        grams_of_needles = broadcast_if_small(wanted.select("g").distinct())
        # one pass over the texts; what is staged are hits on needle anchors only
        found = persisted(
            text.select("h_id", F.explode(h_anchor).alias("g")).join(grams_of_needles, "g", "left_semi").distinct(),
            "anchors",
        )
        freq = found.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        rare = (
            wanted.join(freq, "g", "left")
            .groupBy("n_id")
            .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r"))
            .where(F.col("r.df") > 0)
            .select("n_id", F.col("r.g").alias("g"))
        )
        step = found.join(rare, "g").select("n_id", "h_id")
        pairs = step if pairs is None else pairs.unionByName(step)
    if pairs is None:
        nothing = F.lit(None).cast(hay.schema[hid].dataType)
        return needle.where(F.lit(False)).select(F.col("n_id").alias(nid), nothing.alias(hid))
    return (
        pairs.join(text, "h_id")
        .join(needle, "n_id")
        .where(F.contains("h_text", "n_text"))
        .select(F.col("n_id").alias(nid), F.col("h_id").alias(hid))
    )


def expand_fixtures(
    ents: DataFrame, fixtures: DataFrame, entity: str, team: str, match: str, order: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """One row per entity and fixture of its team, numbered in fixture order, anew in each period of ``within``.

    Fixtures are numbered once for a team, before they multiply: every entity
    of the team has the same numbers, and copies of an entity take turns. The
    result, entities times fixtures, is made in the last step and moves
    nowhere. Only an entity listed for several teams is numbered by itself.
    """
    extra = [c for c in (*within, *order) if c != match]
    sides = unpivot_sides(fixtures, [match, *extra], {team: ("home_team", "away_team"), "opponent": ("away_team", "home_team")})
    own = Window.partitionBy(entity)
    known = ents.where(F.col(team).isNotNull()).withColumns(
        {
            "__one": F.min(team).over(own) == F.max(team).over(own),
            "__copies": F.count(F.lit(1)).over(own),
            "__copy": F.row_number().over(own.orderBy(team)),
        }
    )
    known = persisted(known, "entities")
    rn = F.row_number().over(Window.partitionBy(team, *within).orderBy(*order, "is_home"))
    spread = int(ents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the window leaves a team's fixtures together; they spread again before they multiply
    numbered = sides.withColumn("__rn", rn).repartition(spread, match, team)
    out = [team, *(c for c in ents.columns if c != team), *(c for c in sides.columns if c != team), "fixture_num"]
    number = ((F.col("__rn") - 1) * F.col("__copies") + F.col("__copy")).cast("int")
    single = broadcast_if_small(known.where("__one"))
    result = numbered.join(single, team).withColumn("fixture_num", number).select(*out)
    several = known.where("not __one").select(ents.columns)
    if several.isEmpty():
        return result
    again = F.row_number().over(Window.partitionBy(entity, *within).orderBy(*order, "is_home"))
    return result.unionByName(several.join(sides, team).withColumn("fixture_num", again).select(*out))


def carry_forward_owner(tm: DataFrame, team: str, owner: str, order: Sequence[str], cols: Sequence[str], n: int = 20, min_rows: int = 3) -> DataFrame:
    """Latest owner (manager) of each team with that owner's current state."""
    latest = tm.groupBy(team).agg(F.max_by(owner, F.when(F.col(owner).isNotNull(), F.struct(*order))).alias(owner))
    state = tail_mean(tm, Panel((owner,), tuple(order)), cols, n, min_rows)
    out = latest.join(state, owner, "left")
    return out.select(team, owner, *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def resolve_matches(
    ext: DataFrame, fx: DataFrame, aliases: DataFrame, match: str = "match_id", context: Sequence[str] = ("season",)
) -> DataFrame:
    """Match ids for externally listed fixtures, by canonical names of both sides."""

    def named(df: DataFrame) -> DataFrame:
        return canonical(canonical(df, "home_team", aliases, "__h"), "away_team", aliases, "__a")

    keys = [*context, "__h", "__a"]
    return named(ext).join(named(fx).select(match, *keys), keys).drop("__h", "__a")


def score_distinct(df: DataFrame, keys: Sequence[str], scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score each distinct request once, then hand the score to all its rows."""
    scored = scorer(df.select(*keys).distinct())
    same = None
    for k in keys:
        term = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = term if same is None else same & term
    added = [c for c in scored.columns if c not in set(keys)]
    return df.alias("l").join(scored.alias("r"), same, "left").select("l.*", *(f"r.{c}" for c in added))


def run_history(runs: DataFrame, results: DataFrame, model: str | None = None) -> DataFrame:
    """Run headers with their model results, newest first."""
    chosen = results if model is None else results.where(F.col("model") == model)
    return runs.join(chosen, "run_id").orderBy(F.desc("started"), "run_id", "model")


