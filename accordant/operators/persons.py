"""Film positions on axes, and where people sit on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.operators.cells import MAX_STRENGTH, ZERO
from accordant.session import cut_lineage

# Reaction -> signed weight.
REACTION_WEIGHTS: Mapping[str, float] = {
    "loved_it": 1.0, "liked_it": 0.5, "not_for_me": -0.5, "hated_it": -1.0, "havent_seen": 0.0,
}
# Verdict label -> graded value.
VERDICT_VALUES: Mapping[str, int] = {
    "strongly_affirms": 2, "affirms": 1, "not_addressed": 0, "denies": -1, "strongly_denies": -2,
}
PAIR_WEIGHT = 0.5
PRIOR_ITEMS = 8.0
LEAN_THRESHOLD = 0.6
PLAIN_LEAN = 0.12
NEIGHBOUR_PRIOR = 0.5
MIN_FILMS_FOR_A_READ = 3
# a task of the neighbour scores sums about this many hits
HITS_PER_TASK = 4_000_000
# up to this many edges, rows of three numbers, go to every executor
EDGES_SENT = 3_000_000


def lookup(col: str | Column, table: Mapping[str, float]) -> Column:
    """Map a label through a small fixed table; unknown labels are null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def axis_loadings(items: DataFrame) -> DataFrame:
    """(item_id, factor_id, strength): every nonzero loading of every item.

    ``items``: item_id, factor_id (home), loading, loadings array<double> indexed
    by factor id.  An item without a vector counts on its home factor only, at
    its own loading, or at 1 when that is missing.
    """
    homes = items.select("factor_id").distinct()
    vector = items.filter(F.col("loadings").isNotNull()).select(
        "item_id", F.posexplode("loadings").alias("factor_id", "strength")
    ).join(F.broadcast(homes), "factor_id", "left_semi")
    short = F.col("loadings").isNull() | (F.size("loadings") <= F.col("factor_id"))
    home = items.filter(short).select(
        "item_id", "factor_id", F.coalesce("loading", F.lit(1.0)).alias("strength"))
    return vector.select("item_id", "factor_id", "strength").unionByName(home).filter(
        F.col("strength") != 0)


def film_positions(cells: DataFrame, loadings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean verdict per film and axis, with the evidence mass behind it.

    Mass is the summed |loading| over one mean |loading| of the whole solution.
    """
    unit = loadings.agg(F.avg(F.abs("strength")).alias("u")).scalar()
    w = F.abs("strength")
    v = F.col("value") / MAX_STRENGTH * F.signum("strength")
    per = cells.join(loadings, "item_id").groupBy(*keys, "film_id", "factor_id").agg(
        F.sum(v * w).alias("_num"), F.sum(w).alias("_den"), F.count(F.lit(1)).alias("n_items"))
    return per.select(
        *keys, "film_id", "factor_id", (F.col("_num") / F.col("_den")).alias("position"), "n_items",
        (F.col("_den") / unit).alias("mass"))


def contributions(cells: DataFrame, loadings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Signed share of every verdict in its film's position; the terms sum to it.

    A film's cells meet once, before they are spread over the axes: there are at most as
    many as items, and axes are few by construction.
    """
    load = F.struct("factor_id", "strength")
    of_item = cut_lineage(loadings.groupBy("item_id").agg(F.collect_list(load).alias("_loads")))
    axes = [r.factor_id for r in of_item.select(F.explode("_loads.factor_id").alias("factor_id")).distinct().collect()]
    film = Window.partitionBy(*keys, "film_id")
    size = lambda axis: F.aggregate(
        "_loads", F.lit(0.0), lambda s, e: s + F.when(e["factor_id"].eqNullSafe(axis), F.abs(e["strength"])).otherwise(0.0))
    totals = [F.sum(size(axis)).over(film).alias(f"_total{k}") for k, axis in enumerate(axes)]
    rows = cells.join(of_item, "item_id").select("*", *totals).select("*", F.explode("_loads").alias("_load"))
    axis, strength = F.col("_load.factor_id"), F.col("_load.strength")
    total = F.coalesce(F.lit(None).cast("double"), *[F.when(axis.eqNullSafe(a), F.col(f"_total{k}")) for k, a in enumerate(axes)])
    return rows.select(
        *keys, "film_id", axis.alias("factor_id"), "item_id", "value", strength.alias("loading"),
        F.when(F.col("value") > 0, "affirms").otherwise("denies").alias("verdict"),
        (strength < 0).alias("reverse_keyed"),
        F.when((F.col("value") > 0) == (strength > 0), "high").otherwise("low").alias("points_to"),
        (F.abs("value") >= MAX_STRENGTH).alias("emphatic"),
        (F.col("value") / MAX_STRENGTH * F.signum(strength) * F.abs(strength) / total).alias("contribution"))


def corpus_baseline(positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample sd of film positions per axis; a zero or undefined sd reads as 1."""
    sd = F.stddev_samp("position")
    return positions.groupBy(*keys, "factor_id").agg(
        F.avg("position").alias("middle"),
        F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd).alias("spread"))


def rating_preferences(reactions: DataFrame) -> DataFrame:
    """The newest reaction with a nonzero weight per (user, film).

    Zero-weight reactions are dropped before the choice, so they never hide an
    older answer.  Ties in time go to the larger event id.
    """
    weighted = reactions.withColumn("weight", lookup("reaction", REACTION_WEIGHTS)).filter(F.col("weight") != 0)
    newest = F.max_by(F.struct("weight", "reaction"), F.struct("submitted_at", "event_id"))
    return weighted.groupBy("user_id", "film_id").agg(newest.alias("_p")).select(
        "user_id", "film_id", F.col("_p.weight").alias("weight"), F.lit("rating").alias("source"),
        F.col("_p.reaction").alias("detail"))


def resolve_pair_answers(answers: DataFrame, decks: DataFrame, members: DataFrame) -> DataFrame:
    """Answers naming "pair-n" joined to the nth pair of their own session's deck,
    else of any deck of the user; an unordered pair keeps its newest answer.

    answers: user_id, token, question_id, choice, submitted_at, answer_id;
    decks: token, pairs array<array<bigint>>; members: token, user_id.
    """
    mine = members.join(decks, "token").select(
        "user_id", "token", F.posexplode("pairs").alias("_n", "pair")
    ).withColumn("question_id", F.concat(F.lit("pair-"), (F.col("_n") + 1).cast("string"))).drop("_n")
    have = members.select("user_id", "token", F.lit(True).alias("_known"))
    own = mine.select("user_id", "token", "question_id", F.col("pair").alias("_own"))
    any_deck = mine.groupBy("user_id", "question_id").agg(F.max_by("pair", "token").alias("_any"))
    joined = (
        answers.join(own, ["user_id", "token", "question_id"], "left")
        .join(have, ["user_id", "token"], "left")
        .join(any_deck, ["user_id", "question_id"], "left"))
    pair = F.when(F.col("_known"), F.col("_own")).otherwise(F.col("_any"))
    found = joined.withColumn("pair", pair).filter(F.col("pair").isNotNull())
    newest = F.max_by(F.struct("choice", "pair", "question_id"), F.struct("submitted_at", "answer_id"))
    return found.groupBy("user_id", F.array_sort("pair").alias("pair_key")).agg(newest.alias("_a")).select(
        "user_id", F.col("_a.question_id").alias("question_id"), F.col("_a.choice").alias("choice"), F.col("_a.pair").alias("pair"))


def pair_preferences(answers: DataFrame) -> DataFrame:
    """+0.5 toward the chosen film and -0.5 from the other; "neither" says nothing."""
    ok = answers.filter(F.col("choice").isin("a", "b") & (F.size("pair") == 2))
    chosen = F.when(F.col("choice") == "a", F.col("pair")[0]).otherwise(F.col("pair")[1])
    other = F.when(F.col("choice") == "a", F.col("pair")[1]).otherwise(F.col("pair")[0])
    return ok.select(
        "user_id", F.explode(F.array(
            F.struct(chosen.alias("film_id"), F.lit(PAIR_WEIGHT).alias("weight")),
            F.struct(other.alias("film_id"), F.lit(-PAIR_WEIGHT).alias("weight")))).alias("_p"),
        F.lit("pair").alias("source"), F.col("question_id").alias("detail"),
    ).select("user_id", "_p.film_id", "_p.weight", "source", "detail")


def all_preferences(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ratings first, then pairs: ``seq`` keeps that order for ties."""
    return ratings.withColumn("seq", F.lit(0)).unionByName(pairs.withColumn("seq", F.lit(1)))


def strongest_statement(preferences: DataFrame) -> DataFrame:
    """One weight per (user, film): the largest by magnitude, the later of equals."""
    tail = F.struct(F.abs("weight").alias("m"), F.col("seq"), F.col("detail"))
    return preferences.filter(F.col("weight") != 0).groupBy("user_id", "film_id").agg(
        F.max_by("weight", tail).alias("weight"))


def person_scores(
    preferences: DataFrame, positions: DataFrame, baseline: DataFrame | None, axes: DataFrame,
) -> DataFrame:
    """Shrunken score of every person on every axis, evidence stated.

    ``axes``: factor_id, at most a handful; every user gets every axis, at zero
    score and zero confidence where nothing engaged it.
    """
    rows = preferences.filter(F.col("weight") != 0).join(positions, "film_id")
    if baseline is not None:
        rows = rows.join(F.broadcast(baseline), "factor_id", "left")  # one row per axis
        middle = F.coalesce("middle", F.lit(0.0))
    else:
        middle = F.lit(0.0)
    w = F.col("weight")
    per = rows.groupBy("user_id", "factor_id").agg(
        F.sum(w * F.col("mass") * (F.col("position") - middle)).alias("num"),
        F.sum(F.abs(w) * F.col("mass")).alias("evidence"),
        F.count_distinct("film_id").alias("films"))
    axis_list = axes.agg(F.sort_array(F.collect_list("factor_id"))).scalar()
    grid = preferences.select("user_id").distinct().select("user_id", F.explode(axis_list).alias("factor_id"))
    out = grid.join(per, ["user_id", "factor_id"], "left")
    bar = F.lit(PLAIN_LEAN)
    if baseline is not None:
        out = out.join(F.broadcast(baseline.select("factor_id", "spread")), "factor_id", "left")
        bar = F.coalesce(LEAN_THRESHOLD * F.col("spread"), F.lit(PLAIN_LEAN))
    mass = F.coalesce("evidence", F.lit(0.0))
    out = out.withColumn("_s", F.coalesce(F.col("num") / (mass + PRIOR_ITEMS), F.lit(0.0)))
    s = F.col("_s")
    leaning = F.when(s >= bar, "high").when(s <= -bar, "low").otherwise("balanced")
    return out.select(
        "user_id", "factor_id", s.alias("score"), leaning.alias("leaning"), mass.alias("evidence_items"),
        F.coalesce("films", F.lit(0)).alias("films"), (mass / (mass + PRIOR_ITEMS)).alias("confidence"))


def neighbour_scores(
    weights: DataFrame, edges: DataFrame, prior: float = NEIGHBOUR_PRIOR, per_task: int = HITS_PER_TASK, sent: int = EDGES_SENT,
) -> DataFrame:
    """Similarity-weighted mean of a person's own weights over a film's neighbours.

    Films with no rated neighbour score 0 and are left out.  All hits of a person lie in one
    task and the tasks are as many as keep each near ``per_task`` hits, so what a task sums
    does not grow with the tables.  Up to ``sent`` edges go to every executor and no hit is shuffled.
    """
    w = cut_lineage(weights.filter(F.col("weight") != 0).select("user_id", "film_id", "weight"))
    edges = cut_lineage(edges.select("dst", "src", "similarity"))
    raters = w.groupBy(F.col("film_id").alias("dst")).agg(F.count(F.lit(1)).alias("_n"))
    met = raters.join(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_m")), "dst").agg(F.sum(F.col("_n") * F.col("_m"))).first()[0]
    tasks = max(1, min(-(-(met or 0) // per_task), 20_000))
    few = edges.count() <= sent
    mine, known = (w.repartition(tasks, "user_id"), F.broadcast(edges)) if few else (w, edges)
    hits = mine.join(known, F.col("dst") == mine.film_id).select(
        "user_id", F.col("src").alias("film_id"), "similarity", "weight")
    per = (hits if few else hits.repartition(tasks, "user_id")).groupBy("user_id", "film_id").agg(
        F.sum(F.col("similarity") * F.col("weight")).alias("num"),
        F.sum(F.abs("similarity")).alias("den"), F.count(F.lit(1)).alias("consulted"))
    return per.select(
        "user_id", "film_id", "consulted",
        F.when(F.col("den") != 0, F.col("num") / (F.col("den") + prior)).otherwise(0.0).alias("score"))


def profile_summary(
    reactions: DataFrame, answers: DataFrame, preferences: DataFrame, positions: DataFrame, scores: DataFrame,
) -> DataFrame:
    """Per person: what they told us, how much of it could be read, and the headline axis."""
    seen = [r for r, w in REACTION_WEIGHTS.items() if w]
    told = reactions.groupBy("user_id").agg(
        F.count_if(F.col("reaction").isin(seen)).alias("films_rated"),
        F.count_if(F.col("reaction") == "havent_seen").alias("films_not_seen"))
    pairs = answers.groupBy("user_id").agg(F.count_if(F.col("choice").isin("a", "b")).alias("pairs_answered"))
    placed = positions.select("film_id").distinct().withColumn("_placed", F.lit(1))
    used = preferences.select("user_id", "film_id").distinct().join(placed, "film_id", "left").groupBy("user_id").agg(
        F.count("_placed").alias("films_used"), F.count_if(F.col("_placed").isNull()).alias("films_unscored"))
    strength = F.struct(F.abs(F.round("score", 10)).alias("m"), (-F.col("factor_id")).alias("o"))
    best = F.struct("factor_id", "score")
    head = scores.groupBy("user_id").agg(
        F.max_by(best, F.when(F.col("leaning") != "balanced", strength)).alias("committed"),
        F.max_by(best, strength).alias("tilt"))
    out = told.join(pairs, "user_id", "left").join(used, "user_id", "left").join(head, "user_id", "left")
    used_n = F.coalesce("films_used", F.lit(0))
    kind = (
        F.when(F.col("committed").isNotNull(), "committed").when(used_n < MIN_FILMS_FOR_A_READ, "thin")
        .when(F.col("tilt.score") != 0, "tilt").otherwise("middle"))
    shown = F.when(kind == "committed", F.col("committed")).when(kind == "tilt", F.col("tilt"))
    return out.select(
        "user_id", "films_rated", "films_not_seen", F.coalesce("pairs_answered", F.lit(0)).alias("pairs_answered"),
        used_n.alias("films_used"), F.coalesce("films_unscored", F.lit(0)).alias("films_unscored"),
        (used_n < MIN_FILMS_FOR_A_READ).alias("provisional"), kind.alias("headline"),
        shown["factor_id"].alias("headline_axis"),
        F.when(shown["score"] > 0, "high").when(shown["score"] < 0, "low").alias("headline_side"))


def taste_reading(
    weights: DataFrame, taste: DataFrame, min_films: int = 3, buckets: int = 1024
) -> DataFrame:
    """A person's weighted mean position on each dimension and the share of the
    corpus strictly below it.

    The corpus is cut in ordered buckets per dimension: whole buckets below count
    through a cumulative sum, and only the person's own bucket is compared value
    by value, so the count is exact without a range join.
    """
    w = F.col("weight")
    mine = weights.filter(w != 0).join(taste, "film_id").groupBy("user_id", "dim_id").agg(
        (F.sum(F.col("position") * w) / F.sum(F.abs(w))).alias("mean"), F.count(F.lit(1)).alias("films_used")
    ).filter(F.col("films_used") >= min_films)
    bounds = taste.groupBy("dim_id").agg(
        F.min("position").alias("lo"), F.max("position").alias("hi"), F.count(F.lit(1)).alias("corpus"))

    def bucket(v: str) -> Column:
        width = F.col("hi") - F.col("lo")
        # a mean a rounding error above a corpus value must land in that value's bucket
        x = F.col(v) - (ZERO if v == "mean" else 0.0) - F.col("lo")
        pos = F.when(width > 0, F.floor(x / width * buckets)).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), pos)).cast("int")

    values = taste.groupBy("dim_id", "position").agg(F.count(F.lit(1)).alias("c")).join(
        F.broadcast(bounds), "dim_id").select("dim_id", "position", "c", bucket("position").alias("b"))
    filled = bounds.select("dim_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b")).join(
        values.groupBy("dim_id", "b").agg(F.sum("c").alias("c")), ["dim_id", "b"], "left")
    order = Window.partitionBy("dim_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = filled.select("dim_id", "b", F.coalesce(F.sum(F.coalesce("c", F.lit(0))).over(order), F.lit(0)).alias("before"))
    placed = mine.join(F.broadcast(bounds), "dim_id").withColumn("b", bucket("mean"))
    inside = placed.join(values, ["dim_id", "b"], "left").groupBy("user_id", "dim_id").agg(
        F.coalesce(F.sum(F.when(F.col("position") < F.col("mean") - ZERO, F.col("c"))), F.lit(0)).alias("inside"))
    out = placed.join(before, ["dim_id", "b"]).join(inside, ["user_id", "dim_id"])
    share = (F.col("before") + F.col("inside")) / F.col("corpus")
    return out.select("user_id", "dim_id", "mean", "films_used", share.alias("share_below"),
                      F.round(100.0 * share).cast("int").alias("percentile"))


def set_centroids(
    members: DataFrame, positions: DataFrame, baseline: DataFrame, min_members: int = 8, keys: Sequence[str] = (),
) -> DataFrame:
    """Mean centred position of each reference set per axis; sets with fewer
    placed members are left out."""
    keys = list(keys)
    placed = members.join(positions.select(*keys, "film_id").distinct(), "film_id")
    big = placed.groupBy(*keys, "set_id").agg(F.count_distinct("film_id").alias("members")).filter(
        F.col("members") >= min_members)
    return (
        placed.join(F.broadcast(big), [*keys, "set_id"]).join(positions, [*keys, "film_id"])
        .join(F.broadcast(baseline), [*keys, "factor_id"], "left").groupBy(*keys, "set_id", "factor_id", "members")
        .agg(F.avg(F.col("position") - F.coalesce("middle", F.lit(0.0))).alias("centroid")))


def plotted_centroids(members: DataFrame, positions: DataFrame, x_axis: int, y_axis: int, keys: Sequence[str] = ()) -> DataFrame:
    """Set centroid in a pair of axes, over the films that have both."""
    both = positions.filter(F.col("factor_id").isin(x_axis, y_axis)).groupBy(*keys, "film_id").agg(
        F.max(F.when(F.col("factor_id") == x_axis, F.col("position"))).alias("x"),
        F.max(F.when(F.col("factor_id") == y_axis, F.col("position"))).alias("y"),
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return members.join(both, "film_id").groupBy(*keys, "set_id").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("films"))


def companions(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Every other member of the viewer's sessions who has a profile, with it."""
    viewer = members.select("session_id", F.col("user_id").alias("viewer_id"))
    others = viewer.join(members, "session_id").filter(F.col("user_id") != F.col("viewer_id"))
    return others.join(scores, "user_id")
