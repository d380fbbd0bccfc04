"""Agreement between conditions, scorers, passes and versions of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLIP_AGREES = 0.10
FLIP_MIXED = 0.25
INFLATES = 1.15
DEFLATES = 0.85


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def flip_band(rate: Column) -> Column:
    """agree / mixed / misleading at 0.10 and 0.25; no overlap reads as agree."""
    rate = F.coalesce(rate, F.lit(0.0))
    return F.when(rate < FLIP_AGREES, "agree").when(rate < FLIP_MIXED, "mixed").otherwise("misleading")


def compare_conditions(
    cells: DataFrame, reference: str, keys: Sequence[str] = (),
) -> DataFrame:
    """Each item of each film under the reference variant against every other
    variant: agree, flip, or silent on one side.

    Only films read under both conditions take part.
    """
    keys = list(keys)
    by = [*keys, "film_id", "variant", "item_id"]
    ref = cells.filter(F.col("variant") == reference)
    other = cells.filter(F.col("variant") != reference)
    both = other.select(*keys, "film_id", "variant").distinct().join(
        ref.select(*keys, "film_id").distinct(), [*keys, "film_id"], "left_semi")
    left = ref.drop("variant").join(both, [*keys, "film_id"]).select(*by, F.col("value").alias("a"))
    right = other.join(both, [*keys, "film_id", "variant"], "left_semi").select(*by, F.col("value").alias("b"))
    outcome = (
        F.when(F.col("b").isNull(), "missed").when(F.col("a").isNull(), "extra")
        .when(F.col("a") == F.col("b"), "agree").otherwise("flip"))
    return left.join(right, by, "full_outer").withColumn("outcome", outcome)


def _outcome_counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("agree", "flip", "missed", "extra")]


def _rates(df: DataFrame) -> DataFrame:
    both = F.col("agree") + F.col("flip")
    union = both + F.col("missed") + F.col("extra")
    return df.withColumn("flip_rate", _ratio(F.col("flip"), both)).withColumn(
        "silence_rate", _ratio(F.col("missed"), both + F.col("missed"))
    ).withColumn("overall_disagreement", _ratio(F.col("flip") + F.col("missed") + F.col("extra"), union))


def condition_report(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates per variant and per film of it, both grains in one pass.

    ``film_id`` is null on the variant's total row.
    """
    keys = list(keys)
    grouped = outcomes.groupBy(*keys, "variant").agg(
        *_outcome_counts(), F.count_distinct("film_id").alias("films")
    ).withColumn("film_id", F.lit(None).cast(outcomes.schema["film_id"].dataType))
    films = outcomes.groupBy(*keys, "variant", "film_id").agg(*_outcome_counts()).withColumn(
        "films", F.lit(1).cast("bigint"))
    out = _rates(grouped.unionByName(films))
    return out.withColumn("band", flip_band(F.col("flip_rate")))


def condition_rollup(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same report from one ``rollup(variant, film)``."""
    keys = list(keys)
    rolled = outcomes.rollup(*keys, "variant", "film_id").agg(
        *_outcome_counts(), F.grouping_id().alias("_g"))
    out = rolled.filter(F.col("_g") <= 1).drop("_g")
    return _rates(out).withColumn("band", flip_band(F.col("flip_rate")))


def resistant_items(outcomes: DataFrame, keys: Sequence[str] = (), min_both: int = 3, top: int = 25) -> DataFrame:
    """The items the other conditions contradict most, by flip rate then flips."""
    keys = list(keys)
    per = outcomes.groupBy(*keys, "item_id").agg(
        F.count_if(F.col("outcome") == "agree").alias("agree"),
        F.count_if(F.col("outcome") == "flip").alias("flip"),
        F.count_if(F.col("outcome").isin("missed", "extra")).alias("silence"),
    ).filter(F.col("agree") + F.col("flip") >= min_both)
    per = per.withColumn("flip_rate", F.round(F.col("flip") / (F.col("flip") + F.col("agree")), 3))
    order = [F.desc("flip_rate"), F.desc("flip"), F.asc("item_id")]
    if not keys:
        return per.orderBy(*order).limit(top)
    w = Window.partitionBy(*keys).orderBy(*order)
    return per.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def displacement(
    cells: DataFrame, pairs: DataFrame, keys: Sequence[str] = (), summary: str = "spine", dialogue: str = "subs",
) -> DataFrame:
    """How far a child entity moved from its parent, per variant, with the ratio
    of the summary variant's displacement to the dialogue variant's.

    Distances are summed as decimals and a ratio is held against the limits at twelve
    places: one that is exactly a limit must not pass it by the order in which thirds were
    added, nor by how they are stored.
    """
    keys = list(keys)
    p = cells.join(pairs, cells.film_id == pairs.parent_id).select(
        *keys, "parent_id", "child_id", "variant", "item_id", F.col("value").alias("p"))
    c = cells.select(*keys, F.col("film_id").alias("child_id"), "variant", "item_id", F.col("value").alias("c"))
    distance = F.abs(F.col("p") - F.col("c")).cast("decimal(38,18)")
    per = p.join(c, [*keys, "child_id", "variant", "item_id"]).groupBy(
        *keys, "parent_id", "child_id", "variant"
    ).agg(
        F.count(F.lit(1)).alias("shared_items"),
        F.count_if(F.col("p") != F.col("c")).alias("moved"),
        (F.sum(distance).cast("double") / (2 * F.count(F.lit(1)))).alias("displacement"),
    )
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("displacement")))
    ratio = per.groupBy(*keys, "parent_id", "child_id").agg(
        _ratio(pick(summary), pick(dialogue)).alias("summary_inflation"))
    held = F.round("summary_inflation", 12)
    reading = (
        F.when(held.isNull(), None).when(held > INFLATES, "exaggerates")
        .when(held < DEFLATES, "understates").otherwise("agrees"))
    return per.join(ratio, [*keys, "parent_id", "child_id"]).withColumn("reading", reading)


def coverage_pivot(cells: DataFrame, variants: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Items engaged per film, one column per variant."""
    return cells.groupBy(*keys, "film_id").pivot("variant", list(variants)).agg(F.count(F.lit(1)))


def cohens_kappa(labels: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Chance-corrected agreement of two labelings, for every key at once.

    ``labels`` holds one row per item with both labels; everything after the
    confusion count is bounded by the number of labels.
    """
    keys = list(keys)
    cells = labels.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = cells.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("agree"))
    ma = cells.groupBy(*keys, F.col("a").alias("label")).agg(F.sum("c").alias("ca"))
    mb = cells.groupBy(*keys, F.col("b").alias("label")).agg(F.sum("c").alias("cb"))
    dot = ma.join(mb, [*keys, "label"]).groupBy(*keys).agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"))
    chance = F.coalesce(F.col("dot"), F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    out = total.join(dot, keys, "left").withColumn("raw", F.col("agree") / F.col("n")).withColumn("chance", chance)
    kappa = F.when(F.col("chance") < 1, (F.col("raw") - F.col("chance")) / (1 - F.col("chance")))
    return out.withColumn("kappa", kappa).drop("dot")


def scorer_pairs(cells: DataFrame, on: Sequence[str], scorer: str = "scorer", value: str = "value") -> DataFrame:
    """Cells two scorers both voted on, each unordered pair once."""
    a = cells.select(*on, F.col(scorer).alias("scorer_a"), F.col(value).alias("a"))
    b = cells.select(*on, F.col(scorer).alias("scorer_b"), F.col(value).alias("b"))
    return a.join(b, list(on)).filter(F.col("scorer_a") < F.col("scorer_b"))


def co_engagement(cells: DataFrame, assignments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of co-engaged item pairs on the same axis, from counts alone:
    sum of c(c-1)/2 per (packet, axis) over sum of N(N-1)/2 per packet."""
    keys = list(keys)
    packet = [*keys, "film_id", "variant"]
    per_axis = cells.join(assignments, "item_id").groupBy(*packet, "dim_id").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    per = per_axis.groupBy(*packet).agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"), F.sum("c").alias("N"))
    total = F.sum(F.col("N") * (F.col("N") - 1) / 2)
    return per.groupBy(*keys).agg(
        F.sum("same").cast("bigint").alias("same_pairs"), total.cast("bigint").alias("total_pairs"),
        F.when(total > 0, F.sum("same") / total).otherwise(0.0).alias("co_engagement"))


def stance_coherence(
    cells: DataFrame, assignments: DataFrame, keys: Sequence[str] = (), min_items: int = 3
) -> DataFrame:
    """Mean |sum of signed verdicts| / count over (packet, axis) cells with enough items."""
    keys = list(keys)
    signed = F.col("polarity") * F.col("value")
    per = cells.join(assignments, "item_id").groupBy(*keys, "film_id", "variant", "dim_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum(signed).alias("s")).filter(F.col("c") >= min_items)
    return per.groupBy(*keys).agg(
        F.avg(F.abs(F.col("s")) / F.col("c")).alias("coherence"), F.count(F.lit(1)).alias("n_cells"))


def scorer_report(cells: DataFrame, refusals: DataFrame) -> DataFrame:
    """Films, verdicts, items per film, affirm share and refusals of each scorer."""
    per = cells.groupBy("scorer").agg(
        F.count_distinct("film_id").alias("films"), F.count(F.lit(1)).alias("verdicts"),
        F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("affirm_share"))
    refused = refusals.groupBy("scorer").agg(F.count(F.lit(1)).alias("refusals"))
    return per.join(refused, "scorer", "left").select(
        "scorer", "films", "verdicts", (F.col("verdicts") / F.col("films")).alias("items_per_film"),
        "affirm_share", F.coalesce("refusals", F.lit(0)).alias("refusals"))


def axis_lean(cells: DataFrame, assignments: DataFrame, incumbent: str) -> DataFrame:
    """Mean signed verdict per scorer and axis, and its gap to the incumbent's."""
    lean = cells.join(assignments, "item_id").groupBy("scorer", "dim_id").agg(
        F.avg(F.col("polarity") * F.col("value")).alias("lean"), F.count(F.lit(1)).alias("n"))
    base = lean.filter(F.col("scorer") == incumbent).select("dim_id", F.col("lean").alias("incumbent_lean"))
    return lean.filter(F.col("scorer") != incumbent).join(F.broadcast(base), "dim_id").withColumn(
        "gap", F.col("lean") - F.col("incumbent_lean"))


def two_readers(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Two scorers on every film: engaged, only-one, shared, agreed by sign, split."""
    wide = cells.filter(F.col("scorer").isin(a, b)).groupBy("film_id", "item_id").pivot("scorer", [a, b]).agg(
        F.first("value"))
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    both = x.isNotNull() & y.isNotNull()
    same = (x > 0) == (y > 0)
    return wide.groupBy("film_id").agg(
        F.count_if(x.isNotNull()).alias("engaged_a"), F.count_if(y.isNotNull()).alias("engaged_b"),
        F.count_if(x.isNotNull() & y.isNull()).alias("only_a"), F.count_if(y.isNotNull() & x.isNull()).alias("only_b"),
        F.count_if(both).alias("shared"), F.count_if(both & same).alias("agreed"),
        F.count_if(both & ~same).alias("split"),
        F.coalesce(_ratio(F.count_if(x > 0), F.count_if(x.isNotNull())), F.lit(0.0)).alias("affirm_rate_a"),
        F.coalesce(_ratio(F.count_if(y > 0), F.count_if(y.isNotNull())), F.lit(0.0)).alias("affirm_rate_b"))


def split_rows(cells: DataFrame, a: str, b: str) -> DataFrame:
    """The items on which two readers take opposite sides of the same film."""
    x = cells.filter(F.col("scorer") == a).select("film_id", "item_id", F.col("value").alias("value_a"))
    y = cells.filter(F.col("scorer") == b).select("film_id", "item_id", F.col("value").alias("value_b"))
    return x.join(y, ["film_id", "item_id"]).filter((F.col("value_a") > 0) != (F.col("value_b") > 0))


def answered_by_all(rows: DataFrame, keys: Sequence[str], scorer: str = "scorer") -> DataFrame:
    """Keys every scorer of the table holds."""
    total = rows.agg(F.count_distinct(scorer)).scalar()
    return rows.groupBy(*keys).agg(F.count_distinct(scorer).alias("_n")).filter(
        F.col("_n") == total).drop("_n")


def missing_answers(asked: DataFrame, answered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Asked minus answered."""
    return asked.join(answered.select(*keys).distinct(), list(keys), "left_anti")


def missing_of_bank(answered: DataFrame, bank: Column, respondent: str = "film_id", item: str = "item_id") -> DataFrame:
    """``missing_answers`` where every respondent of ``answered`` is asked the whole ``bank``,
    an array: a respondent's answers are one row, so the asked pairs meet nothing and are
    neither shuffled nor sorted.  A missing respondent has answered nothing."""
    got = answered.groupBy(respondent).agg(F.collect_set(item).alias("_got"))
    left = F.when(F.col(respondent).isNull(), bank).otherwise(F.array_except(bank, "_got"))
    return got.select(respondent, F.explode(left).alias(item))


def incomplete_respondents(
    asked: DataFrame, answered: DataFrame, slice_size: int = 20
) -> DataFrame:
    """Unanswered items per (scorer, film, slice of the asked list); a respondent
    with no answer at all is marked empty."""
    w = Window.partitionBy("scorer", "film_id").orderBy("item_id")
    keys = ["scorer", "film_id", "item_id"]
    sliced = asked.withColumn("slice", F.floor((F.row_number().over(w) - 1) / slice_size).cast("bigint"))
    got = answered.select(*keys).distinct().withColumn("_got", F.lit(1))
    per = sliced.join(got, keys, "left").groupBy("scorer", "film_id", "slice").agg(
        F.count(F.lit(1)).alias("asked"), F.count("_got").alias("answered"))
    total = per.groupBy("scorer", "film_id").agg(F.sum("answered").alias("_total"))
    return per.join(total, ["scorer", "film_id"]).select(
        "scorer", "film_id", "slice", "asked", (F.col("asked") - F.col("answered")).alias("missing"),
        (F.col("_total") == 0).alias("empty_respondent"))


def own_source_excluded(verdicts: DataFrame, lineage: DataFrame) -> DataFrame:
    """Drop verdicts where the film is one of the item's own source films."""
    return verdicts.join(lineage, ["film_id", "item_id"], "left_anti")


def recheck_by_axis(assignments: DataFrame, main: str = "main") -> DataFrame:
    """How often another pass put an axis's items back on it, with the upper-median fit."""
    m = assignments.filter(F.col("pass_name") == main)
    r = assignments.filter(F.col("pass_name") != main).select(
        "item_id", F.col("dim_id").alias("other_dim"), F.col("polarity").alias("other_polarity"))
    rows = m.join(r, "item_id", "left")
    rechecked = F.count("other_dim")
    return rows.groupBy("dim_id").agg(
        F.count(F.lit(1)).alias("n_items"), upper_median("fit").alias("median_fit"), rechecked.alias("rechecked"),
        _ratio(F.count_if(F.col("other_dim") == F.col("dim_id")), rechecked).alias("same_axis"),
        _ratio(F.count_if(F.col("other_polarity") == F.col("polarity")), rechecked).alias("same_polarity"))


def upper_median(col: str) -> Column:
    """Element n//2 of the sorted non-null values: the discrete median read from
    the top.  The aggregate keeps one counter per distinct value, not the rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col} DESC)")
