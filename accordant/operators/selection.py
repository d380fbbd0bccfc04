"""Choosing and describing entities: rules, facets, greedy coverage, lookups, naming."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from accordant.functions.text import is_placeholder, plain_key, slug, split_disambiguated, title_key
from accordant.session import cut_lineage

# What a new value of each facet is worth.
FACET_WEIGHTS: Mapping[str, float] = {"language": 3.0, "country": 3.0, "decade": 1.5, "genre": 1.0}
# Titles that are no single film, and the least size of an article.
SKIP_TITLES = (
    r"(?i)^(List of|Category:|Template:|Index of|Outline of)|\b(film series|filmography|awards|soundtrack|video game)\b"
)
MIN_ARTICLE_BYTES = 20_000


# -- facets and coverage ----------------------------------------------------------

def facets(films: DataFrame) -> DataFrame:
    """(film_id, facet, value): language, country, genres and decade, blanks left out.

    Columns that are absent give no facet.
    """
    one = lambda name, c: F.array(F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")))
    each = lambda name: F.transform(name, lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value")))
    parts = []
    for name in ("language", "country"):
        if name in films.columns:
            if isinstance(films.schema[name].dataType, ArrayType):  # several countries count each
                parts.append(each(name))
            else:
                parts.append(one(name, F.col(name)))
    if "genres" in films.columns:
        parts.append(F.transform("genres", lambda g: F.struct(F.lit("genre").alias("facet"), g.alias("value"))))
    if "year" in films.columns:
        decade = F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s"))
        parts.append(one("decade", F.when(F.col("year") != 0, decade)))
    rows = films.select("film_id", F.explode(F.concat(*parts)).alias("f")).select("film_id", "f.facet", "f.value")
    return rows.filter(F.coalesce("value", F.lit("")) != "")


def facet_coverage(films: DataFrame, top: int = 5) -> DataFrame:
    """Distinct values, the commonest ones and the share of the commonest, per facet."""
    counts = facets(films).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("facet").agg(
        F.count(F.lit(1)).alias("distinct_values"), (F.max("n") / F.sum("n")).alias("dominance"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    best = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.join(F.broadcast(total), "facet")  # one row per facet


def greedy_coverage(films: DataFrame, n: int, already: DataFrame | None = None, ahead: int = 2000) -> DataFrame:
    """n films, each adding the most that is missing: the sum of weight / (1 + times
    seen) over its facets, over sqrt(1 + number of facets); ties by least id.

    Films with the same facets are interchangeable, so they are one row holding
    their first n ids.  What a film adds never grows as others are picked, so gains that
    were worked out earlier bound later ones: a job brings the ``ahead`` rows that gain most
    now, and picks are made among them, each worked out anew only when it comes first, as
    long as the best stands before all rows left behind.
    """
    spark = films.sparkSession
    rows = facets(films).select("film_id", F.struct("facet", "value").alias("f"))
    sig = rows.groupBy("film_id").agg(F.sort_array(F.collect_list("f")).alias("sig"))  # a film's own facets
    sig = films.select("film_id").join(sig, "film_id", "left").withColumn(
        "sig", F.coalesce("sig", F.array().cast(sig.schema["sig"].dataType)))
    seen: dict[tuple[str, str], int] = {}
    if already is not None:
        old = sig.join(already.select("film_id"), "film_id", "left_semi")
        for r in old.select(F.explode("sig").alias("f")).groupBy("f.facet", "f.value").count().collect():  # facet values
            seen[(r[0], r[1])] = r[2]
        sig = sig.join(already.select("film_id"), "film_id", "left_anti")
    w = Window.partitionBy("sig").orderBy("film_id")
    first = sig.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    pool = first.groupBy("sig").agg(F.sort_array(F.collect_list("film_id")).alias("ids"))
    pool = cut_lineage(pool.withColumn("key", F.monotonically_increasing_id()))
    used: dict[int, int] = {}
    picks: list[tuple[int, int, float]] = []
    while len(picks) < n:
        best = _most_gaining(pool, seen, used, ahead + 1)
        behind = (-best[ahead]["gain"], best[ahead]["next"]) if len(best) > ahead else None
        before = len(picks)
        heap = [(-r["gain"], r["next"], k, before) for k, r in enumerate(best[:ahead])]
        heapq.heapify(heap)
        while heap and len(picks) < n:
            gain, film, k, known = heapq.heappop(heap)
            row = best[k]
            if known < len(picks):  # worked out before the latest pick
                heapq.heappush(heap, (-_gain(row["sig"], seen), film, k, len(picks)))
                continue
            if behind is not None and (gain, film) > behind:
                break
            picks.append((len(picks) + 1, film, -gain))
            at = used[row["key"]] = used.get(row["key"], 0) + 1
            for f in row["sig"]:
                seen[(f["facet"], f["value"])] = seen.get((f["facet"], f["value"]), 0) + 1
            if at < len(row["ids"]):
                heapq.heappush(heap, (-_gain(row["sig"], seen), row["ids"][at], k, len(picks)))
        if len(picks) == before:
            break
    kind = films.schema["film_id"].dataType.simpleString()
    return spark.createDataFrame(picks, f"pick int, film_id {kind}, gain double")


def _gain(sig: list, seen: dict[tuple[str, str], int]) -> float:
    """What ``_most_gaining`` works out, for one row."""
    total = 0.0
    for f in sig:
        total += FACET_WEIGHTS.get(f["facet"], 1.0) / (1.0 + seen.get((f["facet"], f["value"]), 0))
    return float(Decimal(repr(total / math.sqrt(1.0 + len(sig)))).quantize(Decimal("1e-12"), ROUND_HALF_UP))


def _most_gaining(pool: DataFrame, seen: dict[tuple[str, str], int], used: dict[int, int], most: int) -> list:
    """The ``most`` rows that add most now, with the film that would be picked next."""
    worth = F.create_map(*[F.lit(x) for kv in FACET_WEIGHTS.items() for x in kv])
    counts = F.create_map(*[F.lit(x) for (f, v), c in seen.items() for x in (f"{f}|{v}", float(c))]) if seen else None
    taken = F.create_map(*[F.lit(x) for kv in used.items() for x in kv]) if used else None
    at = lambda f: F.coalesce(F.try_element_at(counts, F.concat_ws("|", f["facet"], f["value"])), F.lit(0.0)) if seen else F.lit(0.0)
    total = F.aggregate("sig", F.lit(0.0), lambda s, f: s + F.coalesce(worth[f["facet"]], F.lit(1.0)) / (1.0 + at(f)))
    gain = F.round(total / F.sqrt(F.lit(1.0) + F.size("sig")), 12)
    skip = F.coalesce(F.try_element_at(taken, F.col("key")), F.lit(0)) if used else F.lit(0)
    rows = pool.withColumn("next", F.get("ids", skip)).filter(F.col("next").isNotNull())
    return rows.select("key", "sig", "ids", "next", gain.alias("gain")).orderBy(F.desc("gain"), "next").limit(most).collect()


# -- sets and lookups ---------------------------------------------------------------

def by_rule(films: DataFrame, rule: Mapping[str, object]) -> DataFrame:
    """Films under a country / language / year rule; an unknown year is 0 as a lower
    and 9999 as an upper bound."""
    cond: Column = F.lit(True)
    has = lambda c, needle: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(str(needle).lower()))
    if rule.get("country"):
        cond = cond & has("country", rule["country"])
    if rule.get("language"):
        cond = cond & has("language", rule["language"])
    if rule.get("year_min") is not None:
        cond = cond & (F.coalesce("year", F.lit(0)) >= rule["year_min"])
    if rule.get("year_max") is not None:
        cond = cond & (F.coalesce("year", F.lit(9999)) <= rule["year_max"])
    return films.filter(cond).select("film_id")


def resolve_titles(wanted: DataFrame, films: DataFrame) -> DataFrame:
    """Set titles matched on the comparable key, first film of equals; misses keep a
    null film."""
    index = films.select(title_key(F.col("title")).alias("key"), "film_id").groupBy("key").agg(F.min("film_id").alias("film_id"))
    return wanted.withColumn("key", title_key(F.col("title"))).join(index, "key", "left").drop("key")


def set_report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("asked"), F.count_distinct("film_id").alias("found"),
        F.count_if(F.col("film_id").isNull()).alias("missing"))


def match_entities(wanted: DataFrame, films: DataFrame) -> DataFrame:
    """Each wanted text to the film with that id, or the first film (by year, title)
    whose title holds it; misses keep a null film.

    Ids are a hash join. A title holds a text only if it holds the text's first three
    characters, so the rest is a hash join too, on the runs of three characters of the
    titles; texts of one or two characters use runs of their own length.
    """
    asked = wanted.select("wanted").filter("wanted is not null").distinct()
    own = films.select("film_id", "year", "title", F.lower("title").alias("_t"))
    by_id = own.join(asked, own.film_id.cast("string") == asked.wanted).select("wanted", F.lit(False).alias("x"), "year", "title", "film_id")
    low = asked.withColumn("_w", F.lower("wanted")).withColumn("_g", F.substring("_w", 1, 3))
    runs = F.expr("array_distinct(flatten(transform(sequence(0, 3), k -> "
                  "transform(sequence(1, greatest(length(_t), 1)), i -> substring(_t, i, k)))))")
    held = own.select("*", F.explode(runs).alias("_g"))
    by_text = held.join(low, "_g").filter(F.contains("_t", "_w")).select("wanted", F.lit(True).alias("x"), "year", "title", "film_id")
    found = by_id.union(by_text).groupBy("wanted").agg(
        F.min_by("film_id", F.struct("x", "year", "title", "film_id")).alias("film_id"))
    return wanted.join(found, "wanted", "left")


def search(films: DataFrame, query: str, fields: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Films under a named predicate whose fields hold the text, case aside."""
    hay = F.lower(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))
    cond = F.contains(hay, F.lit(query.strip().lower()))
    return films.filter(cond if keep is None else cond & keep)


def discover(articles: DataFrame, per_year: int = 10, min_bytes: int = MIN_ARTICLE_BYTES) -> DataFrame:
    """The longest articles of each year without lists, franchises and the like, with
    the disambiguator split off the title."""
    ok = articles.filter(~F.col("article").rlike(SKIP_TITLES) & (F.col("bytes") >= min_bytes))
    w = Window.partitionBy("year").orderBy(F.desc("bytes"), F.desc("article"))
    top = ok.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_year)
    t = split_disambiguated(F.col("article"))
    return top.select(
        t["title"].alias("title"), F.coalesce(t["year"], F.col("year")).alias("year"), "article", "bytes", "rank",
        F.concat(F.lit("discovered:"), F.col("year").cast("string")).alias("note"))


def seed_entries(found: DataFrame, known: DataFrame) -> DataFrame:
    """New candidates minus known ids, one per id, the article kept where it differs from the title."""
    keyed = found.withColumn("film_id", slug(F.col("title"), F.col("year")))
    new = keyed.join(known.select("film_id"), "film_id", "left_anti")
    first = F.min_by(F.struct("title", "year", "note", "article"), F.struct("year", "rank", "article", "note"))
    one = new.groupBy("film_id").agg(first.alias("f"))
    return one.select("film_id", "f.title", "f.year", "f.note", F.when(F.col("f.article") != F.col("f.title"), F.col("f.article")).alias("article"))


def check_articles(films: DataFrame, lookups: DataFrame) -> DataFrame:
    """stored / unchanged / no_article / no_entity / suspect for every film with an id.

    lookups: imdb_id, labels array, years array, article.  An entity agrees when the
    comparable title equals, holds or is held by a label and the year is within one.
    """
    rows = films.filter(F.trim(F.coalesce("imdb_id", F.lit(""))) != "").join(lookups, "imdb_id", "left")
    labels = rows.select("film_id", F.explode_outer("labels").alias("l")).withColumn("l", plain_key(F.col("l"))).groupBy("film_id").agg(
        F.collect_set("l").alias("keys"))
    rows = rows.join(labels, "film_id", "left").withColumn("t", plain_key(F.col("title")))
    same = F.exists("keys", lambda k: (k == F.col("t")) | F.contains(k, F.col("t")) | F.contains(F.col("t"), k))
    title_ok = (F.coalesce(F.size("labels"), F.lit(0)) <= 0) | same
    near = F.exists("years", lambda y: F.abs(y - F.col("year")) <= 1)
    year_ok = (F.coalesce(F.size("years"), F.lit(0)) <= 0) | F.col("year").isNull() | near
    status = (
        F.when(F.col("labels").isNull(), "no_entity").when(~(title_ok & year_ok), "suspect")
        .when(F.col("article").isNull(), "no_article")
        .when(F.coalesce("wikipedia_title", F.lit("")) == F.col("article"), "unchanged").otherwise("stored"))
    return rows.select("film_id", status.alias("status"), F.when(status == "stored", F.col("article")).alias("article"))


def fold_labels(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """One record per key: the sorted distinct values of each column, unresolved
    Q-number labels dropped."""
    clean = lambda c: F.when(~F.col(c).rlike("^Q[0-9]+$"), F.col(c))
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(clean(c))).alias(c) for c in values])


def notable(rows: DataFrame) -> DataFrame:
    """Earliest year and the title and links of that row per id, most linked first."""
    first = F.min_by(F.struct("title", "sitelinks"), F.struct("year", -F.col("sitelinks"), "title"))
    return rows.groupBy("imdb_id").agg(F.min("year").alias("year"), first.alias("f")).select(
        "imdb_id", "year", "f.title", "f.sitelinks").orderBy(F.desc("sitelinks"), "imdb_id")


# -- naming -----------------------------------------------------------------------

def consensus_naming(names: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The run per key with the fewest unnamed ends, then the most agreement with the
    other runs, then the first.

    names: keys, run_id, factor_id, pole_high, pole_low.  Agreement is the token
    Jaccard of both poles averaged over the factors two runs share.
    """
    keys = list(keys)
    tokens = lambda c: F.filter(F.array_distinct(F.split(F.trim(F.lower(F.coalesce(F.col(c), F.lit("")))), r"\s+")), lambda w: w != "")
    rows = names.withColumn("hi", tokens("pole_high")).withColumn("lo", tokens("pole_low"))
    side = lambda s: rows.select(*keys, "factor_id", F.col("run_id").alias(f"run_{s}"), F.col("hi").alias(f"hi_{s}"), F.col("lo").alias(f"lo_{s}"))

    def jaccard(x: str, y: str) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)

    pair = side("a").join(side("b"), [*keys, "factor_id"]).filter(F.col("run_a") != F.col("run_b"))
    per = pair.groupBy(*keys, "run_a", "run_b").agg(
        F.avg((jaccard("hi_a", "hi_b") + jaccard("lo_a", "lo_b")) / 2).alias("s"))
    score = per.groupBy(*keys, F.col("run_a").alias("run_id")).agg(F.sum("s").alias("score"))
    vague = F.sum(is_placeholder(F.col("pole_high")).cast("int") + is_placeholder(F.col("pole_low")).cast("int"))
    runs = names.groupBy(*keys, "run_id").agg(vague.alias("placeholders")).join(score, [*keys, "run_id"], "left")
    runs = runs.withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("placeholders", F.desc(F.round("score", 10)), "run_id")
    return runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def items_by_pole(items: DataFrame, min_weight: float = 0.20, per_end: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    """Each factor's items by the sign of their loading, strongest first, faint ones left out."""
    weight = F.abs(F.coalesce("loading", F.lit(1.0)))
    end = F.when(F.coalesce("loading", F.lit(1.0)) >= 0, "high").otherwise("low")
    rows = items.withColumn("weight", weight).withColumn("end", end).filter(F.col("weight") >= min_weight)
    w = Window.partitionBy(*keys, "group_id", "end").orderBy(F.desc("weight"), "item_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_end)


# -- factor pages -------------------------------------------------------------------

def factor_detail(cells: DataFrame, items: DataFrame, positions: DataFrame, min_items: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Per factor: affirmations and denials of its own items, corpus score and the
    number of films with enough items to be placed."""
    by = [*keys, "factor_id"]
    sides = cells.join(items.select("item_id", "factor_id"), "item_id").groupBy(*by).agg(
        F.count_if(F.col("value") > 0).alias("affirms"), F.count_if(~(F.col("value") > 0)).alias("denies"))
    placed = positions.filter(F.col("n_items") >= min_items).groupBy(*by).agg(F.count(F.lit(1)).alias("films_positioned"))
    total = F.col("affirms") + F.col("denies")
    return sides.join(placed, by, "left").select(
        *by, "affirms", "denies",
        F.when(total > 0, F.round((F.col("affirms") - F.col("denies")) / total, 3)).otherwise(0.0).alias("corpus_score"),
        F.coalesce("films_positioned", F.lit(0)).alias("films_positioned"))


def strongest_items(cells: DataFrame, items: DataFrame, limit: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    """A factor's own items by weight, distance, then engagement, with their counts."""
    keys = list(keys)
    sides = cells.groupBy(*keys, "item_id").agg(
        F.count_if(F.col("value") > 0).alias("affirms"), F.count_if(~(F.col("value") > 0)).alias("denies"))
    every = items.join(F.broadcast(cells.select(*keys).distinct())) if keys else items  # one row per reading
    rows = every.join(sides, [*keys, "item_id"], "left").withColumn("affirms", F.coalesce("affirms", F.lit(0))).withColumn(
        "denies", F.coalesce("denies", F.lit(0))).withColumn("weight", F.abs("loading"))
    w = Window.partitionBy(*keys, "factor_id").orderBy(
        F.desc(F.coalesce("weight", F.lit(0.0))), F.coalesce("distance", F.lit(0.0)), F.desc(F.col("affirms") + F.col("denies")), "item_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def pole_films(positions: DataFrame, per_pole: int = 10, min_items: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """The films at both ends of every axis."""
    by = [*keys, "factor_id"]
    rows = positions.filter(F.col("n_items") >= min_items).withColumn("score", F.round("position", 8))
    high = Window.partitionBy(*by).orderBy(F.desc("score"), "film_id")
    low = Window.partitionBy(*by).orderBy("score", F.desc("film_id"))
    top = rows.withColumn("rank", F.row_number().over(high)).filter(F.col("rank") <= per_pole).withColumn("pole", F.lit("high"))
    bottom = rows.withColumn("rank", F.row_number().over(low)).filter(F.col("rank") <= per_pole).withColumn("pole", F.lit("low"))
    return top.unionByName(bottom).select(*by, "pole", "rank", "film_id", "score")


def position_histogram(positions: DataFrame, bins: int = 17, keys: Sequence[str] = ()) -> DataFrame:
    """Films per bin of [-1, 1] on each axis, half-up rounding to the nearest bin."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.round("position", 10) + 1) / 2 * (bins - 1) + 0.5)))
    return positions.groupBy(*keys, "factor_id", bin_of.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("films"))


def position_summary(positions: DataFrame, edge: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    p = F.round("position", 10)
    return positions.groupBy(*keys, "factor_id").agg(
        F.avg("position").alias("mean"), F.count_if(p > edge).alias("high"), F.count_if(p < -edge).alias("low"),
        F.count_if((p <= edge) & (p >= -edge)).alias("between"))


def distinctive_taste(taste: DataFrame, k: int = 3, min_films: int = 20, floor: float = 0.5) -> DataFrame:
    """A film's most unusual taste rows: population z of at least the floor, bars clamped at 3."""
    stats = taste.groupBy("dim_id").agg(
        F.avg("position").alias("m"), F.stddev_pop("position").alias("s"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") >= min_films) & (F.col("s") > 0))
    z = (F.col("position") - F.col("m")) / F.col("s")
    rows = taste.join(F.broadcast(stats), "dim_id").withColumn("z", z).filter(F.abs(F.round("z", 10)) >= floor)
    rows = rows.withColumn("bar", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / 3)))
    w = Window.partitionBy("film_id").orderBy(F.desc(F.abs(F.round("bar", 10))), "dim_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("film_id", "dim_id", "z", "bar", "rank")


def films_on_axis(positions: DataFrame, axis: int) -> DataFrame:
    return positions.filter(F.col("factor_id") == axis).orderBy(F.desc(F.round("position", 10)), "film_id")


def with_adjusted(positions: DataFrame, adjusted: DataFrame) -> DataFrame:
    """The taste-adjusted position beside the raw one; films without one keep the raw."""
    return positions.join(adjusted.select("film_id", "factor_id", F.col("score").alias("score_adjusted"), "taste_explained"),
                          ["film_id", "factor_id"], "left")


def axis_names(scorer_k: DataFrame, own: DataFrame, incumbent: DataFrame) -> DataFrame:
    """Readable names from the scorer's own axes, else the incumbent's set of the same size."""
    k_inc = incumbent.groupBy("dim_version").agg(F.count_distinct("dim_id").alias("k"))
    inc = incumbent.join(k_inc, "dim_version").groupBy("k", "dim_id").agg(F.min_by("name", "dim_version").alias("inc_name"))
    grid = scorer_k.select("scorer", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("dim_id"))
    mine = own.select("scorer", "dim_id", F.col("name").alias("own_name"))
    out = grid.join(mine, ["scorer", "dim_id"], "left").join(inc, ["k", "dim_id"], "left")
    return out.select("scorer", "dim_id", F.coalesce("own_name", "inc_name").alias("name"))
