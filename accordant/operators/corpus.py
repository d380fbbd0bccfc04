"""Corpus documents: best rows, coverage, funnels, profiles, provenance, the public index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.text import strip

# Variants from richest to thinnest.
VARIANT_PREFERENCE = ("full", "subs", "spine_themes", "spine")
MAX_QUOTES = 6
MAX_QUOTE_CHARS = 300


def variant_rank(variant: str | Column, preference: Sequence[str] = VARIANT_PREFERENCE) -> Column:
    """0 for the richest variant; null for unknown ones."""
    c = F.col(variant) if isinstance(variant, str) else variant
    pos = F.array_position(F.array(*map(F.lit, preference)), c)
    return F.when(pos > 0, pos - 1)


def best_skeletons(skeletons: DataFrame, preference: Sequence[str] = VARIANT_PREFERENCE) -> DataFrame:
    """Richest variant per film, the newest run of it."""
    rows = skeletons.withColumn("_rank", variant_rank("variant", preference)).filter(F.col("_rank").isNotNull())
    rest = [c for c in skeletons.columns if c != "film_id"]
    order = F.struct(-F.col("_rank"), F.col("created_at"), F.col("run_id"))
    return rows.groupBy("film_id").agg(F.max_by(F.struct(*rest), order).alias("s")).select("film_id", "s.*")


def trim_quotes(quotes: Column) -> Column:
    """The first quotes, long ones cut with an ellipsis, blanks dropped."""
    cut = lambda q: F.when(F.length(q) > MAX_QUOTE_CHARS, F.concat(F.rtrim(F.substring(q, 1, MAX_QUOTE_CHARS)), F.lit("…"))).otherwise(q)
    trimmed = F.transform(F.slice(quotes, 1, MAX_QUOTES), lambda q: cut(strip(q)))
    return F.filter(trimmed, lambda q: q != "")


def variant_coverage(skeletons: DataFrame, scores: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Films with a skeleton, films scored and verdict rows of every variant, also of unused ones."""
    spark = skeletons.sparkSession
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    sk = skeletons.groupBy("variant").agg(F.count_distinct("film_id").alias("films_with_skeleton"))
    sc = scores.groupBy("variant").agg(F.count_distinct("film_id").alias("films_scored"), F.count(F.lit(1)).alias("scores"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fixed.join(sk, "variant", "left").join(sc, "variant", "left").select(
        "variant", zero("films_with_skeleton"), zero("films_scored"), zero("scores"))


def axis_inventory(dims: DataFrame, assignments: DataFrame) -> DataFrame:
    per = assignments.groupBy("dim_id").agg(F.count(F.lit(1)).alias("n_items"), F.avg("fit").alias("mean_fit"))
    return dims.join(per, "dim_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).withColumn(
        "mean_fit", F.round("mean_fit", 3))


def funnel(**tables: DataFrame) -> DataFrame:
    """(stage, n): one count per named table, in the order given."""
    out = None
    for pos, (name, df) in enumerate(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(pos).alias("position"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def widest_variant(verdicts: DataFrame, assignments: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, film_id, variant): the variant with the most rows on assigned items, first of equals."""
    rows = verdicts if assignments is None else verdicts.join(assignments.select("item_id"), "item_id", "left_semi")
    n = rows.groupBy(*keys, "film_id", "variant").agg(F.count(F.lit(1)).alias("n"))
    ranked = Window.partitionBy(*keys, "film_id").orderBy(F.desc("n"), "variant")
    return n.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") == 1).select(*keys, "film_id", "variant")


def film_profiles(verdicts: DataFrame, assignments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean signed verdict per axis from each film's widest variant."""
    wide = widest_variant(verdicts, assignments, keys)
    rows = verdicts.join(wide, [*keys, "film_id", "variant"]).join(assignments, "item_id")
    return rows.groupBy(*keys, "film_id", "variant", "dim_id").agg(
        F.avg(F.col("polarity") * F.col("value")).alias("net"), F.count(F.lit(1)).alias("n_items"))


def top_axes(profiles: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys, "film_id").orderBy(F.desc(F.round(F.abs(F.col("net") * F.col("n_items")), 9)), "dim_id")
    return profiles.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def film_axes(verdicts: DataFrame, assignments: DataFrame, texts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every verdict behind a film's axis: label, direction, and its place by
    |value x confidence|.  One row per verdict, so no film's evidence is gathered."""
    wide = widest_variant(verdicts, assignments, keys)
    rows = verdicts.join(wide, [*keys, "film_id", "variant"]).join(assignments, "item_id").join(texts, "item_id")
    signed = F.col("polarity") * F.col("value")
    toward = F.when(signed > 0, "high").when(signed < 0, "low")
    verdict = F.when(F.col("value") > 0, "affirms").when(F.col("value") < 0, "denies").otherwise("not addressed")
    w = Window.partitionBy(*keys, "film_id", "dim_id").orderBy(
        F.desc(F.round(F.abs(F.col("value") * F.coalesce("confidence", F.lit(0.0))), 9)), "item_id", "run_id")
    return rows.select(*keys, "film_id", "variant", "dim_id", "item_id", "run_id", "text", verdict.alias("verdict"), toward.alias("toward"),
                       "confidence", "value").withColumn("position", F.row_number().over(w))


def reading_counts(verdicts: DataFrame, factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, films, items and named factors per reading."""
    per = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("verdicts"), F.count_distinct("film_id").alias("films"), F.count_distinct("item_id").alias("items"))
    named = factors.groupBy(*keys).agg(F.count(F.lit(1)).alias("factors"))
    return per.join(named, list(keys), "left").withColumn("factors", F.coalesce("factors", F.lit(0)))


def shown_readings(counts: DataFrame) -> DataFrame:
    """Named readings, and of scorers without one their largest reading."""
    named = counts.filter(F.col("factors") > 0)
    w = Window.partitionBy("scorer").orderBy(F.desc("verdicts"), *[c for c in ("variant", "bank_version") if c in counts.columns])
    rest = counts.join(named.select("scorer").distinct(), "scorer", "left_anti")
    return named.unionByName(rest.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r"))


def hide_withdrawn(readings: DataFrame, withdrawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shown, hidden with the reason); withdrawn is a short curated list."""
    w = F.broadcast(withdrawn)
    return readings.join(w, "scorer", "left_anti"), readings.join(w, "scorer")


def fill_gaps(own: DataFrame, incumbent: DataFrame, key: Sequence[str]) -> DataFrame:
    """The scorer's own rows, and the incumbent's where it has none."""
    return own.unionByName(incumbent.join(own.select(*key), list(key), "left_anti"))


def provenance(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per (layer, model, prompt version); a layer with several models is flagged."""
    out = None
    for layer, df in tables.items():
        one = df.groupBy("model", "prompt_version").agg(F.count(F.lit(1)).alias("n")).select(F.lit(layer).alias("layer"), "model", "prompt_version", "n")
        out = one if out is None else out.unionByName(one)
    mixed = out.groupBy("layer").agg((F.count_distinct(F.coalesce("model", F.lit(""))) > 1).alias("mixed"))
    return out.join(F.broadcast(mixed), "layer")  # one row per layer


def backfill_provenance(rows: DataFrame, runs: DataFrame, default: str | None) -> DataFrame:
    """Missing models filled from the run, then an asserted default, with where each came from."""
    joined = rows.join(runs.select("run_id", F.col("model").alias("_run_model")), "run_id", "left")
    origin = F.when(F.col("model").isNotNull(), "kept").when(F.col("_run_model").isNotNull(), "from_runs")
    origin = (origin.otherwise("asserted") if default is not None else origin.otherwise("still_null"))
    return joined.withColumn("origin", origin).withColumn(
        "model", F.coalesce("model", "_run_model", F.lit(default))).drop("_run_model")


def list_passes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("pass_name", "model").agg(F.count(F.lit(1)).alias("n"))


def taste_map(taste: DataFrame, films: DataFrame) -> DataFrame:
    """Per film a map of dimension to rounded position; a map entry per dimension."""
    entry = F.struct(F.col("dim_id").alias("k"), F.round("position", 4).alias("v"))
    per = taste.groupBy("film_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("positions"))
    return per.join(films.select("film_id", "title", "year"), "film_id")


def ordered_distribution(films: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Films per value over a fixed order; unlisted values follow together."""
    pos = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return films.groupBy(F.when(pos > 0, F.col(col)).otherwise("other").alias(col)).agg(
        F.count(F.lit(1)).alias("films"), F.min(F.when(pos > 0, pos).otherwise(len(order) + 1)).cast("int").alias("position"))


def cross_tab(films: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    return films.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1)))


def layer_quality(evidence: DataFrame) -> DataFrame:
    """Films having each layer, with the upper-median word count."""
    from accordant.functions.text import word_count
    from accordant.operators.agreement import upper_median

    rows = evidence.filter(strip(F.col("content")) != "").withColumn("words", word_count(F.col("content")))
    return rows.groupBy("layer").agg(F.count_distinct("film_id").alias("films"), upper_median("words").cast("bigint").alias("median_words"))


def article_clashes(resolved: DataFrame) -> DataFrame:
    """Articles several titles were resolved to."""
    pairs = resolved.select("article", "title").distinct()
    many = pairs.groupBy("article").agg(F.count(F.lit(1)).alias("titles")).filter(F.col("titles") > 1)
    return pairs.join(many, "article")


def item_texts(bank: DataFrame, version: str | None = None) -> DataFrame:
    rows = bank.filter(F.col("active"))
    return (rows if version is None else rows.filter(F.col("bank_version") == version)).orderBy("item_id")


def due_for_audit(verdicts: DataFrame, bank: DataFrame, redo: bool = False, min_chars: int = 25) -> DataFrame:
    cond = F.length("evidence") > min_chars
    if not redo:
        cond = cond & F.col("audited_at").isNull()
    return verdicts.filter(cond).join(bank.select("item_id", "text"), "item_id")


def apply_audit(verdicts: DataFrame, judgements: DataFrame, key: Sequence[str], at: Column) -> DataFrame:
    """Contradicted verdicts change sign and keep their size and original value; every
    judged verdict is stamped."""
    j = judgements.select(*key, "contradicted")
    joined = verdicts.join(j, list(key), "left")
    flip = F.coalesce("contradicted", F.lit(False))
    return joined.withColumn("original_value", F.when(flip, F.coalesce("original_value", "value")).otherwise(F.col("original_value"))).withColumn(
        "value", F.when(flip, -F.col("value")).otherwise(F.col("value"))).withColumn(
        "audited_at", F.when(F.col("contradicted").isNotNull(), at).otherwise(F.col("audited_at"))).drop("contradicted")


def public_index(films: DataFrame, skeletons: DataFrame, profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """One JSON record per film: what it is, where it sits, what it was read from."""
    prof = profiles.groupBy("film_id").agg(F.sort_array(F.collect_list(F.struct(
        "dim_id", F.round("net", 3).alias("net"), "n_items", "variant"))).alias("profile"))  # a film's own axes
    out = films.join(skeletons, "film_id", "left").join(prof, "film_id", "left").join(evidence, "film_id", "left")
    return out.select("film_id", F.to_json(F.struct(*[c for c in out.columns])).alias("record"))


def write_index(index: DataFrame, evidence: DataFrame, path: str) -> None:
    """The index as JSON lines and one folder of evidence per film."""
    index.select("record").write.mode("overwrite").text(f"{path}/index")
    evidence.repartition("film_id").write.mode("overwrite").partitionBy("film_id").json(f"{path}/evidence")


def film_cards(films: DataFrame, with_title: bool = True) -> DataFrame:
    """Card columns: a description only when there is one, the first genre or "Film"."""
    text = F.nullif(strip(F.col("description")), F.lit(""))
    cols = ["film_id", text.alias("description")]
    if with_title:
        cols += ["title", "year", F.coalesce(F.get("genres", 0), F.lit("Film")).alias("genre")]
    return films.select(*cols)


def pair_cards(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """Deck pairs whose both films have a description, numbered as the deck lists them."""
    rows = decks.select("token", F.posexplode("pairs").alias("n", "pair")).select(
        "token", (F.col("n") + 1).alias("n"), F.explode("pair").alias("film_id"))
    ok = rows.join(cards.filter("description is not null").select("film_id"), "film_id", "left_semi")
    return ok.groupBy("token", "n").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == 2).select("token", "n")


def missing_metadata(films: DataFrame, genres: str = "genres") -> DataFrame:
    return films.filter((F.trim("imdb_id") != "") & (F.col(genres).isNull() | F.col(genres).isin("", "[]")))


def harvest_eligible(films: DataFrame, evidence: DataFrame, min_chars: int = 2000) -> DataFrame:
    long = evidence.filter((F.col("layer") == "subtitles") & (F.length("content") > min_chars))
    return films.join(long, "film_id", "left_semi")


def latest_result(results: DataFrame, key: Sequence[str], at: str = "submitted_at", tie: str = "result_id") -> DataFrame:
    rest = [c for c in results.columns if c not in key]
    return results.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*key, "r.*")
