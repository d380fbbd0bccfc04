"""Keyed writes on parquet: every write goes to a new path or its own partitions.

Upserts return the new table; the caller writes it beside the old one and swaps,
so no job reads and overwrites the same files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import slug
from accordant.sources.catalog import ENTITY_COLUMNS, TableSpec

CURATED = ("description", "artwork_url", "description_source")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert rows, or replace only the columns the new rows name."""
    key = list(key)
    named = [c for c in new.columns if c not in key]
    marked = new.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in named])
    joined = old.withColumn("_old", F.lit(True)).join(marked, key, "full_outer")
    return joined.select(*[
        F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
        for c in old.columns])


def refresh(old: DataFrame, new: DataFrame, key: Sequence[str], curated: Sequence[str] = CURATED) -> DataFrame:
    """Metadata refresh: a null or empty incoming value keeps a curated column's stored one."""
    key = list(key)
    named = [c for c in new.columns if c not in key]
    marked = new.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in named])
    joined = old.join(marked, key, "full_outer")

    def value(c: str) -> Column:
        incoming = F.col(f"_n_{c}")
        if c in curated:
            return F.coalesce(F.nullif(incoming, F.lit("")), F.col(c))
        return F.when(F.col("_new"), incoming).otherwise(F.col(c))

    return joined.select(*[value(c).alias(c) if c in named else F.col(c) for c in old.columns])


def backfill(old: DataFrame, record: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Update only the columns the record fills, only for rows that exist."""
    marked = record.select(*key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = old.join(marked, list(key), "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_scope(old: DataFrame, new: DataFrame, scope: Sequence[str], swept: DataFrame | None = None) -> DataFrame:
    """Drop every old row of a scope the new run covers, then add the new rows.

    ``swept`` lists scopes that were run and came back empty.
    """
    touched = new.select(*scope).distinct()
    if swept is not None:
        touched = touched.unionByName(swept.select(*scope)).distinct()
    return old.join(touched, list(scope), "left_anti").unionByName(new)


def write_partitions(df: DataFrame, path: str, spec: TableSpec) -> None:
    """Overwrite only the partitions present in ``df``; rows are sorted in file by key
    so row groups can be skipped."""
    parts = list(spec.partitions)
    rest = [k for k in spec.key if k not in parts]
    shaped = df.select(*[c for c in spec.schema.fieldNames() if c in df.columns])
    # the rest of the key spreads one big version over many tasks
    out = shaped.repartition(*[F.col(c) for c in [*parts, *rest]]).sortWithinPartitions(*parts, *rest)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def cascade_bank(tables: Mapping[str, DataFrame], bank_version: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Everything measured against a bank version removed, with the counts removed."""
    doomed = F.col("bank_version") == bank_version
    kept = {n: df.filter(~doomed) for n, df in tables.items()}
    counts = None
    for name, df in sorted(tables.items()):
        one = df.filter(doomed).agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("table_name"), "removed")
        counts = one if counts is None else counts.unionByName(one)
    return kept, counts


def remove_entities(tables: Mapping[str, DataFrame], ids: DataFrame, nullify: Mapping[str, Sequence[str]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete ids from every table and column that names an entity, or clear the
    column where the table says so; counts per table and column."""
    nullify = nullify or {}
    out, counts = {}, None
    gone = ids.select(F.col("film_id").alias("_gone")).distinct()
    for name, df in sorted(tables.items()):
        for col in [c for c in ENTITY_COLUMNS if c in df.columns]:
            hit = df.join(gone, F.col(col) == F.col("_gone"), "left_semi")
            one = hit.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(col).alias("column_name"), "rows")
            counts = one if counts is None else counts.unionByName(one)
            if col in nullify.get(name, ()):
                cols = df.columns
                df = df.join(gone, F.col(col) == F.col("_gone"), "left").withColumn(
                    col, F.when(F.col("_gone").isNull(), F.col(col))).select(*cols)
            else:
                df = df.join(gone, F.col(col) == F.col("_gone"), "left_anti")
        out[name] = df
    return out, counts


def publish_films(current: DataFrame, incoming: DataFrame, user_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(films, held): the incoming corpus, plus films it drops that users still name."""
    refs = user_refs.select("film_id").distinct()
    held = current.join(incoming, "film_id", "left_anti").join(refs, "film_id", "left_semi")
    return incoming.unionByName(held, allowMissingColumns=True), held


def counts_unchanged(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """(table, before, after): fails when a user table's count moved."""
    one = lambda dfs: {n: df.agg(F.count(F.lit(1))).scalar() for n, df in dfs.items()}
    b, a = one(before), one(after)
    out = None
    for name in sorted(before):
        spark = before[name].sparkSession
        row = spark.range(1).select(F.lit(name).alias("table_name"), b[name].alias("before"), a[name].alias("after"))
        out = row if out is None else out.unionByName(row)
    moved = F.raise_error(F.concat(F.lit("user table changed: "), F.col("table_name"))).cast("bigint")
    return out.withColumn("after", F.when(F.col("before") == F.col("after"), F.col("after")).otherwise(moved))


# -- bank review, bundles, ledger -----------------------------------------------------

def review_rows(bank: DataFrame) -> DataFrame:
    """JSON lines for review, widest support first."""
    line = F.to_json(F.struct("item_id", "text", "support", "active", "note"))
    return bank.orderBy(F.desc("support"), "item_id").select(line.alias("value"))


def read_review(lines: DataFrame) -> DataFrame:
    """Reviewed lines back to rows; comments and blanks are skipped."""
    schema = "item_id string, text string, support bigint, active boolean, note string"
    ok = lines.filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    return ok.select(F.from_json("value", schema).alias("r")).select("r.*")


def apply_review(bank: DataFrame, review: DataFrame) -> DataFrame:
    return backfill(bank, review, ["item_id"], ["text", "active", "note"])


def write_bundle(tables: Mapping[str, DataFrame], path: str, runs: DataFrame | None = None) -> DataFrame:
    """JSON lines per table under ``path`` and the manifest (also written)."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    m = manifest(tables, runs)
    m.write.mode("overwrite").json(f"{path}/manifest")
    return m


def manifest(tables: Mapping[str, DataFrame], runs: DataFrame | None = None) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("metric"), F.lit(name).alias("name"), "value")
        out = one if out is None else out.unionByName(one)
    if runs is not None:
        stages = runs.groupBy("stage").agg(F.avg(F.when(F.col("finished_at").isNotNull(), 1.0).otherwise(0.0)).alias("value")).select(
            F.lit("complete_share").alias("metric"), F.col("stage").alias("name"), "value")
        cost = runs.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("value")).select(
            F.lit("cost_usd").alias("metric"), F.lit("all").alias("name"), "value")
        out = out.unionByName(stages).unionByName(cost)
    return out


def run_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars per run: fresh and cached input (a tenth) and output, per million tokens.

    prices: model, in_price, out_price — one row per model.
    """
    fresh = F.col("input_tokens") - F.col("cached_tokens")
    usd = (fresh * F.col("in_price") + F.col("cached_tokens") * F.col("in_price") * 0.1 + F.col("output_tokens") * F.col("out_price")) / 1e6
    return runs.join(prices, "model", "left").withColumn("cost_usd", F.coalesce(usd, F.lit(0.0))).drop("in_price", "out_price")


def seed_sync(films: DataFrame, seeds: DataFrame) -> DataFrame:
    """What a seed sync would do per (title, year): insert, update of the description
    only, or nothing.  A new key whose id is taken by another film fails the job.
    """
    s = seeds.withColumn("new_id", slug(F.col("title"), F.col("year"))).select(
        "title", "year", "new_id", F.col("description").alias("new_description"))
    mine = films.select("title", "year", "film_id", "description", F.lit(True).alias("_have"))
    joined = s.join(mine, (s.title == mine.title) & s.year.eqNullSafe(mine.year), "left").select(
        s.title, s.year, "new_id", "new_description", "film_id", "description", "_have")
    taken = films.select(F.col("film_id").alias("new_id"), F.lit(True).alias("_taken"))
    joined = joined.join(taken, "new_id", "left")
    clash = F.raise_error(F.concat(F.lit("refusing to replace film "), F.col("new_id")))
    action = (
        F.when(F.col("_have").isNull() & F.col("_taken"), clash.cast("string")).when(F.col("_have").isNull(), "inserted")
        .when(~F.col("description").eqNullSafe(F.col("new_description")), "updated").otherwise("unchanged"))
    return joined.select(F.coalesce("film_id", "new_id").alias("film_id"), "title", "year",
                         F.col("new_description").alias("description"), action.alias("action"))


def keep_one_document(documents: DataFrame, new: DataFrame) -> DataFrame:
    """The new key of each name replaces every other key of that name."""
    return replace_scope(documents, new, ["name"])


def drop_orders(orders: DataFrame, moved: DataFrame) -> DataFrame:
    """Forget the materialised order of sessions whose member moved; votes are elsewhere and stay."""
    return orders.join(moved.select("session_id").distinct(), "session_id", "left_anti")


# -- fingerprints -----------------------------------------------------------------------

def fingerprint(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One text that changes when a count of the inputs does: "v7332:p300:d3"."""
    counts = [F.concat(F.lit(tag), df.agg(F.count(F.lit(1))).scalar().cast("string")) for tag, df in parts.items()]
    spark = next(iter(parts.values())).sparkSession
    return spark.range(1).select(F.concat_ws(":", *counts).alias("fingerprint"))


def id_fingerprint(ids: DataFrame, col: str) -> DataFrame:
    """Order-free digest of an id set: count, and the sums of both halves of each id's md5.

    Sums combine across the cluster, so the ids are never gathered in one place.
    """
    h = F.md5(F.col(col).cast("string"))
    half = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)")
    return ids.select(col).distinct().agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.sum(half(1)), F.sum(half(13))), 256).alias("fingerprint"))


def load_fresh(artifact: DataFrame, current: DataFrame) -> DataFrame:
    """The stored result while its inputs are unchanged, else no rows."""
    return artifact.join(F.broadcast(current), "fingerprint", "left_semi")  # one row
