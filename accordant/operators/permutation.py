"""Label-permutation tests: shuffle which item sits on which axis, sizes held fixed.

Items are numbered in the order of their axes, so the observed labels are runs of equal
axes and a handful of sizes tells every label.  A replicate hands item ``x`` the label at
the image of ``x`` under its own keyed bijection, which any task can evaluate: no replicate
is shuffled, gathered or sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.hashing import ordered_numbers
from accordant.operators import pairs as P
from accordant.session import cut_lineage


ROUNDS = 8
_LOW = (1 << 32) - 1
_STEP, _FACTOR, _REP = 0x9E3779B9, 0x45D9F3B, 0x27D4EB2F


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser; products stay under 2**59, so any engine's 64-bit integers do."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * _FACTOR) & _LOW
    return x ^ (x >> 16)


def image(items: np.ndarray, rep: int, n: int, seed: int) -> np.ndarray:
    """Where a replicate's bijection of 0..n-1 (n up to 2**32) puts each item.

    A Feistel network over the next even power of two, walked until the image
    falls inside the range.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    key = int(_mix(np.int64((seed * _STEP + (rep + 1) * _REP) & _LOW)))
    out = np.array(items, np.int64)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> half, out[live] & mask
        for step in range(ROUNDS):
            left, right = right, left ^ (_mix((right + key + step * _STEP) & _LOW) & mask)
        out[live] = left << half | right
        live = live[out[live] >= n]
    return out


def numbered_labels(assignments: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(item_id, dim_id, _idx) numbered by axis and item, and where each axis ends."""
    rows = assignments.select("item_id", "dim_id").distinct().withColumn("_o", F.struct("dim_id", "item_id"))
    index = cut_lineage(ordered_numbers(rows, "_o", "_idx").drop("_o"))
    sizes = index.groupBy("dim_id").count().orderBy("dim_id").collect()  # one row per axis
    return index, np.cumsum([r["count"] for r in sizes])


def labels_of(items: np.ndarray, rep: int, ends: np.ndarray, seed: int) -> np.ndarray:
    """Axis numbers of ``items`` under a replicate; -1 is the observed labelling."""
    at = image(items, rep, int(ends[-1]), seed) if rep >= 0 else items
    return np.searchsorted(ends, at, side="right")


def null_summary(stats: DataFrame) -> DataFrame:
    """Observed, null mean, population sd, z and how many replicates reach it.

    stats: rep (-1 observed), stat.
    """
    obs = stats.filter(F.col("rep") < 0).agg(F.first("stat")).scalar()
    null = stats.filter(F.col("rep") >= 0).agg(
        F.avg("stat").alias("null_mean"), F.stddev_pop("stat").alias("null_sd"),
        F.count(F.lit(1)).alias("permutations"),
        F.count_if(F.col("stat") >= obs - 1e-12).alias("n_at_least_observed"), F.first(obs).alias("observed"))
    z = F.when(F.col("null_sd") > 1e-12, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return null.withColumn("z", z)


def co_engagement_test(cells: DataFrame, assignments: DataFrame, n: int = 1000, seed: int = 3) -> DataFrame:
    """Is more of the co-engagement inside axes than chance gives?

    Packets are reduced to co-engagement counts, strip by strip of a tile; where a strip is
    whole, all replicates compare their labels over it and it gives one sum a replicate.
    """
    index, ends = numbered_labels(assignments)
    packets = cells.join(index.select("item_id"), "item_id").withColumn(
        "packet", F.struct("film_id", "variant")).withColumn("one", F.lit(1.0))
    packed = P.pack_rows(packets, index.select("item_id", "_idx"), (), "packet", "item_id", "one").select("idx", "val")
    items = int(ends[-1]) if len(ends) else 0

    def finish(sums: np.ndarray, first_i: int, first_j: int) -> dict[str, np.ndarray]:
        count = sums[0]
        rows, columns = np.flatnonzero(count.any(axis=1)), np.flatnonzero(count.any(axis=0))
        count = count[np.ix_(rows, columns)]
        inside = np.zeros(n + 1)
        for rep in range(-1, n):
            same = labels_of(rows + first_i, rep, ends, seed)[:, None] == labels_of(columns + first_j, rep, ends, seed)
            inside[rep + 1] = count[same].sum()
        return {"rep": np.arange(-1, n, dtype=np.int32), "inside": inside, "all": np.full(n + 1, count.sum())}

    parts = P.strip_sums(packed, (), ("n",), finish, "rep int, inside double, all double", items, min(P.TILE, max(items, 1)))
    stat = parts.groupBy("rep").agg((F.sum("inside") / F.sum("all")).alias("stat"))
    return null_summary(cut_lineage(stat))


def coherence_test(
    cells: DataFrame, assignments: DataFrame, n: int = 1000, seed: int = 4, min_items: int = 3
) -> DataFrame:
    """Is the net stance inside axes stronger than chance gives?

    Every task scores its own packets under all replicates and hands back one
    partial sum per replicate; packets are never repeated per replicate.
    """
    index, ends = numbered_labels(assignments)
    signed = cells.join(assignments.select("item_id", "polarity"), "item_id").withColumn(
        "signed", F.col("polarity") * F.col("value"))
    packed = P.pack_rows(signed, index.select("item_id", "_idx"), ["variant"], "film_id", "item_id", "signed").select("idx", "val")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(ends)
        total, count = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
        for batch in batches:
            lens = np.diff(batch.column("idx").offsets.to_numpy())
            known, idx = np.unique(batch.column("idx").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            val = batch.column("val").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lens) * k
            for rep in range(-1, n):
                slot = row + labels_of(known, rep, ends, seed)[idx]
                c = np.bincount(slot, minlength=batch.num_rows * k)
                s = np.bincount(slot, weights=val, minlength=batch.num_rows * k)
                big = c >= min_items
                total[rep + 1] += (np.abs(s[big]) / c[big]).sum()
                count[rep + 1] += int(big.sum())
        yield pa.RecordBatch.from_pydict({"rep": pa.array(range(-1, n), pa.int32()), "t": total, "c": count})

    stat = packed.mapInArrow(partial, "rep int, t double, c bigint").groupBy("rep").agg(
        F.when(F.sum("c") > 0, F.sum("t") / F.sum("c")).otherwise(0.0).alias("stat"))
    return null_summary(cut_lineage(stat))


def fit_coverage(assignments: DataFrame, floor: float = 0.4) -> DataFrame:
    """Items, median fit and the share of items fitting well."""
    return assignments.agg(
        F.count(F.lit(1)).alias("n_items"), F.percentile("fit", 0.5).alias("median_fit"),
        F.avg(F.when(F.col("fit") >= floor, 1.0).otherwise(0.0)).alias("share_fit"))


def axis_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("dim_id").agg(F.count(F.lit(1)).alias("n_items"))


def validation_battery(
    cells: DataFrame, passes: DataFrame, lineage: DataFrame, n: int = 1000, seed: int = 3
) -> DataFrame:
    """Coverage, agreement between passes, unmapped items and both permutation
    tests without a film judging its own items, as (section, key, value) rows."""
    from accordant.operators.agreement import cohens_kappa, own_source_excluded

    main = passes.filter(F.col("pass_name") == "main").select("item_id", "dim_id", "polarity", "fit")
    other = passes.filter(F.col("pass_name") != "main").select("item_id", "pass_name", F.col("dim_id").alias("b"), F.col("polarity").alias("pb"))
    shared = main.join(other, "item_id").withColumn("a", F.col("dim_id"))
    clean = cut_lineage(own_source_excluded(cells, lineage))

    def long(df: DataFrame, section: str, key, *values: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("v")) for v in values])
        label = key if isinstance(key, str) else key
        return df.select(F.lit(section).alias("section"), label.alias("key"), F.explode(pairs).alias("p")).select(
            "section", "key", F.col("p.m").alias("metric"), F.col("p.v").alias("value"))

    unmapped = main.join(lineage.select("item_id").distinct(), "item_id", "left_anti").agg(
        F.count(F.lit(1)).alias("unmapped_items"))
    tests = ("observed", "null_mean", "null_sd", "z", "n_at_least_observed")
    parts = [
        long(fit_coverage(main), "coverage", F.lit("all"), "n_items", "median_fit", "share_fit"),
        long(axis_sizes(main), "sizes", F.col("dim_id").cast("string"), "n_items"),
        long(cohens_kappa(shared, ["pass_name"]), "agreement", F.col("pass_name"), "n", "raw", "chance", "kappa"),
        long(shared.groupBy("pass_name").agg(F.avg(F.when(F.col("pb") == F.col("polarity"), 1.0).otherwise(0.0)).alias("polarity_agreement")),
             "agreement", F.col("pass_name"), "polarity_agreement"),
        long(unmapped, "lineage", F.lit("all"), "unmapped_items"),
        long(co_engagement_test(clean, main, n, seed), "co_engagement", F.lit("all"), *tests),
        long(coherence_test(clean, main, n, seed + 1), "coherence", F.lit("all"), *tests),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
