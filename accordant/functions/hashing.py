"""Deterministic hash ordering.

Shuffles and samples are ordered by ``md5(seed|key...)`` so the same rows are
chosen under any partitioning, and another SQL engine computes the same digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_hex(seed: str, *cols: str | Column) -> Column:
    """32 hex digits of md5 over the seed and the key columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def hash_uniform(seed: str, *cols: str | Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of the digest."""
    head = F.substring(hash_hex(seed, *cols), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**52))


def distributed_rank(
    df: DataFrame, group: Sequence[str], hex_col: str, out: str = "rank", digits: int = 3
) -> DataFrame:
    """Exact 1-based rank of each row in its group by a hex digest, without one
    task sorting a whole group.

    Rows split on (group, leading digits); the rank is the number of rows in the
    earlier buckets plus the position inside the bucket.  Digests are uniform, so
    a group holding a third of the table still spreads over ``16**digits`` tasks.
    Ties share a digest only when the keys are equal.
    """
    group = list(group)
    bucketed = df.withColumn("_bucket", F.substring(hex_col, 1, digits))
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(g).alias(f"_k_{g}") for g in group],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(hex_col)
    ranked = bucketed.withColumn("_in_bucket", F.row_number().over(inside))
    cond = F.col("_bucket") == F.col("_b")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    return (
        ranked.join(offsets, cond)
        .withColumn(out, (F.col("_offset") + F.col("_in_bucket")).cast("bigint"))
        .drop("_bucket", "_b", "_offset", "_in_bucket", *[f"_k_{g}" for g in group])
    )


def ordered_numbers(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with a 0-based number in the order of ``col``, whose values are distinct.

    Ranges of values are sorted apart and written; a range's first number is the count of
    the rows in the ranges before it (one row per range).
    """
    from accordant.session import cut_lineage

    ranged = df.repartitionByRange(F.col(col)).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(col))))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(before, "_part").withColumn(out, (F.col("_before") + F.col("_in") - 1).cast("int")).drop("_part", "_in", "_before")


def hash_sample(df: DataFrame, keys: Sequence[str], seed: str, k: int) -> DataFrame:
    """Uniform sample of k rows without replacement, in hash order."""
    return df.orderBy(hash_hex(seed, *keys), *keys).limit(k)


def hash_halves(keys: DataFrame, key: str, seed: str, side: str = "half") -> DataFrame:
    """Split a key set in two equal halves: the first n//2 by hash order are 'a'."""
    ranked = distributed_rank(keys.withColumn("_h", hash_hex(seed, key)), [], "_h", "_rank")
    n = keys.agg(F.count(F.lit(1)).alias("_total"))
    return ranked.withColumn(
        side, F.when(F.col("_rank") <= F.floor(n.scalar() / 2), "a").otherwise("b")
    ).drop("_h", "_rank")
