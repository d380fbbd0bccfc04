"""What several operators of this package share: reading documents, orders, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.session import cut_lineage, discard, free_shuffles, scratch  # noqa: F401


_CACHES: dict[str, Callable[[], None]] = {}
_LAST: list[str | None] = [None]


def register_cache(owner: str, clear: Callable[[], None]) -> None:
    """Name a cache that a worker process keeps between tasks."""
    _CACHES[owner] = clear


def keep_only(owner: str | None = None) -> None:
    """Empty the caches of all but ``owner``: workers live on from step to step, and what
    one step has learned must not narrow the memory of the next. Where the owner changes,
    what Arrow and the allocator hold unused goes back to the system too."""
    for name, clear in _CACHES.items():
        if name != owner:
            clear()
    if owner != _LAST[0]:
        _LAST[0] = owner
        give_back()


def give_back() -> None:
    """Returns this process's unused memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``(doc_id long, text string)`` and ``more``, a missing text as the empty one.

    Only these two columns are read on, so further columns of any name do no harm.
    Repeated rows stay repeated.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session: the cluster's own measure of its width."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending cut points that deal ``doc_id`` out evenly.

    They come from a summary of the id column alone; whatever they are, every row falls
    into exactly one range, so they affect balance only.
    """
    if parts < 2:
        return []
    row = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()
    return sorted(set(row["q"] or []))


def with_id_range(docs: DataFrame, bounds: list[int], to: str) -> DataFrame:
    """Adds the number of each row's range, found by binary search: 0 for null and for ids
    below the first bound."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return docs.withColumn(to, F.lit(0))
    splits = [-float("inf"), *sorted({float(b) for b in bounds}), float("inf")]
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf")))
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol=to)
    return cut.transform(docs.withColumn("_key", key)).withColumn(to, F.col(to).cast("int")).drop("_key")


def batches_by_size(batches: Iterator, column: str, limit: int = 1 << 20) -> Iterator:
    """Slices of Arrow batches of about ``limit`` bytes in ``column``; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While it lasts, what runs sends Python batches of about ``size``: rows of some MB
    each would otherwise gather to 64 MB on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable over ``links(a, b)``: rows ``(node, component)``, all ends included.

    Every round gives a node the smallest of its neighbours' labels and of the label of its
    own label, all as of the round before; where that was smaller than the node's label, the
    old label gets it too in the next round, so whole trees are hooked at once (a chain of
    500,000 shuffled ids takes 37 rounds). Rounds go on until no label changes. Labels and
    links stay in tables; only whether a label changed comes back. Null ends are left out.
    """
    edges = links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct()
    both = cut_lineage(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    label = cut_lineage(least.select("node", F.least("node", "b").alias("component")))
    hooks, last = None, None
    while True:
        of = label.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(of, "b").select(F.col("a").alias("node"), "c")
        far = label.join(of, label["component"] == of["b"]).select("node", "c")
        found = near.union(far) if hooks is None else near.union(far).union(hooks)
        least = found.groupBy("node").agg(F.min("c").alias("c"))
        step = cut_lineage(
            label.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        )
        if last:
            discard(edges.sparkSession, [last])
        last = scratch()[-1]
        label = step.select("node", "component")
        changed = step.filter("component < was")
        if changed.isEmpty():
            return label
        hooks = changed.select(F.col("was").alias("node"), F.col("component").alias("c"))
