"""From verdict rows to the long response table.

A missing row means "took no position"; nothing here ever fills one in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.session import cut_lineage

MAX_STRENGTH = 2.0
MIN_FILMS_PER_ITEM = 3
MIN_DISAGREEMENT = 0.05
# |v - mean| below this counts as exactly zero: summation order must not decide
# whether a cell is engaged.
ZERO = 1e-12


def cell_means(verdicts: DataFrame, *keys: str) -> DataFrame:
    """One value per (keys): the mean over variants and runs."""
    return verdicts.groupBy(*keys).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_rows")
    )


def item_support(cells: DataFrame, *keys: str, item: str = "item_id") -> DataFrame:
    """Films per item and the share of them on the affirming side."""
    return cells.groupBy(*keys, item).agg(
        F.count(F.lit(1)).alias("n_films"),
        F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("share_positive"),
    )


def _contested(min_films: int, min_disagreement: float) -> Column:
    share = F.col("share_positive")
    return (F.col("n_films") >= min_films) & (
        F.least(share, F.lit(1.0) - share) >= min_disagreement
    )


def contested_items(
    cells: DataFrame, *keys: str, min_films: int = MIN_FILMS_PER_ITEM,
    min_disagreement: float = MIN_DISAGREEMENT,
) -> DataFrame:
    """Items answered by enough films, with films on both sides."""
    support = item_support(cells, *keys)
    if min_disagreement <= 0:
        return support.filter(F.col("n_films") >= min_films)
    return support.filter(_contested(min_films, min_disagreement))


def contested_counters(
    cells: DataFrame, *keys: str, min_films: int = MIN_FILMS_PER_ITEM,
    min_disagreement: float = MIN_DISAGREEMENT,
) -> DataFrame:
    """How many items stay, how many are dropped, and how many of those were unanimous."""
    keep = _contested(min_films, min_disagreement)
    return item_support(cells, *keys).groupBy(*keys).agg(
        F.count_if(keep).alias("kept_items"),
        F.count_if(~keep).alias("dropped_items"),
        F.count_if((F.col("n_films") >= min_films) & ~keep).alias("unanimous_items"),
    )


def response_cells(
    verdicts: DataFrame, *keys: str, min_films: int = MIN_FILMS_PER_ITEM,
    min_disagreement: float = MIN_DISAGREEMENT,
) -> DataFrame:
    """The response matrix as a long table, value scaled to [-1, 1].

    Cells that average to exactly zero stay as rows here; they are silent for
    every estimator, which tests the value against ``ZERO``.
    """
    # the means are far fewer than the verdicts and are needed twice here and again by
    # every estimator, so the verdicts are read once
    cells = cut_lineage(cell_means(verdicts, *keys, "film_id", "item_id"))
    kept = contested_items(cells, *keys, min_films=min_films, min_disagreement=min_disagreement)
    return cells.join(kept.select(*keys, "item_id"), [*keys, "item_id"], "left_semi").select(
        *keys, "film_id", "item_id", (F.col("value") / MAX_STRENGTH).alias("value")
    )


def film_counts(verdicts: DataFrame, *keys: str) -> DataFrame:
    """All films of each reading, those without a contested cell too."""
    return verdicts.groupBy(*keys).agg(F.count_distinct("film_id").alias("n_films"))


def matrix_shape(cells: DataFrame, *keys: str, films: DataFrame | None = None) -> DataFrame:
    """Films, items, engaged cells and density of each reading.

    ``films``: rows of ``film_counts``. A film without any contested cell is an empty row of
    the matrix; without ``films`` only those with a cell are counted.
    """
    engaged = F.count_if(F.abs(F.col("value")) > ZERO)
    shape = cells.groupBy(*keys).agg(
        F.count_distinct("film_id").alias("n_films"),
        F.count_distinct("item_id").alias("n_items"),
        engaged.alias("n_engaged"),
    )
    if films is not None:
        kept = shape.drop("n_films")
        shape = (kept.join(films, list(keys)) if keys else kept.crossJoin(films)).select(*keys, "n_films", "n_items", "n_engaged")
    return shape.withColumn("density", F.col("n_engaged") / (F.col("n_films") * F.col("n_items")))


LEAST_ITEMS, LEAST_FILMS = 2, 3


def require_matrix(cells: DataFrame, *keys: str, min_items: int = LEAST_ITEMS, min_films: int = LEAST_FILMS) -> DataFrame:
    """Fail the job when a reading is too small to factor."""
    shape = matrix_shape(cells, *keys)
    small = (F.col("n_items") < min_items) | (F.col("n_films") < min_films)
    return shape.withColumn(
        "n_items", F.when(small, F.raise_error(F.lit("too little to factor"))).otherwise(F.col("n_items"))
    )


def centre(
    cells: DataFrame, *keys: str, entity: str = "film_id", value: str = "value",
    drop_zero: bool = True,
) -> DataFrame:
    """Subtract each entity's own mean over its engaged cells.

    Aggregate and join back rather than a window: the mean combines map-side and
    AQE can split the join of an entity holding much of the table.  With
    ``drop_zero`` a cell that centres to zero becomes silent.
    """
    engaged = cells.filter(F.abs(F.col(value)) > ZERO) if drop_zero else cells
    means = engaged.groupBy(*keys, entity).agg(F.avg(value).alias("_mean"))
    out = engaged.join(means, [*keys, entity]).withColumn("centred", F.col(value) - F.col("_mean"))
    out = out.drop("_mean")
    return out.filter(F.abs(F.col("centred")) > ZERO) if drop_zero else out
