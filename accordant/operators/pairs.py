"""Item-by-item moments over shared entities.

Entities are packed into sparse rows, which are cut into tiles of item blocks; each
task multiplies its own rows into partial sums of one tile at a time and Spark adds the
partials.  Pairs are never emitted per entity, so a heavy entity costs one sparse row per
tile, and a task holds one tile whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.hashing import ordered_numbers
from accordant.operators.cells import ZERO
from accordant.session import cut_lineage

TILE = 1024
MIN_PAIR_OVERLAP = 8
STRIP = 64
_ROW_BLOCK = 2048
_EMIT = 200_000
_STATS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: the stat of the other side of a pair
_SWAPPED = {"n": "n", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx", "sxy": "sxy"}


def item_index(cells: DataFrame, item: str = "item_id") -> DataFrame:
    """Dense 0-based item numbers in item order."""
    # one row per item, joined several times by every caller
    return cut_lineage(ordered_numbers(cells.select(item).filter(F.col(item).isNotNull()).distinct(), item, "_idx"))


def pack_rows(
    cells: DataFrame, index: DataFrame, keys: Sequence[str], entity: str, item: str, value: str
) -> DataFrame:
    """One sparse row per entity: parallel arrays of item number and value.

    A row holds at most one cell per item.
    """
    packed = (
        cells.join(index, item)
        .groupBy(*keys, entity)
        .agg(F.collect_list(F.struct(F.col("_idx").alias("i"), F.col(value).cast("double").alias("v"))).alias("_c"))
    )
    return packed.select(
        *keys, entity, F.col("_c.i").alias("idx"), F.col("_c.v").alias("val")
    )


def _block_sums(rows: np.ndarray, idx: np.ndarray, val: np.ndarray, n_rows: int, p: int):
    """Six p x p sums of one block of sparse rows."""
    x = np.zeros((n_rows, p))
    e = np.zeros((n_rows, p))
    x[rows, idx] = val
    e[rows, idx] = 1.0
    xx = x * x
    sx = x.T @ e
    sxx = xx.T @ e
    return np.stack([e.T @ e, sx, sx.T, sxx, sxx.T, x.T @ x])


def _tile_sums(n_rows: int, left: tuple, right: tuple | None, wide: int, stats: Sequence[str]) -> np.ndarray:
    """``stats`` of one block of rows over one tile; sides are (rows, item in block, value),
    ``right`` is None on the diagonal."""
    dense = []
    for rows, idx, val in (left, right or left)[: 1 if right is None else 2]:
        x, e = np.zeros((n_rows, wide)), np.zeros((n_rows, wide))
        x[rows, idx] = val
        e[rows, idx] = 1.0
        dense.append((x, e))
    (xi, ei), (xj, ej) = dense[0], dense[-1]
    made: dict[str, np.ndarray] = {}
    for name in stats:
        if right is None and name in ("sy", "syy") and (twin := name.replace("y", "x")) in made:
            made[name] = made[twin].T
            continue
        pick = {"n": (ei, ej), "sx": (xi, ej), "sy": (ei, xj), "sxx": (xi, ej), "syy": (ei, xj), "sxy": (xi, xj)}[name]
        one, two = (pick[0] ** 2 if name == "sxx" else pick[0]), (pick[1] ** 2 if name == "syy" else pick[1])
        made[name] = one.T @ two
    return np.stack([made[name] for name in stats])


def _runs(batch: pa.RecordBatch, by: Sequence[str]) -> list[int]:
    """Where runs of equal ``by`` begin, and the end."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in by:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(new).tolist(), batch.num_rows]


def _tiled(packed: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """A row per entity and pair of item blocks it has cells in: (keys, _bi, _bj, li, lv, ri, rv)."""
    cut = packed.select(*keys, "idx", "val", F.expr(
        f"array_sort(array_distinct(transform(idx, x -> cast(x div {tile} as int))))").alias("_blocks"))
    pairs = "flatten(transform(_blocks, a -> transform(filter(_blocks, b -> b >= a), b -> struct(a as bi, b as bj))))"
    cut = cut.select(*keys, F.arrays_zip("idx", "val").alias("_cells"), F.expr(f"explode({pairs})").alias("_t"))
    side = lambda b: F.expr(f"filter(_cells, c -> c.idx div {tile} = _t.{b})")
    cut = cut.select(*keys, F.col("_t.bi").alias("_bi"), F.col("_t.bj").alias("_bj"), side("bi").alias("_l"), side("bj").alias("_r"))
    return cut.select(*keys, "_bi", "_bj", F.col("_l.idx").alias("li"), F.col("_l.val").alias("lv"), F.col("_r.idx").alias("ri"), F.col("_r.val").alias("rv"))


def _partials(packed: DataFrame, keys: Sequence[str], tile: int, stats: Sequence[str], items: int | None, both: bool) -> DataFrame:
    """Sums of each task's rows: (keys, _bi, _bj, _strip, at, sums), a row per strip of a tile.

    A strip is ``STRIP`` items by one block; ``at`` lists its live places (int32) and
    ``sums`` their values, one stat after the other.  Places are i < j, or with ``both``
    every i and j, so that all pairs of an item stand in the strips of its own block.
    Up to ``tile`` items there is one tile, and rows are read as they are.
    """
    single = items is not None and items <= tile
    by = [*keys, *([] if single else ["_bi", "_bj"])]

    def side(batch: pa.RecordBatch, i: str, v: str):
        column = batch.column(i)
        lengths = np.diff(column.offsets.to_numpy())
        idx = column.flatten().to_numpy(zero_copy_only=False) % tile
        return lengths, np.concatenate([[0], np.cumsum(lengths)]), idx, batch.column(v).flatten().to_numpy(zero_copy_only=False)

    def emit(key_values: tuple, types: list, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        key_values, (bi, bj) = (key_values, (0, 0)) if single else (key_values[:-2], key_values[-2:])
        views = [(bi, bj, sums)]
        if both and bi != bj:
            views.append((bj, bi, sums[[stats.index(_SWAPPED[k]) for k in stats]].transpose(0, 2, 1)))
        for one, two, held in views:
            found: list[list] = [[], [], []]
            for strip in range(0, tile, STRIP):
                part = held[:, strip : strip + STRIP]
                if not part.size or not part[0].any():
                    continue
                live = part[0] > 0
                rows = np.arange(strip, strip + live.shape[0])[:, None]
                if one == two:
                    live &= (rows != np.arange(live.shape[1])) if both else (rows < np.arange(live.shape[1]))
                i, j = np.nonzero(live)
                if len(i):
                    found[0].append(strip // STRIP)
                    found[1].append((i * tile + j).astype(np.int32).tobytes())
                    found[2].append(np.ascontiguousarray(part[:, i, j]).tobytes())
            n = len(found[0])
            if n:
                cols = {k: pa.array([v] * n, type=t) for k, v, t in zip(keys, key_values, types)}
                cols |= {"_bi": pa.array([one] * n, pa.int32()), "_bj": pa.array([two] * n, pa.int32())}
                cols |= {"_strip": pa.array(found[0], pa.int32()), "at": pa.array(found[1], pa.binary()), "sums": pa.array(found[2], pa.binary())}
                yield pa.RecordBatch.from_pydict(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc, types = None, None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.column(k).type for k in keys]
            sides = [side(batch, "idx", "val")] if single else [side(batch, "li", "lv"), side(batch, "ri", "rv")]
            cuts = _runs(batch, by)
            # rows arrive sorted by key and tile: one accumulator at a time
            for lo, hi in zip(cuts, cuts[1:]):
                value = tuple(batch.column(k)[lo].as_py() for k in by)
                if acc is not None and value != current:
                    yield from emit(current, types, acc)
                    acc = None
                current = value
                diagonal = single or value[-1] == value[-2]
                for at in range(lo, hi, _ROW_BLOCK):
                    end = min(at + _ROW_BLOCK, hi)
                    parts = [
                        (np.repeat(np.arange(end - at), n[at:end]), idx[s[at] : s[end]], val[s[at] : s[end]]) for n, s, idx, val in sides
                    ]
                    wide = max(int(x[1].max(initial=0)) for x in parts) + 1
                    if acc is None or acc.shape[1] < wide:
                        grown = np.zeros((len(stats), wide, wide))
                        if acc is not None:
                            grown[:, : acc.shape[1], : acc.shape[1]] = acc
                        acc = grown
                    acc[:, :wide, :wide] += _tile_sums(end - at, parts[0], None if diagonal else parts[1], wide, stats)
        if acc is not None:
            yield from emit(current, types, acc)

    rows = packed.select(*keys, "idx", "val") if single else _tiled(packed, keys, tile)
    ddl = _key_ddl(packed, keys) + "_bi int, _bj int, _strip int, at binary, sums binary"
    return (rows.sortWithinPartitions(*by) if by else rows).mapInArrow(partial, ddl)


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _summed(partials: DataFrame, keys: Sequence[str], tile: int, stats: Sequence[str], finish: Callable, ddl: str) -> DataFrame:
    """Adds the tasks' strips and hands each whole strip to ``finish(sums, i, j)``: sums by
    stat, item and other item, and the numbers of the first of both; it returns columns of
    ``ddl``."""
    by = [*keys, "_bi", "_bj", "_strip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, acc, types = None, np.zeros((len(stats), STRIP * tile)), []

        def out(value: tuple) -> Iterator[pa.RecordBatch]:
            *key_values, bi, bj, strip = value
            columns = finish(acc.reshape(len(stats), STRIP, tile), bi * tile + strip * STRIP, bj * tile)
            size = len(next(iter(columns.values())))
            for lo in range(0, size, _EMIT):
                m = slice(lo, lo + _EMIT)
                cols = {k: pa.array([v] * len(range(*m.indices(size))), type=t) for k, v, t in zip(keys, key_values, types)}
                yield pa.RecordBatch.from_pydict(cols | {k: pa.array(v[m]) for k, v in columns.items()})

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for value, at, sums in zip(
                zip(*[batch.column(k).to_pylist() for k in by]), batch.column("at").to_pylist(), batch.column("sums").to_pylist()
            ):
                if value != current:
                    if current is not None:
                        yield from out(current)
                        acc[:] = 0.0
                    current = value
                acc[:, np.frombuffer(at, np.int32)] += np.frombuffer(sums).reshape(len(stats), -1)
        if current is not None:
            yield from out(current)

    return partials.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _key_ddl(partials, keys) + ddl)


def pair_sums(
    cells: DataFrame, keys: Sequence[str] = (), entity: str = "film_id", item: str = "item_id",
    value: str = "value", named: bool = True, stats: Sequence[str] = _STATS,
) -> DataFrame:
    """n, sums, squared sums and cross sums (or those in ``stats``) per (keys, item_i <
    item_j) over the entities holding both items."""
    keys = list(keys)
    index = item_index(cells, item)
    sums = packed_sums(pack_rows(cells, index, keys, entity, item, value), keys, stats=stats, items=index.count())
    return name_pairs(sums, index, item) if named else sums


def packed_sums(
    packed: DataFrame, keys: Sequence[str], tile: int = TILE, stats: Sequence[str] = _STATS, items: int | None = None,
) -> DataFrame:
    """``stats`` (``n`` first) per (keys, i < j) from packed rows; ``items``: how many there
    are, if known."""
    keys, stats = list(keys), list(stats)
    tile = min(tile, max(items, 1)) if items else tile

    def finish(acc: np.ndarray, first_i: int, first_j: int) -> dict[str, np.ndarray]:
        i, j = np.nonzero(acc[0] > 0)
        places = {"i": (i + first_i).astype(np.int32), "j": (j + first_j).astype(np.int32)}
        return places | {name: acc[k, i, j] for k, name in enumerate(stats)}

    return strip_sums(packed, keys, stats, finish, "i int, j int, " + ", ".join(f"{x} double" for x in stats), items, tile)


def strip_sums(
    packed: DataFrame, keys: Sequence[str], stats: Sequence[str], finish: Callable, ddl: str, items: int | None = None, tile: int = TILE,
) -> DataFrame:
    """Rows that ``finish`` makes of every whole strip of pairs i < j; see ``_summed``."""
    keys, stats = list(keys), list(stats)
    return _summed(_partials(packed, keys, tile, stats, items, both=False), keys, tile, stats, finish, ddl)


def name_pairs(sums: DataFrame, index: DataFrame, item: str = "item_id") -> DataFrame:
    """Replace item numbers by item ids."""
    a = index.select(F.col("_idx").alias("i"), F.col(item).alias("item_i"))
    b = index.select(F.col("_idx").alias("j"), F.col(item).alias("item_j"))
    return (
        sums.join(a, "i").join(b, "j").drop("i", "j")
        .withColumn("n", F.col("n").cast("bigint"))
    )


def with_correlation(sums: DataFrame, min_overlap: int = MIN_PAIR_OVERLAP) -> DataFrame:
    """Pairwise-complete correlation: 0 under ``min_overlap`` shared entities or
    without variance, clipped to [-1, 1]."""
    n = F.col("n").cast("double")
    mx, my = F.col("sx") / n, F.col("sy") / n
    vx, vy = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my
    cov = F.col("sxy") / n - mx * my
    ok = (F.col("n") >= min_overlap) & (vx > ZERO) & (vy > ZERO)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))
    return sums.withColumn("r", F.when(ok, r).otherwise(0.0))


def pairwise_correlation(
    cells: DataFrame, keys: Sequence[str] = (), entity: str = "film_id", item: str = "item_id",
    value: str = "centred", min_overlap: int = MIN_PAIR_OVERLAP,
) -> DataFrame:
    """(keys, item_i, item_j, n, r) for every pair some entity engaged both of."""
    sums = pair_sums(cells, keys, entity, item, value)
    return with_correlation(sums, min_overlap).select(*keys, "item_i", "item_j", "n", "r")


def zeroed_share(corr: DataFrame, n_items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of all item pairs whose correlation is zero; absent pairs are zero."""
    keys = list(keys)
    live = corr.groupBy(*keys).agg(F.count_if(F.col("r") != 0).alias("live_pairs"))
    p = F.col("n_items").cast("double")
    share = F.lit(1.0) - F.col("live_pairs") / (p * (p - 1) / 2)
    joined = n_items.join(live, keys, "left") if keys else n_items.withColumn("_o", F.lit(1)).join(
        live.withColumn("_o", F.lit(1)), "_o"
    ).drop("_o")
    return joined.select(
        *keys, "n_items", F.coalesce("live_pairs", F.lit(0)).alias("live_pairs"),
        F.when(F.col("n_items") < 2, 1.0).otherwise(
            F.coalesce(share, F.lit(1.0))
        ).alias("zeroed_share"),
    )


def cosine_similarity(
    centred: DataFrame, entity: str = "user_id", item: str = "item_id", value: str = "centred",
    min_support: int = 50,
) -> DataFrame:
    """Cosine of centred item columns over all entities, kept where at least
    ``min_support`` entities hold both items."""
    sums = pair_sums(centred, (), entity, item, value, stats=("n", "sxy")).filter(F.col("n") >= min_support)
    norms = centred.groupBy(item).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    a = norms.select(F.col(item).alias("item_i"), F.col("norm").alias("norm_i"))
    b = norms.select(F.col(item).alias("item_j"), F.col("norm").alias("norm_j"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return (
        sums.join(a, "item_i").join(b, "item_j")
        .select("item_i", "item_j", F.col("n").alias("support"),
                (F.col("sxy") / (one("norm_i") * one("norm_j"))).alias("similarity"))
    )


def implicit_zero_correlation(
    centred: DataFrame, entity: str = "user_id", item: str = "item_id", value: str = "centred",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Correlation of item columns with absent cells read as zero, for every item pair.

    Only the present cells are summed; the divisor is the number of entities.
    """
    keys = list(keys)
    index = item_index(centred, item)
    sums = pair_sums(centred, keys, entity, item, value, named=False, stats=("n", "sxy"))
    total = centred.groupBy(*keys).agg(F.count_distinct(entity).alias("n_users"))
    p = index.agg(F.count(F.lit(1))).scalar().cast("int")
    # the pair grid grows from the numbered items, one row each: no join
    grid = total.select(*keys, "n_users", F.explode(F.sequence(F.lit(0), p - 2)).alias("i")).select(
        *keys, "n_users", "i", F.explode(F.sequence(F.col("i") + 1, p - 1)).alias("j")
    )
    x = F.col(value)
    col = centred.join(index, item).groupBy(*keys, "_idx").agg(
        F.sum(x).alias("s"), F.sum(x * x).alias("ss")
    )
    side = lambda c: col.select(
        *keys, F.col("_idx").alias(c), F.col("s").alias(f"s_{c}"), F.col("ss").alias(f"ss_{c}")
    )
    full = (
        grid.join(side("i"), [*keys, "i"], "left")
        .join(side("j"), [*keys, "j"], "left")
        .join(sums.select(*keys, "i", "j", "n", "sxy"), [*keys, "i", "j"], "left")
    )
    n = F.col("n_users")
    mean = lambda c: F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) / n
    sd = lambda c: F.sqrt(F.greatest(F.coalesce(F.col(f"ss_{c}"), F.lit(0.0)) / n - mean(c) * mean(c), F.lit(1e-12)))
    cov = F.coalesce("sxy", F.lit(0.0)) / n - mean("i") * mean("j")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / (sd("i") * sd("j"))))
    named = full.select(*keys, "i", "j", F.coalesce("n", F.lit(0.0)).alias("n"), r.alias("r"))
    return name_pairs(named, index, item).withColumnRenamed("n", "support").select(
        *keys, "item_i", "item_j", "support", "r"
    )


def support_statistics(
    centred: DataFrame, entity: str = "user_id", item: str = "item_id", value: str = "centred",
    min_support: int = 50,
) -> DataFrame:
    """Median shared raters over all item pairs, absent pairs counting as zero,
    and the share of pairs under the floor."""
    pairs = pair_sums(centred, (), entity, item, value, stats=("n",)).select(F.col("n").alias("support"))
    n_items = centred.agg(F.count_distinct(item).cast("double").alias("p"))
    by_support = pairs.groupBy("support").agg(F.count(F.lit(1)).alias("pairs"))
    # cumulative counts run over distinct support levels, a small aggregate
    before = F.sum("pairs").over(Window.orderBy("support").rowsBetween(Window.unboundedPreceding, 0))
    levels = by_support.withColumn("_seen", F.sum("pairs").over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_cum", before)
    total = n_items.select((F.col("p") * (F.col("p") - 1) / 2).alias("t")).scalar()
    missing = total - F.col("_seen")
    at = lambda pos: F.min(F.when(F.col("_cum") + missing > pos, F.col("support")))
    lo, hi = F.floor((total - 1) / 2), F.floor(total / 2)
    seen = F.coalesce(F.max("_seen"), F.lit(0))
    pick = lambda pos: F.when(total - seen > pos, 0).otherwise(at(pos))
    return levels.agg(
        (pick(lo) / 2 + pick(hi) / 2).alias("median_support"),
        ((total - F.coalesce(F.sum(F.when(F.col("support") >= min_support, F.col("pairs"))), F.lit(0))) / total).alias("below_floor"),
        total.cast("bigint").alias("pairs"),
    )


def top_neighbours(similarity: DataFrame, top_k: int = 60) -> DataFrame:
    """Directed edges: each item's strongest neighbours by |similarity|."""
    edges = similarity.filter(F.col("similarity") != 0)
    both = edges.select(F.col("item_i").alias("src"), F.col("item_j").alias("dst"), "similarity", "support").unionByName(
        edges.select(F.col("item_j").alias("src"), F.col("item_i").alias("dst"), "similarity", "support"))
    w = Window.partitionBy("src").orderBy(F.desc(F.abs(F.round("similarity", 10))), "dst")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def nearest_items(
    centred: DataFrame, entity: str = "user_id", item: str = "item_id", value: str = "centred",
    min_support: int = 50, top_k: int = 60, tile: int = TILE,
) -> DataFrame:
    """(src, dst, similarity, support, rank): each item's ``top_k`` strongest neighbours by
    |cosine|, among those with ``min_support`` shared entities.

    Values go in divided by their item's norm, so cross sums are cosines.  Each strip keeps
    the ``top_k`` of its items within one block and no pair table is made: what is ranked in
    the end are ``top_k`` rows per item and block.
    """
    index = item_index(centred, item)
    n_items = index.count()
    norms = centred.groupBy(item).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    unit = centred.join(norms, item).withColumn(
        value, F.col(value) / F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))).drop("_norm")
    stats = ["n", "sxy"]
    tile = min(tile, max(n_items, 1))

    def finish(acc: np.ndarray, first_i: int, first_j: int) -> dict[str, np.ndarray]:
        n, cosine = acc
        size = np.where((n >= min_support) & (cosine != 0), np.abs(np.round(cosine, 10)), -1.0)
        k = min(top_k, size.shape[1])
        order = np.argsort(-size, axis=1, kind="stable")[:, :k]
        i, at = np.nonzero(np.take_along_axis(size, order, axis=1) >= 0)
        j = order[i, at]
        places = {"i": (i + first_i).astype(np.int32), "j": (j + first_j).astype(np.int32)}
        return places | {"n": n[i, j], "sxy": cosine[i, j]}

    packed = pack_rows(unit, index, (), entity, item, value)
    best = _summed(_partials(packed, [], tile, stats, n_items, both=True), [], tile, stats, finish, "i int, j int, n double, sxy double")
    w = Window.partitionBy("i").orderBy(F.desc(F.abs(F.round("sxy", 10))), "j")  # top_k rows a block
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return name_pairs(ranked, index, item).select(
        F.col("item_i").alias("src"), F.col("item_j").alias("dst"), F.col("sxy").alias("similarity"), F.col("n").alias("support"), "rank")


def group_coherence(corr: DataFrame, items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean sign-aligned nonzero correlation among each group's items.

    ``items``: (keys, item_id, group_id, loading).
    """
    keys = list(keys)
    side = lambda s: items.select(
        *keys, F.col("item_id").alias(f"item_{s}"), F.col("group_id").alias(f"g_{s}"),
        F.signum(F.coalesce("loading", F.lit(0.0))).alias(f"s_{s}"))
    return (
        corr.filter(F.col("r") != 0)
        .join(side("i"), [*keys, "item_i"]).join(side("j"), [*keys, "item_j"])
        .filter((F.col("g_i") == F.col("g_j")) & (F.col("s_i") * F.col("s_j") != 0))
        .groupBy(*keys, F.col("g_i").alias("group_id"))
        .agg(F.avg(F.col("r") * F.col("s_i") * F.col("s_j")).alias("coherence"),
             F.count(F.lit(1)).alias("n_pairs"))
    )
