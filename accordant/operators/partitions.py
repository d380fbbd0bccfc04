"""Do two groupings of the same items agree, whatever the groups are called?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.hashing import hash_hex
from accordant.session import cut_lineage

FLAT_MARGIN = 0.05


def _comb2(c: Column) -> Column:
    c = c.cast("double")
    return c * (c - 1) / 2


def partition_pairs(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both scorers' group of every item they share, each pair of scorers once."""
    keys = list(keys)
    a = parts.select(*keys, "item_id", F.col("scorer").alias("scorer_a"), F.col("group_id").alias("a"))
    b = parts.select(*keys, "item_id", F.col("scorer").alias("scorer_b"), F.col("group_id").alias("b"))
    return a.join(b, [*keys, "item_id"]).filter(F.col("scorer_a") < F.col("scorer_b"))


def contingency(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell counts of every pair, with both marginals beside them."""
    keys = list(keys)
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("c"))
    ma = cells.groupBy(*keys, "a").agg(F.sum("c").alias("ma"))
    mb = cells.groupBy(*keys, "b").agg(F.sum("c").alias("mb"))
    return cells.join(ma, [*keys, "a"]).join(mb, [*keys, "b"])


def _rand_index(index: Column, sum_a: Column, sum_b: Column, n: Column) -> Column:
    expected = sum_a * sum_b / _comb2(n)
    top = (sum_a + sum_b) / 2
    return F.when(top - expected == 0, 1.0).otherwise((index - expected) / (top - expected))


def _marginals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """n, pair counts inside groups and entropies of both sides, per key."""
    side = lambda col, m: cells.select(*keys, col, m).distinct().groupBy(*keys).agg(
        F.sum(m).alias(f"n_{col}"), F.sum(_comb2(F.col(m))).alias(f"pairs_{col}"),
        F.sum(F.col(m) * F.log(F.col(m).cast("double"))).alias(f"mlogm_{col}"),
        F.count(F.lit(1)).alias(f"groups_{col}"))
    return side("a", "ma").join(side("b", "mb"), keys)


def partition_agreement(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw agreement, adjusted Rand index and normalised mutual information."""
    keys = list(keys)
    cells = contingency(pairs, keys)
    marg = _marginals(cells, keys)
    joint = cells.groupBy(*keys).agg(
        F.sum("c").alias("n_items"),
        F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same"),
        F.sum(_comb2(F.col("c"))).alias("idx"),
        F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clogc"))
    n = F.col("n_items").cast("double")
    out = joint.join(marg, keys)
    h_a, h_b = F.log(n) - F.col("mlogm_a") / n, F.log(n) - F.col("mlogm_b") / n
    mi = F.log(n) + (F.col("clogc") - F.col("mlogm_a") - F.col("mlogm_b")) / n
    single = (F.col("groups_a") == 1) & (F.col("groups_b") == 1)
    nmi = F.when(single, 1.0).when(F.abs(mi) < 1e-12, 0.0).otherwise(mi / ((h_a + h_b) / 2))
    return out.filter(F.col("n_items") >= 2).select(
        *keys, "n_items", (F.col("same") / F.col("n_items")).alias("raw"),
        _rand_index(F.col("idx"), F.col("pairs_a"), F.col("pairs_b"), F.col("n_items")).alias("ari"),
        nmi.alias("nmi"), F.col("groups_a"), F.col("groups_b"))


def _falling(c: Column, r: int) -> Column:
    """c (c - 1) ... (c - r + 1)."""
    out = c.cast("double")
    for k in range(1, r):
        out = out * (c.cast("double") - k)
    return out


def chance_moments(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, null_sd): the standard deviation of the adjusted Rand index over all ways to
    hand one side's labels out anew; its mean is 0.

    Both margins stay, so cells are multivariate hypergeometric and products of their
    falling factorials have closed forms in those of the margins.
    """
    keys = list(keys)
    cells = contingency(pairs, keys)

    def side(col: str, m: str) -> DataFrame:
        f = lambda r: F.sum(_falling(F.col(m), r))
        two = _falling(F.col(m), 2)
        return cells.select(*keys, col, m).distinct().groupBy(*keys).agg(
            F.sum(m).cast("double").alias(f"n_{col}"), f(2).alias(f"{col}2"), f(3).alias(f"{col}3"), f(4).alias(f"{col}4"),
            F.sum(two * two).alias(f"{col}22"))

    m = side("a", "ma").join(side("b", "mb"), keys)
    n = F.col("n_a")
    n2, n3, n4 = (_falling(n, r) for r in (2, 3, 4))
    a, b = (F.col("a2") * F.col("a2") - F.col("a22")), (F.col("b2") * F.col("b2") - F.col("b22"))  # two different groups
    mean = F.col("a2") * F.col("b2") / n2
    same_cell = F.col("a4") * F.col("b4") / n4 + 4 * F.col("a3") * F.col("b3") / n3 + 2 * mean
    square = same_cell + (F.col("a4") * b + a * F.col("b4") + a * b) / n4
    spread = (F.col("a2") + F.col("b2")) / 2 - mean
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / spread
    return m.select(*keys, F.when((n >= 4) & (spread != 0), sd).alias("null_sd"))


def drawn_rand(pairs: DataFrame, keys: Sequence[str], n_iter: int, seed: int) -> DataFrame:
    """(keys, rep, ari) of random tables with both margins fixed, which is what shuffling one
    side's labels gives.  A pair of scorers is one row of margins, and a replicate one row;
    the items are not read again."""
    keys = list(keys)
    cells = contingency(pairs, keys)
    margin = lambda col, m: cells.select(*keys, col, m).distinct().groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(col, m))), lambda r: r[m]).alias(m))  # one entry per group
    rows = margin("a", "ma").join(margin("b", "mb"), keys)
    reps = rows.select(*keys, "ma", "mb", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("rep"))
    salted = reps.withColumn("_salt", F.xxhash64(F.lit(seed), "rep", *keys)).repartition("rep")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ma, mb, salt in zip(*(batch.column(c).to_pylist() for c in ("ma", "mb", "_salt"))):
                rng, left, found = np.random.default_rng(salt & 0xFFFFFFFFFFFFFFFF), np.array(mb, np.int64), 0.0
                for m in ma:  # one group after the other takes its items from what is left of the other side
                    row = rng.multivariate_hypergeometric(left, m, method="marginals")
                    left = left - row
                    found += float((row * (row - 1)).sum()) / 2
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("rep"), pa.array(out, pa.float64())], [*keys, "rep", "idx"])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    found = salted.mapInArrow(draw, kinds + "rep int, idx double")
    marg = _marginals(cells, keys)
    return found.join(marg, keys).select(
        *keys, "rep", _rand_index(F.col("idx"), F.col("pairs_a"), F.col("pairs_b"), F.col("n_a")).alias("ari"))


def agreement_with_null(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition agreement with the spread that chance gives and z; chance's mean is 0."""
    out = partition_agreement(pairs, keys).join(chance_moments(pairs, keys), list(keys), "left")
    return out.withColumn("z", F.when(F.col("null_sd") > 1e-12, F.col("ari") / F.col("null_sd")))


def agreement_draws(pairs: DataFrame, keys: Sequence[str], n_iter: int = 500, seed: int = 11) -> DataFrame:
    """Observed index, mean and spread of the drawn null, and how many draws reach the observed one."""
    keys = list(keys)
    drawn = drawn_rand(pairs, keys, n_iter, seed).join(partition_agreement(pairs, keys).select(*keys, F.col("ari").alias("observed")), keys)
    return drawn.groupBy(*keys, "observed").agg(
        F.count(F.lit(1)).alias("permutations"), F.avg("ari").alias("null_mean"), F.stddev_pop("ari").alias("null_sd"),
        F.count_if(F.col("ari") >= F.col("observed") - 1e-12).alias("n_at_least_observed"))


def permuted_rand(pairs: DataFrame, keys: Sequence[str], n_iter: int, seed: str) -> DataFrame:
    """(keys, rep, ari) of every hash-shuffled replicate: items in their own order take the
    labels ``b`` in the order of ``md5(seed|rep|keys|item)``.

    A replicate's labels are ranked by a window, which spills, and meet the places of the
    items, which are ranked once; nothing is collected."""
    keys = list(keys)
    placed = pairs.select(*keys, "item_id", "a", "b", F.row_number().over(Window.partitionBy(*keys).orderBy("item_id")).alias("place"))
    placed = cut_lineage(placed)
    reps = placed.select(*keys, "item_id", "b", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("rep"))
    hashed = reps.select(*keys, "rep", "b", F.unhex(hash_hex(seed, "rep", *keys, "item_id")).alias("_h"))
    drawn = hashed.select(*keys, "rep", "b", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("_h")).alias("place"))
    cells = drawn.join(placed.select(*keys, "place", "a"), [*keys, "place"]).groupBy(*keys, "rep", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    idx = cells.groupBy(*keys, "rep").agg(F.sum(_comb2(F.col("c"))).alias("idx"), F.sum("c").alias("n"))
    return idx.join(_marginals(contingency(pairs, keys), keys), keys).select(
        *keys, "rep", _rand_index(F.col("idx"), F.col("pairs_a"), F.col("pairs_b"), F.col("n")).alias("ari"))


def agreement_with_permutations(pairs: DataFrame, keys: Sequence[str], n_iter: int = 500, seed: str = "ari") -> DataFrame:
    """Partition agreement with mean, spread and z of its permutation null, and beside them
    the spread and z over all permutations in closed form (``exact_sd``, ``exact_z``)."""
    keys = list(keys)
    null = permuted_rand(pairs, keys, n_iter, seed).groupBy(*keys).agg(
        F.avg("ari").alias("null_mean"), F.stddev_pop("ari").alias("null_sd"))
    exact = agreement_with_null(pairs, keys).withColumnsRenamed({"null_sd": "exact_sd", "z": "exact_z"})
    out = exact.join(null, keys, "left")
    return out.withColumn("z", F.when(F.col("null_sd") > 1e-12, (F.col("ari") - F.col("null_mean")) / F.col("null_sd")))


def overlap_jaccard(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlap and Jaccard of every pair of groups that meet."""
    return contingency(pairs, keys).select(
        *keys, "a", "b", F.col("c").alias("shared_items"), F.col("ma").alias("a_size"), F.col("mb").alias("b_size"),
        (F.col("c") / (F.col("ma") + F.col("mb") - F.col("c"))).alias("jaccard"))


def _best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-total one-to-one matching by shortest augmenting paths with potentials."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    rows, cols = cost.shape
    row_pot, col_pot = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        dist = np.full(cols, np.inf)
        via = np.full(cols, -1)
        done = np.zeros(cols, bool)
        row, last, base = start, -1, 0.0
        while True:
            slack = base + cost[row] - row_pot[row] - col_pot
            better = ~done & (slack < dist - 1e-12)
            dist[better], via[better] = slack[better], last
            nxt = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[nxt], last = dist[nxt], True, nxt
            if owner[nxt] < 0:
                break
            row = owner[nxt]
        settled = done & (dist < base)
        row_pot[start] += base
        for c in np.flatnonzero(settled):
            row_pot[owner[c]] += base - dist[c]
            col_pot[c] -= base - dist[c]
        while last >= 0:
            prev = via[last]
            owner[last] = owner[prev] if prev >= 0 else start
            last = prev
    out = [(int(owner[c]), c) for c in range(cols) if owner[c] >= 0]
    return sorted((c, r) for r, c in out) if flip else sorted(out)


def match_groups(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one matching of two scorers' groups with the largest total overlap.

    Spark counts the overlaps; one task sees one pair's table of group sizes only.
    """
    keys = list(keys)
    cells = overlap_jaccard(pairs, keys)
    out_cols = [*keys, "a", "b", "shared_items", "a_size", "b_size", "jaccard"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids_a, ids_b = sorted(pdf.a.unique()), sorted(pdf.b.unique())
        table = pdf.pivot(index="a", columns="b", values="shared_items").reindex(index=ids_a, columns=ids_b).fillna(0)
        size_a = pdf.drop_duplicates("a").set_index("a").a_size
        size_b = pdf.drop_duplicates("b").set_index("b").b_size
        gain = table.to_numpy()
        rows = []
        for i, j in _best_assignment(gain):
            shared = int(gain[i, j])
            union = size_a[ids_a[i]] + size_b[ids_b[j]] - shared
            rows.append([*[pdf[k].iloc[0] for k in keys], ids_a[i], ids_b[j], shared,
                         size_a[ids_a[i]], size_b[ids_b[j]], shared / union if union else 0.0])
        return pd.DataFrame(rows, columns=out_cols)

    return cells.groupBy(*keys).applyInPandas(solve, cells.select(*out_cols).schema)


def item_stability(parts: DataFrame) -> DataFrame:
    """Mean Jaccard of an item's companions over all pairs of scorers, for items
    every scorer grouped.  The companions' overlap is a contingency cell."""
    total = parts.agg(F.count_distinct("scorer")).scalar()
    shared = parts.groupBy("item_id").agg(F.count_distinct("scorer").alias("_s")).filter(F.col("_s") == total)
    pairs = partition_pairs(parts.join(shared.select("item_id"), "item_id", "left_semi"))
    cells = overlap_jaccard(pairs, ["scorer_a", "scorer_b"])
    return pairs.join(cells, ["scorer_a", "scorer_b", "a", "b"]).groupBy("item_id").agg(
        F.avg("jaccard").alias("stability"), F.count(F.lit(1)).alias("pairs"))


def k_sweep(parts: DataFrame, n_iter: int = 0, seed: int = 12) -> DataFrame:
    """Mean, least and greatest pairwise ARI at each k, with the null mean when asked."""
    keys = ["k", "scorer_a", "scorer_b"]
    pairs = partition_pairs(parts, ["k"])
    agree = partition_agreement(pairs, keys)
    models = parts.groupBy("k").agg(F.count_distinct("scorer").alias("models"))
    out = agree.groupBy("k").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"),
        F.max("ari").alias("max_ari")).join(models, "k")
    if n_iter:
        null = drawn_rand(pairs, keys, n_iter, seed).groupBy("k").agg(F.avg("ari").alias("null"))
        out = out.join(null, "k", "left")
    return out


def best_k(sweep: DataFrame) -> DataFrame:
    """The k where scorers agree most, its margin over the next and whether that is flat."""
    order = Window.orderBy(F.desc("mean_ari"), "k")  # one row per k
    ranked = sweep.withColumn("_next", F.lead("mean_ari").over(order)).withColumn("_r", F.row_number().over(order))
    margin = F.round(F.col("mean_ari") - F.col("_next"), 3)
    return ranked.filter(F.col("_r") == 1).select(
        "k", "mean_ari", margin.alias("margin"), F.coalesce(margin < FLAT_MARGIN, F.lit(False)).alias("flat"))


def convergence(counts: DataFrame) -> DataFrame:
    """Do scorers agree on the number of factors? Counts, spread and median."""
    return counts.agg(
        F.count(F.lit(1)).alias("scorers"), (F.count_distinct("n_factors") == 1).alias("same_count"),
        (F.max("n_factors") - F.min("n_factors")).cast("bigint").alias("spread"), F.percentile("n_factors", 0.5).alias("median"))


def incumbent_partitions(own: DataFrame, incumbent: DataFrame, incumbent_name: str) -> DataFrame:
    """Every scorer's partition and the incumbent's at the same number of groups.

    incumbent: dim_version, item_id, group_id; a version joins the scorers whose
    group count it shares.
    """
    k_own = own.groupBy("scorer").agg(F.count_distinct("group_id").alias("k"))
    k_inc = incumbent.groupBy("dim_version").agg(F.count_distinct("group_id").alias("k"))
    usable = k_inc.join(k_own.select("k").distinct(), "k", "left_semi")
    inc = incumbent.join(usable, "dim_version").select(
        F.lit(incumbent_name).alias("scorer"), "k", "item_id", "group_id")
    return own.join(k_own, "scorer").select("scorer", "k", "item_id", "group_id").unionByName(inc)
