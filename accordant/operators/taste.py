"""Taste dimensions from ratings, and what they explain of the other axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.hashing import distributed_rank, hash_halves, hash_hex
from accordant.operators import cells as C
from accordant.operators import factors as L
from accordant.operators import krylov as K
from accordant.operators import pairs as P
from accordant.operators import solvers as V
from accordant.operators.persons import REACTION_WEIGHTS, lookup
from accordant.session import cut_lineage

REPLICATION_FLOOR = 0.85
PROFILE_RATINGS = 10
MIN_RATERS = 200
MIN_RATINGS = 5
NULL_DRAWS = 60
# dealt ratings that one group ranks, about
_DEALT_ROWS = 200_000
ALPHAS = tuple(np.logspace(-2, 3, 20))


def complete_genome(scores: DataFrame, tags: DataFrame) -> DataFrame:
    """Relevance rows of the items that carry every tag."""
    total = tags.agg(F.count_distinct("tag")).scalar()
    full = scores.groupBy("item_id").agg(F.count_distinct("tag").alias("_n")).filter(F.col("_n") == total)
    return scores.join(full.select("item_id"), "item_id", "left_semi")


def _diag(index: DataFrame, keys: DataFrame | None, value: Column) -> DataFrame:
    base = index if keys is None else keys.select("*", F.explode(index.agg(F.collect_list("_idx")).scalar()).alias("_idx"))
    cols = [] if keys is None else keys.columns
    return base.select(*cols, F.col("_idx").alias("i"), F.col("_idx").alias("j"), value.alias("r"))


def taste_matrix(centred: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Correlations of item columns, absent ratings as zero, numbered, with the diagonal."""
    index = P.item_index(centred)
    corr = P.implicit_zero_correlation(centred, keys=keys)
    num = lambda s, c: index.select(F.col("item_id").alias(f"item_{s}"), F.col("_idx").alias(c))
    pairs = corr.join(num("i", "i"), "item_i").join(num("j", "j"), "item_j").select(*keys, "i", "j", "r")
    groups = centred.select(*keys).distinct() if keys else None
    return pairs.unionByName(_diag(index, groups, F.lit(1.0))), index


def taste_factors(centred: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, item_id, loadings): common factors of co-preference, strongest first.

    Up to ``MAX_DENSE`` items a key's correlations are solved in one task; beyond that the
    keys are solved one after the other from the rating rows.
    """
    if centred.select("item_id").distinct().count() > L.MAX_DENSE:
        found = [r.asDict() for r in centred.select(*keys).distinct().collect()] if keys else [{}]  # halves, not users
        parts = []
        for one in found:
            mine = centred
            for name, value in one.items():
                mine = mine.filter(F.col(name).eqNullSafe(F.lit(value)))
            parts.append(wide_factors(mine.drop(*keys), k).select(*[F.lit(v).alias(c) for c, v in one.items()], "item_id", "loadings"))
        return reduce(DataFrame.unionByName, parts)
    corr, index = taste_matrix(centred, keys)
    load = L.loadings(corr, keys, k, method="taste")
    return load.join(index, load.i == index._idx).select(*keys, "item_id", "loadings")


def taste_components(centred: DataFrame, k: int) -> DataFrame:
    """(item_id, loadings, variance): right singular vectors of the centred ratings times their
    singular values, from the rating rows themselves; the variance share is kept beside."""
    index = P.item_index(centred)
    rows = cut_lineage(P.pack_rows(centred, index, (), "user_id", "item_id", "centred").select("idx", "val"))
    found = K.leading(rows, index.count(), k)
    lam = np.maximum(found.values, 0)
    share = lam / lam.sum() if lam.sum() else lam
    stretched = F.transform("vector", lambda x, i: x * F.element_at(F.lit(np.sqrt(lam).tolist()), i + 1))
    return found.vectors.join(index, found.vectors.i == index._idx).select(
        "item_id", stretched.alias("loadings"), F.lit(share.tolist()).alias("variance"))


def wide_factors(centred: DataFrame, k: int, start: np.ndarray | None = None, rounds: int = V.AXIS_ROUNDS) -> DataFrame:
    """``taste_factors`` without a matrix of items by items, for any number of items.

    The correlations act as scaled rating rows less the rank-one part of the item means;
    each round of the principal axes takes the leading vectors with the communalities of
    the round before on the diagonal, starting from its vectors.  Communalities begin with
    ``start``, else with what the leading vectors of the correlations explain.
    """
    index = P.item_index(centred)
    items = index.count()
    k = min(k, items)
    x = F.col("centred")
    n_users = float(centred.agg(F.count_distinct("user_id")).first()[0])
    per = centred.join(index, "item_id").groupBy("_idx").agg((F.sum(x) / n_users).alias("mean"), (F.sum(x * x) / n_users).alias("square"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(1e-12)))
    per = cut_lineage(per.select("_idx", "mean", spread.alias("sd")))
    means = per.select("_idx", "mean", "sd").orderBy("_idx").toArrow()  # a row per item, as large as a vector of a block
    sd = means.column("sd").to_numpy()
    shift = means.column("mean").to_numpy() / sd
    scaled = centred.join(index, "item_id").join(per, "_idx").select(
        "user_id", "item_id", (x / F.col("sd") / F.lit(n_users**0.5)).alias("centred"))
    rows = cut_lineage(P.pack_rows(scaled, index, (), "user_id", "item_id", "centred").select("idx", "val"))
    h, vectors, load = start, None, np.zeros((items, k))
    if h is None:
        vectors, load = _scaled(rows, items, k, shift, np.zeros(items), None)
        h = np.square(load).sum(axis=1).clip(V.FIRST_LOW, V.FIRST_HIGH)
    for _ in range(rounds):
        vectors, load = _scaled(rows, items, k, shift, 1.0 - h, vectors)
        common = np.square(load).sum(axis=1).clip(max=V.LAST_HIGH)
        moved, h = np.abs(common - h).max(initial=0.0), common
        if moved < V.AXIS_TOLERANCE:
            break
    pattern = V.promax(load)[0]
    pattern = pattern[:, np.argsort(-np.square(pattern).sum(axis=0), kind="stable")]
    out = centred.sparkSession.createDataFrame(pa.table({"_idx": pa.array(range(items), pa.int64()), "loadings": list(pattern)}))
    return out.join(index, "_idx").select("item_id", "loadings")


def _scaled(rows: DataFrame, items: int, k: int, shift: np.ndarray, ridge: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Leading vectors, and the same as long as the roots of their values."""
    found = K.leading(rows, items, k, shift, ridge, tolerance=1e-10, start=start)
    vectors = np.array([r.vector for r in found.vectors.orderBy("i").toLocalIterator()])
    return vectors, vectors * np.sqrt(found.values.clip(min=0.0))


def replication(first: DataFrame, second: DataFrame, floor: float = REPLICATION_FLOOR) -> DataFrame:
    """Tucker congruence of each dimension with its best unclaimed partner in the other half."""
    long = lambda df, d, l: df.select("item_id", F.posexplode("loadings").alias(d, l))
    a, b = long(first, "a", "x"), long(second, "b", "y")
    dots = a.join(b, "item_id").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    na = a.groupBy("a").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("na"))
    nb = b.groupBy("b").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"))
    cong = dots.join(F.broadcast(na), "a").join(F.broadcast(nb), "b").select(
        "a", "b", F.abs(F.col("d") / (F.col("na") * F.col("nb") + 1e-12)).alias("c"))

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="c").fillna(0.0)
        free, rows = set(m.columns), []
        for dim in m.index:
            live = m.loc[dim, sorted(free)]
            best = live.idxmax() if len(live) and live.max() > 0 else None
            rows.append((int(dim), None if best is None else int(best), 0.0 if best is None else float(live[best])))
            free.discard(best)
        return pd.DataFrame(rows, columns=["dim", "partner", "congruence"])

    out = cong.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(claim, "dim int, partner int, congruence double")
    return out.withColumn("replicates", F.col("congruence") >= floor)


def extract(ratings: DataFrame, k: int, seed: str = "3") -> tuple[DataFrame, DataFrame]:
    """(loadings, replication): factors of all raters and how they come back from two halves."""
    centred = cut_lineage(C.centre(ratings, entity="user_id", value="stars", drop_zero=False).select("user_id", "item_id", "centred"))
    sides = hash_halves(centred.select("user_id").distinct(), "user_id", seed)
    halves = cut_lineage(taste_factors(cut_lineage(centred.join(sides, "user_id")), k, ["half"]))
    side = lambda s: halves.filter(F.col("half") == s).select("item_id", "loadings")
    return taste_factors(centred, k), replication(side("a"), side("b"))


def tag_correlations(loadings: DataFrame, genome: DataFrame) -> DataFrame:
    """Correlation of every tag's relevance with every dimension over the complete items."""
    long = loadings.select("item_id", F.posexplode("loadings").alias("dim", "l"))
    r = F.corr("relevance", "l")
    return genome.join(long, "item_id").groupBy("dim", "tag").agg(
        F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("r"))


def orient(loadings: DataFrame, correlations: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn dimensions so their anchor tag correlates positively: (loadings, flips).

    anchors: dim, anchor.  An anchor that is not a tag fails the job.
    """
    known = correlations.select(F.col("tag").alias("anchor"), "dim", "r")
    hit = anchors.filter(F.col("anchor").isNotNull()).join(known, ["dim", "anchor"], "left")
    checked = F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit("unknown anchor tag "), F.col("anchor"))).cast("double")).otherwise(F.col("r"))
    flips = hit.select("dim", "anchor", (checked < 0).alias("flipped"))
    turned = flips.filter("flipped").agg(F.collect_set("dim").alias("d"))  # at most one entry per dimension
    out = loadings.withColumn("_o", F.lit(1)).join(F.broadcast(turned.withColumn("_o", F.lit(1))), "_o")
    swap = F.transform("loadings", lambda x, i: F.when(F.array_contains("d", i), -x).otherwise(x))
    return out.withColumn("loadings", swap).drop("_o", "d"), flips


def name_evidence(correlations: DataFrame, top: int = 6) -> DataFrame:
    """The tags at both ends of every dimension and the strongest |r|."""
    r = F.round("r", 10)
    hi = Window.partitionBy("dim").orderBy(F.desc(r), "tag")
    lo = Window.partitionBy("dim").orderBy(r, "tag")
    ranked = correlations.withColumn("_h", F.row_number().over(hi)).withColumn("_l", F.row_number().over(lo))
    names = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= top, F.struct(c, "tag")))), lambda t: t["tag"])
    return ranked.groupBy("dim").agg(names("_h").alias("tags_high"), names("_l").alias("tags_low"), F.max(F.abs("r")).alias("evidence"))


def profile_reliability(
    loadings: DataFrame, ratings: DataFrame, take: int = PROFILE_RATINGS, sample: int | None = None,
    min_raters: int = MIN_RATERS, seed: str = "4",
) -> DataFrame:
    """How well a dimension places a person from ``take`` ratings: two disjoint halves
    per rater, correlated across raters, corrected to full length.

    A rater's ratings are ranked by hash in a window that only keeps the first
    2*take, so no rater is collected.
    """
    long = loadings.select("item_id", F.posexplode("loadings").alias("dim", "l"))
    stats = long.groupBy("dim").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))
    z = long.join(F.broadcast(stats), "dim").select(
        "item_id", "dim", ((F.col("l") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("z"))
    rated = ratings.join(loadings.select("item_id"), "item_id", "left_semi")
    able = rated.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * take)
    chosen = able.select("user_id")
    if sample is not None:
        chosen = able.orderBy(hash_hex(seed, "user_id"), "user_id").limit(sample).select("user_id")
    w = Window.partitionBy("user_id").orderBy(hash_hex(seed, "user_id", "item_id"), "item_id")
    picked = rated.join(chosen, "user_id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * take)
    picked = picked.withColumn("side", F.when(F.col("_r") <= take, 0).otherwise(1))
    mean = picked.groupBy("user_id", "side").agg(F.avg("stars").alias("_m"))
    x = F.col("stars") - F.col("_m")
    per = picked.join(mean, ["user_id", "side"]).withColumn("w", x).join(z, "item_id").groupBy("user_id", "side", "dim").agg(
        F.sum(F.col("z") * F.col("w")).alias("num"), F.sum(F.abs("w")).alias("den"))
    pos = per.filter(F.col("den") > C.ZERO).select("user_id", "side", "dim", (F.col("num") / F.col("den")).alias("p"))
    both = pos.groupBy("user_id", "dim").agg(
        F.max(F.when(F.col("side") == 0, F.col("p"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("b")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    r = F.corr("a", "b")
    out = both.groupBy("dim").agg(F.count(F.lit(1)).alias("raters"), r.alias("r"))
    brown = F.when(F.col("r").isNull() | F.isnan("r") | (F.col("r") <= 0), 0.0).otherwise(2 * F.col("r") / (1 + F.col("r")))
    return out.select("dim", "raters", F.when(F.col("raters") >= min_raters, brown).alias("reliability"))


# -- ridge on taste positions ---------------------------------------------------------

def complete_taste(taste: DataFrame) -> DataFrame:
    """(film_id, x): standardised positions of the films placed on every dimension."""
    dims = taste.agg(F.count_distinct("dim_id")).scalar()
    full = taste.groupBy("film_id").agg(F.count_distinct("dim_id").alias("_n")).filter(F.col("_n") == dims).select("film_id")
    rows = taste.join(full, "film_id", "left_semi")
    stats = rows.groupBy("dim_id").agg(F.avg("position").alias("m"), F.stddev_pop("position").alias("s"))
    z = (F.col("position") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    wide = rows.join(F.broadcast(stats), "dim_id").groupBy("film_id").agg(
        F.sort_array(F.collect_list(F.struct("dim_id", z.alias("z")))).alias("_x"))  # one entry per dimension
    return wide.select("film_id", F.transform("_x", lambda t: t["z"]).alias("x"))


def _moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normal-equation sums per key, one row per pair of predictors, as arrays:
    n, sum x, sum y, sum x*y and the flattened sum of x outer x.

    Sums run per (key, position) and combine map-side; nothing holds a key's rows.
    """
    keys = list(keys)
    ext = F.concat(F.array(F.lit(1.0)), F.col("x"), F.array(F.col("y")))
    flat = rows.select(*keys, ext.alias("e")).select(*keys, "e", F.posexplode("e").alias("a", "ea")).select(
        *keys, "a", "ea", F.posexplode("e").alias("b", "eb"))
    sums = flat.filter(F.col("a") <= F.col("b")).groupBy(*keys, "a", "b").agg(F.sum(F.col("ea") * F.col("eb")).alias("s"))
    return sums


def _solve_moments(pdf: pd.DataFrame):
    d = int(pdf.b.max())
    m = np.zeros((d + 1, d + 1))
    m[pdf.a, pdf.b] = pdf.s
    m[pdf.b, pdf.a] = pdf.s
    n, sx, sy = m[0, 0], m[0, 1:d], m[0, d]
    xbar, ybar = sx / n, sy / n
    return n, xbar, ybar, m[1:d, 1:d] - n * np.outer(xbar, xbar), m[1:d, d] - n * xbar * ybar


def residual_cells(cells: DataFrame, taste: DataFrame, alpha: float = 1.0, min_films: int = 20) -> DataFrame:
    """Verdicts with each item's ridge fit on the films' taste positions taken out, and
    the same films' raw value as control.

    An item with fewer engaged films is left as it is.
    """
    x = complete_taste(taste)
    rows = cut_lineage(cells.filter(F.abs("value") > C.ZERO).join(x, "film_id").withColumn("y", F.col("value")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, xbar, ybar, xx, xy = _solve_moments(pdf)
        beta = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy) if n >= min_films else np.zeros(len(xx))
        level = ybar - beta @ xbar if n >= min_films else 0.0
        return pd.DataFrame({"item_id": [pdf.item_id.iloc[0]], "beta": [beta], "level": [level]})

    coef = _moments(rows, ["item_id"]).groupBy("item_id").applyInPandas(fit, "item_id string, beta array<double>, level double")
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = rows.join(coef, "item_id")  # one row per guarded item
    return out.select("film_id", "item_id", F.col("value").alias("control"), (F.col("value") - F.col("level") - dot).alias("value"))


def taste_residual_test(cells: DataFrame, taste: DataFrame, n_iter: int = 200, min_films: int = 100, seed: int = 11) -> DataFrame:
    """Parallel analysis of the residual cells and of the same films' raw cells; no
    rows when fewer films carry a complete taste row."""
    res = cut_lineage(residual_cells(cells, taste))
    both = res.select(F.lit("residual").alias("which"), "film_id", "item_id", "value").unionByName(
        res.select(F.lit("control").alias("which"), "film_id", "item_id", F.col("control").alias("value")))
    films = res.agg(F.count_distinct("film_id")).scalar()
    horn = L.parallel_analysis(L.null_spectra(both, ["which"], n_iter, "fa", seed), ["which"])
    return horn.withColumn("films", films).filter(F.col("films") >= min_films)


def adjusted_positions(
    positions: DataFrame, taste: DataFrame, folds: int = 5, alphas: Sequence[float] = ALPHAS, min_films: int = 60, seed: str = "0",
) -> DataFrame:
    """Cross-validated residual of every position on the taste dimensions, and the
    share of each axis they predict out of sample.

    Folds are hash ranks.  Each (axis, fold) is solved once from summed moments of the
    other folds; leave-one-out errors of all penalties are then one pass over the
    rows with the d x d solutions beside them.
    """
    x = complete_taste(taste)
    rows = cut_lineage(positions.select("film_id", "factor_id", F.col("position").alias("y")).join(x, "film_id"))
    enough = rows.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_films)
    rows = rows.join(F.broadcast(enough.select("factor_id")), "factor_id", "left_semi")
    ranked = distributed_rank(rows.withColumn("_h", hash_hex(seed, "factor_id", "film_id")), ["factor_id"], "_h", "_r")
    rows = cut_lineage(ranked.withColumn("fold", (F.col("_r") % folds).cast("int")).drop("_h", "_r"))
    train = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("out")).filter(F.col("out") != F.col("fold"))

    def prepare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, xbar, ybar, xx, xy = _solve_moments(pdf)
        lam, q = np.linalg.eigh(xx)
        return pd.DataFrame({"factor_id": [pdf.factor_id.iloc[0]], "out": [pdf.out.iloc[0]], "n": [n], "xbar": [xbar], "ybar": [ybar],
                             "lam": [np.maximum(lam, 0)], "q": [q.ravel()], "c": [q.T @ xy]})

    kind = rows.schema["factor_id"].dataType.simpleString()
    solved = _moments(train, ["factor_id", "out"]).groupBy("factor_id", "out").applyInPandas(
        prepare, f"factor_id {kind}, out int, n double, xbar array<double>, ybar double, lam array<double>, q array<double>, c array<double>")
    solved = cut_lineage(solved)
    penalties = np.asarray(alphas)

    def _predict(pdf: pd.DataFrame, s) -> tuple[np.ndarray, np.ndarray]:
        d = len(s.lam)
        z = (np.stack(pdf.x.to_numpy()) - s.xbar) @ np.asarray(s.q).reshape(d, d)
        inv = 1.0 / (np.asarray(s.lam)[:, None] + penalties)
        return s.ybar + (z * s.c) @ inv, 1.0 / s.n + np.square(z) @ inv

    def loo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (f, o), part in pdf.groupby(["factor_id", "out"]):
                pred, lever = _predict(part, part.iloc[0])
                err = np.square((part.y.to_numpy()[:, None] - pred) / (1 - np.minimum(lever, 1 - 1e-9))).sum(axis=0)
                out.append(pd.DataFrame({"factor_id": f, "out": o, "a": np.arange(len(penalties)), "e": err}))
            if out:
                yield pd.concat(out)

    # one row per axis and fold
    scored = train.join(F.broadcast(solved), ["factor_id", "out"]).mapInPandas(loo, f"factor_id {kind}, out int, a int, e double")
    best = scored.groupBy("factor_id", "out", "a").agg(F.sum("e").alias("e")).groupBy("factor_id", "out").agg(
        F.min_by("a", F.struct("e", "a")).alias("a"))
    held = rows.withColumnRenamed("fold", "out").join(F.broadcast(solved.join(best, ["factor_id", "out"])), ["factor_id", "out"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(["factor_id", "out"]):
                pred, _lever = _predict(part, part.iloc[0])
                yield pd.DataFrame({"factor_id": part.factor_id, "film_id": part.film_id, "y": part.y,
                                    "predicted": pred[:, int(part.a.iloc[0])]})

    film = rows.schema["film_id"].dataType.simpleString()
    pred = held.mapInPandas(apply, f"factor_id {kind}, film_id {film}, y double, predicted double")
    e = F.col("y") - F.col("predicted")
    share = pred.groupBy("factor_id").agg(
        F.greatest(F.lit(0.0), 1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("taste_explained"))
    return pred.join(F.broadcast(share), "factor_id").select("film_id", "factor_id", e.alias("score"), "taste_explained")


# -- person placement --------------------------------------------------------------------

def one_way_icc(values: DataFrame, keys: Sequence[str], group: str = "user_id", value: str = "v") -> DataFrame:
    """One-way random-effects ICC of unequal groups, from counts, sums and squares."""
    keys = list(keys)
    v = F.col(value)
    return _icc_of_sums(values.groupBy(*keys, group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")), keys)


def _icc_of_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from every group's count ``n``, sum ``s`` and sum of squares ``q``."""
    g = sums.filter(F.col("n") >= 2)
    t = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sm"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("sw"),
        F.sum(F.col("n") * F.col("n")).alias("nn"))
    k, n = F.col("groups"), F.col("n")
    between = (F.col("sm") - F.col("s") * F.col("s") / n) / (k - 1)
    within = F.col("sw") / (n - k)
    size = (n - F.col("nn") / n) / (k - 1)
    var = (between - within) / size
    icc = F.when(var + within > 0, var / (var + within)).otherwise(0.0)
    return t.filter(k >= 2).select(*keys, icc.alias("icc"), size.alias("size"), "groups")


def spearman_brown(icc: Column, n: Column) -> Column:
    return F.when(icc.isNull() | (icc <= 0), 0.0).otherwise(n * icc / (1 + (n - 1) * icc))


def _dealt(pool: DataFrame, draws: int, seed: str) -> DataFrame:
    """(draw, user_id, film_id, weight): every draw's ratings with their new raters.

    Ratings split by leading digits of their digest, as in ``distributed_rank``.  Digests are
    uniform, so a split's ranks lie close together in all draws, and the raters seated there
    come along with it: a rating's new rater is known where its rank is.
    """
    digits = max(1, round(np.log(max(pool.count() * draws, 1) / _DEALT_ROWS) / np.log(16)))
    h = F.col("_h")
    dealt = pool.select("user_id", "film_id", "weight", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn(
        "_h", hash_hex(seed, "draw", "user_id", "film_id"))
    # 120 bits of the digest
    part = lambda lo: F.conv(F.substring(h, lo, 15), 16, 10).cast("bigint")
    dealt = dealt.select(
        F.conv(F.substring(h, 1, digits), 16, 10).cast("int").alias("_b"), "draw", part(1).alias("_k"), part(16).alias("_l"), "film_id", "weight")
    counts = dealt.groupBy("draw", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("draw").orderBy("_b")) - F.col("_n")
    counts = cut_lineage(counts.withColumn("_at", before))  # a row per draw and split
    block = _DEALT_ROWS // max(draws, 1) + 1
    reach = counts.groupBy("_b").agg(F.min("_at").alias("lo"), F.max(F.col("_at") + F.col("_n")).alias("hi")).select(
        "_b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("_block"))
    seats = pool.select("seat", "user_id", F.floor(F.col("seat") / block).alias("_block")).join(reach, "_block").select(
        "_b", F.lit(-1).alias("draw"), F.col("seat").alias("_at"), "user_id")
    user, film = (pool.schema[c].dataType for c in ("user_id", "film_id"))
    known = seats.unionByName(counts.select("_b", "draw", "_at", F.lit(None).cast(user).alias("user_id")))

    def deal(rows: pa.Table, known: pa.Table) -> pa.Table:
        draw, kind, at = rows.column("draw").to_numpy(), known.column("draw").to_numpy(), known.column("_at").to_numpy()
        order = np.lexsort((rows.column("_l").to_numpy(), rows.column("_k").to_numpy(), draw))
        draw = draw[order]
        first = np.zeros(draws, np.int64)
        first[kind[kind >= 0]] = at[kind >= 0]
        seat = first[draw] + np.arange(len(draw)) - np.searchsorted(draw, np.arange(draws))[draw] + 1
        held = np.flatnonzero(kind < 0)
        held = held[np.argsort(at[held])]
        return pa.table({
            "draw": draw, "user_id": known.column("user_id").take(held[np.searchsorted(at[held], seat)]),
            "film_id": rows.column("film_id").take(order), "weight": rows.column("weight").take(order)})

    ddl = f"draw int, user_id {user.simpleString()}, film_id {film.simpleString()}, weight double"
    return dealt.groupBy("_b").cogroup(known.groupBy("_b")).applyInArrow(deal, ddl)


def person_placement(
    preferences: DataFrame, positions: DataFrame, reactions: DataFrame, draws: int = NULL_DRAWS,
    min_ratings: int = MIN_RATINGS, min_raters: int = 20, seed: str = "7",
) -> DataFrame:
    """Per axis: reliability of a person's placement, the 95th percentile of dealt
    ratings, whether the axis places people, and the liked-share control.

    A draw hands the pooled ratings back in the same group sizes: the rating at hash
    rank r goes to the rater of the rating at static rank r.  Dealt ratings are shuffled
    twice, as narrow rows: to be ranked and to their new raters.
    """
    axes = [r[0] for r in positions.select("factor_id").distinct().orderBy("factor_id").collect()]  # a handful
    at = lambda k: F.max(F.when(F.col("factor_id") == axes[k], F.col("position")))
    places = positions.groupBy("film_id").agg(*[at(k).alias(f"_p{k}") for k in range(len(axes))])
    places = cut_lineage(places.dropna(subset=[f"_p{k}" for k in range(len(axes))]))
    usable = preferences.join(places.select("film_id"), "film_id", "left_semi").select("user_id", "film_id", "weight")
    raters = cut_lineage(usable.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_ratings))
    pool = usable.join(raters.select("user_id"), "user_id", "left_semi")
    pool = cut_lineage(distributed_rank(pool.withColumn("_h", hash_hex("seat", "user_id", "film_id")), [], "_h", "seat").drop("_h"))
    n_raters = raters.agg(F.count(F.lit(1))).scalar()
    rows = pool.select(F.lit(-1).alias("draw"), "user_id", "film_id", "weight").unionByName(_dealt(pool, draws, seed))
    v = lambda k: F.col("weight") * F.col(f"_p{k}")
    # a row per placed film goes to the ratings, which lie by rater from here on
    per = rows.repartition("user_id").join(F.broadcast(places), "film_id").groupBy("draw", "user_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.struct(F.lit(f).alias("factor_id"), F.sum(v(k)).alias("s"), F.sum(v(k) * v(k)).alias("q")) for k, f in enumerate(axes)]).alias("_a"))
    sums = per.select("draw", "user_id", "n", F.explode("_a").alias("_a")).select("draw", "user_id", "n", "_a.*")
    rel = _icc_of_sums(sums, ["draw", "factor_id"]).select("draw", "factor_id", spearman_brown(F.col("icc"), F.col("size")).alias("rel"))
    liked = reactions.withColumn("w", lookup("reaction", REACTION_WEIGHTS)).filter("w <> 0").join(
        raters.select("user_id"), "user_id", "left_semi").select("user_id", F.when(F.col("w") > 0, 1.0).otherwise(0.0).alias("v"))
    control = one_way_icc(liked, []).agg(F.first("icc")).scalar()
    out = rel.groupBy("factor_id").agg(
        F.max(F.when(F.col("draw") < 0, F.col("rel"))).alias("reliability"),
        F.percentile(F.when(F.col("draw") >= 0, F.col("rel")), 0.95).alias("noise_ceiling"))
    return out.select(
        "factor_id", "reliability", "noise_ceiling", (F.round("reliability", 10) > F.round("noise_ceiling", 10)).alias("places_people"),
        n_raters.alias("raters"), control.alias("control")).filter(F.col("raters") >= min_raters)


def placement_order(verdicts: DataFrame) -> DataFrame:
    """Placement verdicts usable for ordering: none when no axis passes."""
    any_pass = verdicts.agg(F.max("places_people")).scalar()
    return verdicts.filter(any_pass)
