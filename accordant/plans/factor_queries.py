"""Spectra, nulls, loadings and groups of every reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import cells as C
from accordant.operators import factors as L
from accordant.operators import pairs as P
from accordant.plans.bindings import bind, oracle_with
from accordant.plans.cells_queries import CORR
from accordant.plans.registry import query
from accordant.session import cut_lineage

R = ["scorer"]


def response(spark, d):
    v = bind(spark, d, "verdicts").select("scorer", "film_id", "item_id", "variant", "value")
    return C.response_cells(v, *R)


def correlation(spark, d):
    cells = response(spark, d)
    cells = cut_lineage(cells)
    index = P.item_index(cells)
    return cells, index, L.correlation_cells(cells, R, index)


@query("spectrum_common_factors", "M2")
def _spectrum_fa(spark, d):
    return L.spectrum(correlation(spark, d)[2], R, "fa")


@query("spectrum_components", "M2")
def _spectrum_pca(spark, d):
    return L.spectrum(correlation(spark, d)[2], R, "pca")


@query("spectrum_invariants", "M2", oracle_with("verdicts", CORR + """
, p AS (SELECT scorer, count(DISTINCT item_id) AS n_items FROM m GROUP BY scorer),
q AS (SELECT scorer, sum(r * r) AS rr FROM corr GROUP BY scorer)
SELECT scorer, n_items, round(CAST(n_items AS DOUBLE), 6) AS trace, round(n_items + 2 * rr, 6) AS squares FROM p JOIN q USING (scorer)"""))
def _spectrum_invariants(spark, d):
    """Sum and sum of squares of the eigenvalues, which the correlations alone determine."""
    w = L.spectrum(correlation(spark, d)[2], R, "pca")
    return w.groupBy(*R).agg(
        F.count(F.lit(1)).alias("n_items"), F.round(F.sum("eigenvalue"), 6).alias("trace"),
        F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 6).alias("squares"))


@query("factor_loadings", "M4")
def _loadings(spark, d):
    return L.loadings(correlation(spark, d)[2], R, 3)


@query("factor_correlations", "M4")
def _phi(spark, d):
    return L.factor_correlations(correlation(spark, d)[2], R, 3)


@query("parallel_analysis", "M6")
def _parallel(spark, d):
    return L.parallel_analysis(L.null_spectra(response(spark, d), R, 200), R)


@query("common_factor_groups", "M8")
def _groups(spark, d):
    _, index, corr = correlation(spark, d)
    return L.common_factor_groups(L.loadings(corr, R, 3), index, R)


@query("component_groups", "M7")
def _components(spark, d):
    cells = response(spark, d)
    index = P.item_index(cells)
    load = L.loadings(L.correlation_cells(cells, R, index), R, 3, method="pca")
    return L.component_groups(load, index, R)


@query("composite_groups", "M9")
def _composites(spark, d):
    cells, index, corr = correlation(spark, d)
    load = L.loadings(corr, R, 3)
    return L.common_factor_groups(L.composite_loadings(cells, load, index, R), index, R)


@query("split_half_overlap", "M11 W14")
def _halves(spark, d):
    return L.split_half_overlap(response(spark, d), R)


@query("factor_analysis_report", "M10 M32")
def _analyse(spark, d):
    v = bind(spark, d, "verdicts").select("scorer", "film_id", "item_id", "variant", "value")
    counts = C.contested_counters(cut_lineage(C.cell_means(v, *R, "film_id", "item_id")), *R)
    report, _items = L.analyse(response(spark, d), R, n_iter=200)
    return counts.join(report.drop("observed", "null_threshold"), R, "left").withColumn("status", F.coalesce("status", F.lit("no contested item")))
