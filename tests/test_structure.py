"""Planted and null structure, permutation paths, rotations, groups."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from accordant.operators import cells as C
from accordant.operators import factors as L
from accordant.operators import pairs as P
from accordant.operators import partitions as T
from accordant.operators import permutation as M


def long(spark, matrix):
    rows, cols = np.nonzero(matrix)
    pdf = pd.DataFrame({"film_id": rows.astype("int64"), "item_id": [f"i{c:03d}" for c in cols], "value": matrix[rows, cols]})
    return spark.createDataFrame(pdf)


def planted(n=200, k=3, per=15, noise=0.35, engaged=0.85, seed=1):
    rng = np.random.default_rng(seed)
    score = rng.standard_normal((n, k))
    sign = np.where(rng.random((k, per)) < 0.5, -1, 1)
    raw = np.concatenate([score[:, [f]] * sign[f] + noise * rng.standard_normal((n, per)) for f in range(k)], axis=1)
    return np.where(rng.random(raw.shape) < engaged, np.sign(raw), 0.0)


def test_planted_factors_are_found_and_noise_gives_none(spark):
    rng = np.random.default_rng(3)
    noise = rng.choice([-1.0, 0.0, 1.0], size=(60, 40))
    real = L.parallel_analysis(L.null_spectra(long(spark, planted()), n_iter=40)).first()
    none = L.parallel_analysis(L.null_spectra(long(spark, noise), n_iter=40)).first()
    assert 2 <= real.n_factors <= 4
    assert none.n_clear_factors <= 1


def test_component_count(spark):
    out = L.parallel_analysis(L.null_spectra(long(spark, planted()), n_iter=30, method="pca")).first()
    assert out.n_factors == 3


def test_task_and_shuffle_paths_agree(spark):
    cells = long(spark, planted(n=40, per=5)).withColumn("scorer", F.lit("s"))
    a = L.null_spectra(cells, ["scorer"], n_iter=4, path="task").toPandas()
    b = L.null_spectra(cells, ["scorer"], n_iter=4, path="shuffle").toPandas()
    key = ["rep", "rank"]
    merged = a.merge(b, on=key)
    assert len(merged) == len(a) == len(b)
    assert np.abs(merged.eigenvalue_x - merged.eigenvalue_y).max() < 1e-8


def test_permute_is_a_bijection_per_column():
    for n in (1, 2, 7, 100, 1000):
        for rep in (0, 3):
            cols = [L.permute(np.arange(n), np.full(n, c), rep, n, 11) for c in (0, 1)]
            for image in cols:
                assert sorted(image) == list(range(n))
    assert not np.array_equal(cols[0], cols[1])


def test_loadings_recover_planted_groups(spark):
    cells = long(spark, planted())
    index = P.item_index(cells)
    groups = L.common_factor_groups(L.loadings(L.correlation_cells(cells, (), index), (), 3), index).toPandas()
    truth = groups.item_id.str[1:].astype(int) // 15
    assert pd.crosstab(groups.group_id, truth).max(axis=1).sum() == len(groups)
    # every factor is turned so most of its own items load positive
    assert (groups.groupby("group_id").loading.apply(lambda x: np.sign(x).sum()) >= 0).all()


def test_component_groups_claim_factors_one_to_one(spark):
    cells = long(spark, planted())
    index = P.item_index(cells)
    load = L.loadings(L.correlation_cells(cells, (), index), (), 3, method="pca")
    out = L.component_groups(load, index, k=3).toPandas()
    assert out.groupby("group_id").dominant.nunique().eq(1).all()
    assert out.drop_duplicates("group_id").dominant.is_unique


def test_component_groups_of_many_readings(spark):
    """Each reading on its own, also with a single group."""
    both = long(spark, planted()).withColumn("scorer", F.lit("a")).unionByName(long(spark, planted(n=200, seed=8)).withColumn("scorer", F.lit("b")))
    index = P.item_index(both)
    load = L.loadings(L.correlation_cells(both, ["scorer"], index), ["scorer"], 3, method="pca")
    out = L.component_groups(load, index, ["scorer"]).toPandas()
    for _, one in out.groupby("scorer"):
        truth = one.item_id.str[1:].astype(int) // 15
        assert pd.crosstab(one.group_id, truth).max(axis=1).sum() >= 0.9 * len(one)
    single = L.component_groups(load, index, ["scorer"], k=1).toPandas()
    assert (single.group_id == 0).all() and len(single) == len(out)


def test_a_reading_too_small_does_not_stop_the_others(spark):
    big = long(spark, planted()).withColumn("scorer", F.lit("a"))
    tiny = big.filter("film_id = 0").limit(1).withColumn("scorer", F.lit("z"))
    for method in ("fa", "pca"):
        report, items = L.analyse(big.unionByName(tiny), ["scorer"], n_iter=10, method=method)
        status = {r.scorer: (r.status, r.n_factors) for r in report.collect()}
        assert status["z"] == ("too small", None) and status["a"][0] == "factored"
        assert {r.scorer for r in items.select("scorer").distinct().collect()} == {"a"}


def test_composites_of_one_reading(spark):
    cells = long(spark, planted(n=120, per=6))
    index = P.item_index(cells)
    load = L.loadings(L.correlation_cells(cells, (), index), (), 3)
    out = L.composite_loadings(cells, load, index).toPandas()
    assert set(map(len, out.loadings)) == {2}


def test_split_half_overlap_planted_against_noise(spark):
    rng = np.random.default_rng(5)
    real = L.split_half_overlap(long(spark, planted(n=300)), ks=(3,), reps=4).first()
    noise = L.split_half_overlap(long(spark, rng.choice([-1.0, 1.0], size=(300, 45))), ks=(3,), reps=4).first()
    assert real.overlap > 0.6
    assert noise.overlap < 4 * noise.chance


def test_almost_empty_matrix_reports_no_factors(spark):
    rng = np.random.default_rng(2)
    m = np.zeros((300, 40))
    for row in m:
        row[rng.choice(40, 2, replace=False)] = rng.choice([-1, 1], 2)
    report, _ = L.analyse(long(spark, m).withColumn("scorer", F.lit("s")), ["scorer"], n_iter=10)
    row = report.first()
    assert row.too_sparse and row.n_factors == 0


def test_pairwise_correlation_against_numpy(spark):
    m = planted(n=80, per=4, engaged=0.6)
    got = P.pairwise_correlation(C.centre(long(spark, m))).toPandas()
    eng = m != 0
    cen = np.where(eng, m - (m.sum(1) / np.maximum(eng.sum(1), 1))[:, None], 0)
    cen[np.abs(cen) < 1e-12] = 0
    for row in got.itertuples():
        i, j = int(row.item_i[1:]), int(row.item_j[1:])
        both = (cen[:, i] != 0) & (cen[:, j] != 0)
        assert row.n == both.sum()
        x, y = cen[both, i], cen[both, j]
        want = np.corrcoef(x, y)[0, 1] if row.n >= 8 and x.std() > 1e-6 and y.std() > 1e-6 else 0.0
        assert abs(row.r - want) < 1e-9


def test_renumbered_partition_scores_one(spark):
    rows = [("a", f"i{i}", i % 8) for i in range(200)] + [("b", f"i{i}", (i % 8) + 1) for i in range(200)]
    parts = spark.createDataFrame(rows, "scorer string, item_id string, group_id int")
    row = T.partition_agreement(T.partition_pairs(parts), ["scorer_a", "scorer_b"]).first()
    assert abs(row.ari - 1) < 1e-12 and abs(row.nmi - 1) < 1e-9 and row.raw == 0


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for shape in ((3, 3), (4, 6), (6, 4), (1, 5), (5, 5)):
        for _ in range(20):
            gain = rng.integers(0, 9, shape).astype(float)
            got = sum(gain[i, j] for i, j in T._best_assignment(gain))
            small = gain if shape[0] <= shape[1] else gain.T
            best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
            assert got == best


def test_null_without_variation_has_no_z(spark):
    cells = spark.createDataFrame([(1, "v", f"i{i}", 1.0) for i in range(6)], "film_id int, variant string, item_id string, value double")
    same = spark.createDataFrame([(f"i{i}", 1, 1) for i in range(6)], "item_id string, dim_id int, polarity int")
    row = M.co_engagement_test(cells, same, 20).first()
    assert row.observed == 1.0 and row.z is None and row.n_at_least_observed == 20
