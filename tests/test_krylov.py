"""Leading vectors from rating rows against dense solves."""

import numpy as np
import pytest

from accordant.operators import krylov, pairs, solvers, taste


def rows_of(spark, x):
    held = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x]
    return spark.createDataFrame(held, "idx array<int>, val array<double>").repartition(3)


def test_vectors_equal_the_dense_solve(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 150)) * (rng.random((300, 150)) < 0.4)
    shift, ridge = rng.normal(size=150) / 5, rng.random(150)
    found = krylov.leading(rows_of(spark, x), 150, 24, shift=shift, ridge=ridge, strip=64)
    w, v = np.linalg.eigh(x.T @ x - np.outer(shift, shift) - np.diag(ridge))
    got = np.array([r.vector for r in found.vectors.orderBy("i").collect()])
    assert np.abs(found.values - w[::-1][:24]).max() < 1e-8 * w[-1]
    assert np.abs(np.abs(got) - np.abs(v[:, ::-1][:, :24])).max() < 1e-8


def test_slices_and_ranks_below_the_block(spark, monkeypatch):
    """Few items at a time are sent, and a matrix of rank two ends early."""
    monkeypatch.setattr(krylov, "SLICE_BYTES", 8 * 30 * 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 30))
    found = krylov.leading(rows_of(spark, x), 30, 5, strip=8)
    w = np.linalg.eigvalsh(x.T @ x)[::-1][:5]
    assert np.allclose(found.values, w, atol=1e-8 * w[0])


def test_twenty_thousand_items(spark):
    """Planted groups of items that users rate alike: every vector stays in its group."""
    rng = np.random.default_rng(2)
    group = np.arange(20_000) % 24
    b = rng.normal(size=20_000)
    held = []
    for u in range(24 * 30):
        at = np.sort(rng.choice(np.flatnonzero(group == u % 24), 400, replace=False))
        held.append((at.tolist(), (b[at] * (30 - u % 24) + rng.normal(size=400) / 10).tolist()))
    df = spark.createDataFrame(held, "idx array<int>, val array<double>").repartition(4)
    found = krylov.leading(df, 20_000, 24, tolerance=1e-3)
    got = np.array([r.vector for r in found.vectors.orderBy("i").collect()])
    assert got.shape == (20_000, 24) and (np.diff(found.values) < 0).all()
    share = np.array([np.bincount(group, np.square(got[:, k]), 24).max() for k in range(24)])
    assert (share > 0.9).all()


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(3)
    score = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 20)) + rng.normal(size=(200, 20)) / 2
    rows = [(u, f"i{i:02d}", float(score[u, i])) for u in range(200) for i in range(20) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "user_id long, item_id string, centred double")


def matrix(df):
    rows = df.collect()
    x = np.zeros((200, 20))
    for r in rows:
        x[r.user_id, int(r.item_id[1:])] = r.centred
    return x


def test_components_equal_the_singular_vectors(ratings):
    got = np.array([r.loadings for r in taste.taste_components(ratings, 3).orderBy("item_id").collect()])
    _, s, vt = np.linalg.svd(matrix(ratings), full_matrices=False)
    assert np.abs(np.abs(got) - np.abs(vt[:3].T * s[:3])).max() < 1e-8 * s[0]


def test_wide_factors_equal_the_dense_ones(ratings):
    x = matrix(ratings)
    r = np.corrcoef(x.T)
    start = solvers.multiple_correlations(r)
    got = np.array([row.loadings for row in taste.wide_factors(ratings, 2, start).orderBy("item_id").collect()])
    load = solvers.promax(solvers.principal_axes(r, 2))[0]
    load = load[:, np.argsort(-np.square(load).sum(axis=0))]
    assert np.abs(np.abs(got) - np.abs(load)).max() < 1e-6
    assert pairs.item_index(ratings).count() == 20
