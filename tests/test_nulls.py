"""Chance agreement and label tests against plain shuffling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import partitions as T
from accordant.operators import permutation as M
from accordant.operators import ranking as K


def rand_index(a, b):
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    two = lambda x: (x * (x - 1) / 2).sum()
    n = len(a)
    expected = two(table.sum(1)) * two(table.sum(0)) / (n * (n - 1) / 2)
    return (two(table) - expected) / ((two(table.sum(1)) + two(table.sum(0))) / 2 - expected)


def test_moments_and_draws_equal_shuffling(spark):
    rng = np.random.default_rng(0)
    a, b = rng.choice(4, 60, p=[0.4, 0.3, 0.2, 0.1]), rng.integers(0, 3, 60)
    parts = [(f"i{k}", "x", int(v)) for k, v in enumerate(a)] + [(f"i{k}", "y", int(v)) for k, v in enumerate(b)]
    pairs = T.partition_pairs(spark.createDataFrame(parts, "item_id string, scorer string, group_id int"))
    keys = ["scorer_a", "scorer_b"]
    shuffled = np.array([rand_index(a, rng.permutation(b)) for _ in range(20_000)])
    row = T.agreement_with_null(pairs, keys).first()
    assert row.ari == pytest.approx(rand_index(a, b)) and row.null_sd == pytest.approx(shuffled.std(), rel=0.03)
    assert abs(shuffled.mean()) < 4 * row.null_sd / len(shuffled) ** 0.5
    drawn = T.agreement_draws(pairs, keys, 4000).first()
    assert drawn.permutations == 4000 and abs(drawn.null_mean) < 4 * row.null_sd / 4000**0.5
    assert drawn.null_sd == pytest.approx(row.null_sd, rel=0.06)
    assert drawn.n_at_least_observed / 4000 == pytest.approx((shuffled >= row.ari - 1e-12).mean(), abs=0.03)


def test_too_few_items_have_no_spread(spark):
    parts = [(f"i{k}", s, k % 2) for k in range(3) for s in "xy"]
    pairs = T.partition_pairs(spark.createDataFrame(parts, "item_id string, scorer string, group_id int"))
    assert T.agreement_with_null(pairs, ["scorer_a", "scorer_b"]).first().null_sd is None


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_images_are_bijections_of_their_own(n):
    seen = [tuple(M.image(np.arange(n), rep, n, 3)) for rep in range(20)]
    assert all(sorted(x) == list(range(n)) for x in seen)
    assert n < 5 or len(set(seen)) > 15


def test_images_are_uniform():
    where = np.array([M.image(np.arange(10), rep, 10, 7) for rep in range(4000)])
    counts = np.array([np.bincount(where[:, k], minlength=10) for k in range(10)])
    assert np.abs(counts - 400).max() < 5 * 19
    both = np.bincount(where[:, 2] * 10 + where[:, 7], minlength=100)[~np.eye(10, dtype=bool).ravel()]
    assert np.abs(both - 4000 / 90).max() < 5.5 * (4000 / 90) ** 0.5


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    rows = [(f, "v", f"i{i:02d}", float(rng.normal() + (i % 4 == f % 4))) for f in range(40) for i in range(24) if rng.random() < (0.8 if i % 4 == f % 4 else 0.2)]
    cells = spark.createDataFrame(rows, "film_id long, variant string, item_id string, value double")
    axes = spark.createDataFrame([(f"i{i:02d}", i % 4, 1) for i in range(24)], "item_id string, dim_id int, polarity int")
    return rows, cells, axes


def test_label_tests_equal_scoring_each_replicate(planted):
    rows, cells, axes = planted
    n = 30
    items = sorted((i % 4, f"i{i:02d}") for i in range(24))
    ends = np.cumsum(np.bincount([d for d, _ in items]))
    packets = {}
    for f, _, item, value in rows:
        packets.setdefault(f, {})[[x for _, x in items].index(item)] = value

    def stats(seed, fn):
        return np.array([fn(M.labels_of(np.arange(24), rep, ends, seed)) for rep in range(-1, n)])

    def together(label):
        pairs = [(label[i] == label[j]) for p in packets.values() for i in p for j in p if i < j]
        return np.mean(pairs)

    def coherent(label):
        out = []
        for p in packets.values():
            for d in range(4):
                held = [v for i, v in p.items() if label[i] == d]
                if len(held) >= 3:
                    out.append(abs(sum(held)) / len(held))
        return np.mean(out)

    for test, fn, seed in ((M.co_engagement_test, together, 3), (M.coherence_test, coherent, 4)):
        got, want = test(cells, axes, n, seed).first(), stats(seed, fn)
        assert got.observed == pytest.approx(want[0]) and got.null_mean == pytest.approx(want[1:].mean())
        assert got.null_sd == pytest.approx(want[1:].std()) and got.n_at_least_observed == (want[1:] >= want[0] - 1e-12).sum()


def test_threshold_ranking_equals_the_grid(spark):
    """Ties of recency, empty neighbour lists, weights of zero, sets that say nothing of a film."""
    rng = np.random.default_rng(9)
    films = [(f, int(rng.integers(1985, 2024)) if f % 9 else None) for f in range(150)]
    positions = [(f, a, float(rng.normal()), float(rng.random() + 0.2)) for f in range(150) for a in range(3) if rng.random() < 0.7]
    users = range(40)
    members = [(u // 3, u) for u in users]
    scores = [(u, a, float(rng.normal())) for u in users for a in range(3)]
    cf = [(u, int(f), float(rng.normal())) for u in users if u % 4 for f in rng.choice(150, 12, replace=False)]
    seen = [(u, int(f)) for u in users for f in rng.choice(150, 5, replace=False)]
    chosen = [(u, float(rng.choice([0.0, 0.3, 0.9])), f"s{u % 3}") for u in users if u % 2]
    cents = [(f"s{s}", a, float(rng.normal())) for s in range(3) for a in range(3 if s else 1)]
    make = spark.createDataFrame
    m, f = make(members, "session_id long, user_id long"), make(films, "film_id long, year int")
    s = make(scores, "user_id long, factor_id int, score double")
    p = make(positions, "film_id long, factor_id int, position double, mass double")
    base = p.groupBy("factor_id").agg(F.avg("position").alias("middle"), F.stddev("position").alias("spread"))
    near, watched = make(cf, "user_id long, film_id long, score double"), make(seen, "user_id long, film_id long")
    picks, c = make(chosen, "user_id long, weight double, set_id string"), make(cents, "set_id string, factor_id int, centroid double")
    columns = ["session_id", "film_id", "year", "agreement", "mean_alignment", "moral_agreement", "members", "note_axis", "rank"]
    grid = K.session_ranking(m, f, s, p, base, near, watched, picks.join(c, "set_id").drop("set_id"))
    want = sorted(map(tuple, grid.select(*columns).collect()))
    got = K.threshold_ranking(m, f, s, p, base, near, watched, picks, c, depth=8)
    assert sorted(map(tuple, got.select(*columns).collect())) == want and len(want) == 14 * 6
