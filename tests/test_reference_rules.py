"""Cases that once came out differently from the rules they restate."""

import numpy as np
from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.operators import clustering, factors, selection, solvers, tracks


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_accented_names_stay_whole(spark):
    assert one(spark, "They met Amélie and Zoë there.", X.proper_nouns) == ["Amélie", "Zoë"]


def test_white_space_of_any_kind_is_stripped(spark):
    assert one(spark, "\n\tHello  there\n", X.normalise) == "hello there"
    ev = spark.createDataFrame([(1, "plot", "\n \t\n"), (1, "themes", "\nsome words\t")], "film_id long, layer string, content string")
    got = {r.film_id: r for r in tracks.evidence_index(ev).collect()}
    assert 1 in got


def test_lists_count_value_by_value(spark):
    films = spark.createDataFrame([(1, ["US", "GB"], 1999), (2, ["GB"], 0)], "film_id long, country array<string>, year int")
    got = sorted(map(tuple, selection.facets(films).collect()))
    assert got == [(1, "country", "GB"), (1, "country", "US"), (1, "decade", "1990s"), (2, "country", "GB")]


def test_a_text_that_opens_with_a_heading_has_an_empty_lead(spark):
    docs = spark.createDataFrame([(1, "== Plot ==\nThings happen."), (2, "Before.\n== Plot ==\nAfter.")], "doc_id long, text string")
    got = {(r.doc_id, r.section): (r.path, r.body) for r in tracks.split_sections(docs).collect()}
    assert got == {
        (1, 0): (["__lead__"], ""), (1, 1): (["plot"], "Things happen."),
        (2, 0): (["__lead__"], "Before."), (2, 1): (["plot"], "After."),
    }


def test_copies_without_a_usable_word_stay_apart(spark):
    rows = [(1, "f", "the of"), (2, "f", "the of"), (3, "f", "rivers carve valleys"), (4, "f", "rivers carve valleys")]
    props = spark.createDataFrame(rows, "prop_id long, film_id string, text string")
    got = {r.prop_id: r.cluster_id for r in clustering.cluster_statements(props).collect()}
    assert got[1] != got[2] and got[3] == got[4]


def test_silence_is_no_evidence_for_composites(spark):
    """Rows that say nothing change no composite."""
    rng = np.random.default_rng(1)
    cells = [(int(f), f"i{i}", float(v)) for f in range(60) for i in range(8) if (v := rng.choice([-1.0, -0.5, 0.5, 1.0, 0.0])) != 0.0]
    silent = [(f, f"i{i}", 0.0) for f in range(60) for i in range(8) if (f, f"i{i}") not in {c[:2] for c in cells}]
    load = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)]) for i in range(8)], "i int, loadings array<double>")
    index = spark.createDataFrame([(f"i{i}", i) for i in range(8)], "item_id string, _idx int")
    schema = "film_id long, item_id string, value double"
    results = []
    for rows in (cells, cells + silent):
        got = factors.composite_loadings(spark.createDataFrame(rows, schema), load, index).collect()
        results.append(np.abs([r.loadings for r in sorted(got, key=lambda r: r.i)]))
    assert np.allclose(*results)


def planted(seed, p=36, k=3, n=2500):
    rng = np.random.default_rng(seed)
    home = np.arange(p) % k
    load = np.zeros((p, k))
    load[np.arange(p), home] = rng.choice([-0.7, 0.7], p)
    x = rng.normal(size=(n, k)) @ load.T + rng.normal(size=(n, p)) * np.sqrt(1 - 0.49)
    return np.corrcoef(x.T), home


def test_solvers_recover_planted_factors():
    for seed in range(4):
        r, home = planted(seed)
        pattern, phi = solvers.promax(solvers.principal_axes(r, 3))
        found = np.abs(pattern).argmax(axis=1)
        assert len({(a, b) for a, b in zip(home, found, strict=True)}) == 3
        assert np.allclose(np.diag(phi), 1) and np.abs(phi - np.eye(3)).max() < 0.2


def test_principal_axes_settle_on_their_own_communalities():
    r, _ = planted(9)
    load = solvers.principal_axes(r, 3)
    again = solvers.scaled_vectors(solvers.with_diagonal(r, np.square(load).sum(axis=1)), 3)
    assert np.abs(np.abs(again) - np.abs(load)).max() < 1e-3


def test_varimax_keeps_communalities_and_raises_its_criterion():
    rng = np.random.default_rng(3)
    load = rng.normal(size=(30, 4))
    turned = solvers.varimax(load)
    assert np.allclose(np.square(load).sum(axis=1), np.square(turned).sum(axis=1))
    criterion = lambda m: np.square(m).var(axis=0).sum()
    best = criterion(turned)
    assert best > criterion(load)
    for _ in range(200):  # no small rotation does better
        q = np.linalg.qr(np.eye(4) + 0.02 * rng.normal(size=(4, 4)))[0]
        assert criterion(turned @ (q * np.sign(np.diag(q)))) <= best + 1e-9


def test_multiple_correlations_equal_regressions():
    r, _ = planted(5, p=10)
    inverse = np.linalg.inv(r)
    assert np.allclose(solvers.multiple_correlations(r), np.clip(1 - 1 / np.diag(inverse), 0.05, 0.95))
    r[0, :] = r[:, 0] = 0
    r[0, 0] = 1
    assert np.isfinite(solvers.multiple_correlations(r)).all()


def test_taste_has_the_dimensions_of_the_reference(spark):
    from accordant.plans.registry import load_all

    for name in ("taste_factors", "taste_components"):
        rows = load_all()[name].run(spark, "/root/testdata/sf0.001").select("loadings").collect()
        assert {len(r.loadings) for r in rows} == {min(24, len(rows))}, name
