"""Pair sums in tiles against numpy."""

import numpy as np

from accordant.operators import pairs


def brute(cells):
    by = {}
    for e, i, v in cells:
        by.setdefault(e, {})[i] = v
    out = {}
    for held in by.values():
        items = sorted(held)
        for a, x in enumerate(items):
            for y in items[a + 1 :]:
                u, v = held[x], held[y]
                out.setdefault((x, y), []).append((1, u, v, u * u, v * v, u * v))
    return {k: np.sum(v, axis=0) for k, v in out.items()}


def test_tiles_of_any_size_agree(spark):
    rng = np.random.default_rng(0)
    cells = [(int(e), f"i{i:03d}", float(rng.normal())) for e in range(40) for i in rng.choice(60, rng.integers(0, 30), replace=False)]
    df = spark.createDataFrame(cells, "film_id long, item_id string, value double")
    want = brute(cells)
    index = pairs.item_index(df)
    packed = pairs.pack_rows(df, index, (), "film_id", "item_id", "value")
    for tile in (7, 32, 1024):
        sums = pairs.name_pairs(pairs.packed_sums(packed, (), tile), index).collect()
        got = {(r.item_i, r.item_j): np.array([r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy]) for r in sums}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_more_items_than_any_dense_matrix_takes(spark):
    """Six thousand items; the numbering and the sums have no cap."""
    cells = [(e, f"i{i:05d}", 1.0) for e in range(3) for i in range(e, 6000, 3)] + [(9, f"i{i:05d}", 2.0) for i in (0, 1, 5998, 5999)]
    df = spark.createDataFrame(cells, "film_id long, item_id string, value double").repartition(4)
    index = pairs.item_index(df)
    assert sorted((r.item_id, r._idx) for r in index.collect()) == [(f"i{i:05d}", i) for i in range(6000)]
    few = df.filter("film_id = 9 or item_id < 'i00010'")
    got = {(r.item_i, r.item_j): r.n for r in pairs.pair_sums(few).collect()}
    assert got["i00000", "i05999"] == 1 and got["i00000", "i00003"] == 1 and ("i00000", "i00001") in got


def test_nearest_items_equal_ranking_all_pairs(spark):
    """In one tile and in many, with the pair table as the plain way."""
    rng = np.random.default_rng(1)
    cells = [(int(e), f"i{i:03d}", float(rng.normal())) for e in range(60) for i in rng.choice(50, rng.integers(5, 40), replace=False)]
    df = spark.createDataFrame(cells, "user_id long, item_id string, centred double").repartition(3)
    plain = pairs.top_neighbours(pairs.cosine_similarity(df, min_support=8), 7)
    want = sorted((r.src, r["rank"], r.dst, r.support, round(r.similarity, 9)) for r in plain.collect())
    for tile in (9, 64, 1024):
        got = pairs.nearest_items(df, min_support=8, top_k=7, tile=tile).collect()
        assert sorted((r.src, r["rank"], r.dst, r.support, round(r.similarity, 9)) for r in got) == want
    assert len(want) > 200
