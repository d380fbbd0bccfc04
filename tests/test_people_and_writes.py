"""Hand arithmetic for people and groups, keyed writes, streams, ridge, files."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordant.operators import persons as H
from accordant.operators import ranking as K
from accordant.operators import taste as T
from accordant.sources import catalog, readers, writers
from accordant.streaming import reactions as R

T0 = datetime(2024, 1, 1)


def reactions(spark, rows):
    data = [(i, u, f, r, T0 + timedelta(minutes=m)) for i, (u, f, r, m) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id bigint, user_id bigint, film_id bigint, reaction string, submitted_at timestamp")


def test_unseen_never_masks_an_answer(spark):
    df = reactions(spark, [(1, 10, "loved_it", 0), (1, 10, "havent_seen", 5), (1, 11, "liked_it", 0), (1, 11, "hated_it", 9), (2, 10, "havent_seen", 1)])
    got = {(r.user_id, r.film_id): r.weight for r in H.rating_preferences(df).collect()}
    assert got == {(1, 10): 1.0, (1, 11): -1.0}


def test_shrinkage_and_missing_axes(spark):
    pos = spark.createDataFrame([(1, 0, 1.0, 12, 12.0)], "film_id bigint, factor_id int, position double, n_items int, mass double")
    prefs = spark.createDataFrame([(7, 1, 1.0)], "user_id bigint, film_id bigint, weight double")
    axes = spark.createDataFrame([(0,), (1,)], "factor_id int")
    out = {r.factor_id: r for r in H.person_scores(prefs, pos, None, axes).collect()}
    assert out[0].score == pytest.approx(12 / 20) and out[0].leaning == "high"
    assert out[1].score == 0 and out[1].confidence == 0 and out[1].films == 0


def test_contributions_sum_to_the_position(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(f, f"i{i}", float(rng.choice([-2, -1, 1, 2]))) for f in range(4) for i in range(6)], "film_id int, item_id string, value double")
    items = spark.createDataFrame([(f"i{i}", i % 2, 0.5, None if i == 5 else [float(x) for x in rng.uniform(-1, 1, 2)]) for i in range(6)],
                                  "item_id string, factor_id int, loading double, loadings array<double>")
    load = H.axis_loadings(items)
    pos = H.film_positions(cells, load).toPandas().set_index(["film_id", "factor_id"]).position
    parts = H.contributions(cells, load).groupBy("film_id", "factor_id").agg(F.sum("contribution").alias("s")).toPandas()
    assert len(parts) == len(pos)
    for r in parts.itertuples():
        assert r.s == pytest.approx(pos[(r.film_id, r.factor_id)])


def test_worst_member_decides_and_weight_zero_is_own(spark):
    row = spark.range(1).select(
        K.blend(F.lit(0.3), F.lit(0.9), F.lit(0.0)).alias("a"), K.blend(F.lit(0.3), F.lit(None).cast("double"), F.lit(0.5)).alias("b"),
        K.blend(F.lit(0.2), F.lit(0.6), F.lit(0.5)).alias("c"), K.recency(F.lit(None).cast("int")).alias("d"), K.recency(F.lit(2001)).alias("e")).first()
    assert (row.a, row.b, row.d) == (0.3, 0.3, 0.0) and row.c == pytest.approx(0.4) and row.e == pytest.approx(0.5)


def test_product_axis_order(spark):
    f = spark.createDataFrame([("s", i, f"n{i}", m, 1.0, 5, None) for i, m in ((1, .5), (2, .4), (3, .3), (4, .2))],
                              "scorer string, factor_id int, name string, margin double, eigenvalue double, n_items int, coherent boolean")
    verdict = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("s", 4, True)], "scorer string, factor_id int, places boolean")
    got = [r.factor_id for r in K.product_axes(f, verdict, ["scorer"], limit=4).orderBy("position").collect()]
    assert got == [1, 3, 4, 2]


def test_streams_agree_with_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    kinds = list(H.REACTION_WEIGHTS)
    rows = [(int(rng.integers(4)), int(rng.integers(5)), kinds[rng.integers(5)], int(rng.integers(500))) for _ in range(200)]
    df = reactions(spark, rows).withColumn("session_id", F.col("user_id") % 2)
    votes = df.filter("reaction <> 'havent_seen'").withColumn("reaction", F.when(F.col("reaction").isin("loved_it", "liked_it", "not_for_me"), "yes").otherwise("no"))
    members = votes.select("session_id", "user_id").distinct()
    for step in range(3):  # three batches arriving one after another
        df.filter(F.col("event_id") % 3 == step).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        votes.filter(F.col("event_id") % 3 == step).coalesce(1).write.mode("append").parquet(str(tmp_path / "votes"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        R.run_current_preferences(source, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        live = spark.readStream.schema(votes.schema).parquet(str(tmp_path / "votes"))
        R.run_agreed_films(live, members, str(tmp_path / "agreed"), str(tmp_path / "log2"), "1 day").awaitTermination()
    cols = ["user_id", "film_id", "weight", "detail"]
    want = sorted(map(tuple, R.current_preferences(df).select(*cols).collect()))
    assert sorted(map(tuple, R.read_current(spark, str(tmp_path / "out")).select(*cols).collect())) == want
    first = votes.groupBy("session_id", "user_id", "film_id").agg(F.min_by(F.struct("reaction", "submitted_at"), F.struct("submitted_at", "event_id")).alias("v")).select(
        "session_id", "user_id", "film_id", "v.*")
    batch = sorted((r.session_id, r.film_id) for r in K.agreed_films(first, members).collect())
    assert sorted((r.session_id, r.film_id) for r in R.read_agreed(spark, str(tmp_path / "agreed")).collect()) == batch


def test_keyed_writes(spark, tmp_path):
    with pytest.raises(KeyError):
        catalog.spec("nope")
    spec = catalog.spec("verdicts")
    row = lambda scorer, item, value: ("f", item, "r", value, 1.0, "e", None, None, "b1", scorer, "subs")
    a = spark.createDataFrame([row("x", "i1", 1), row("x", "i2", -1), row("y", "i1", 2)], spec.schema)
    path = str(tmp_path / "verdicts")
    writers.write_partitions(a, path, spec)
    writers.write_partitions(spark.createDataFrame([row("x", "i3", 2)], spec.schema), path, spec)
    back = catalog.read_table(spark, str(tmp_path), "verdicts")
    assert sorted((r.scorer, r.item_id) for r in back.collect()) == [("x", "i3"), ("y", "i1")]
    plan = back.filter("scorer = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scorer" in plan


def test_seed_collision_and_user_counts_fail_loudly(spark):
    films = spark.createDataFrame([("up-2009", "Another", 2009, "d")], "film_id string, title string, year int, description string")
    with pytest.raises(Exception, match="refusing to replace"):
        writers.seed_sync(films, spark.createDataFrame([("Up", 2009, "x")], "title string, year int, description string")).collect()
    with pytest.raises(Exception, match="user table changed"):
        writers.counts_unchanged({"votes": films}, {"votes": films.limit(0)}).collect()


def test_ratings_and_genome_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.5,0\n1,11,2.0,0\n2,12,5.0,0\n")
    (tmp_path / "t.csv").write_text("tagId,tag\n1,masterpiece\n2,bad plot\n")
    (tmp_path / "s.csv").write_text("movieId,tagId,relevance\n10,1,0.9\n10,2,0.1\n11,1,0.5\n")
    films = spark.createDataFrame([("a", "tt0000114"), ("b", "nm1"), ("c", "tt0000115"), ("d", "tt115")], "film_id string, imdb_id string")
    links = readers.film_links(films, spark.createDataFrame([(10, "0114"), (11, "0000115")], "movieId int, imdbId string"))
    assert {r.movie_id: r.film_id for r in links.collect()} == {10: "a", 11: "d"}
    got = readers.read_ratings(spark, str(tmp_path / "r.csv"), links).toPandas()
    assert sorted(got.movie_id) == [10, 11]
    tags, scores = readers.read_genome(spark, str(tmp_path / "t.csv"), str(tmp_path / "s.csv"))
    assert {r.item_id for r in T.complete_genome(scores, tags).collect()} == {10}


def test_bundle_and_index(spark, tmp_path):
    films = spark.createDataFrame([("a", "A")], "film_id string, title string")
    writers.write_bundle({"films": films}, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b/manifest")).first().value == 1.0


def test_unknown_anchor_fails_and_known_one_turns(spark):
    load = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [-0.5, 2.0])], "item_id string, loadings array<double>")
    corr = spark.createDataFrame([(0, "masterpiece", -0.6), (1, "masterpiece", 0.4)], "dim int, tag string, r double")
    turned, flips = T.orient(load, corr, spark.createDataFrame([(0, "masterpiece")], "dim int, anchor string"))
    assert {r.item_id: r.loadings for r in turned.collect()} == {"a": [-0.5, 1.0], "b": [0.5, 2.0]} and flips.first().flipped
    with pytest.raises(Exception, match="unknown anchor"):
        T.orient(load, corr, spark.createDataFrame([(0, "none")], "dim int, anchor string"))[0].collect()


def _taste(spark, x):
    return spark.createDataFrame([(i, d, float(x[i, d])) for i in range(len(x)) for d in range(x.shape[1])], "film_id bigint, dim_id int, position double")


def test_ridge_residuals_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3))
    y = rng.choice([-1.0, -0.5, 0.5, 1.0], size=(60, 2))
    y[np.abs(y) < 0.1] = 0.5
    cells = spark.createDataFrame([(i, f"i{j}", float(y[i, j])) for i in range(60) for j in range(2)], "film_id bigint, item_id string, value double")
    got = T.residual_cells(cells, _taste(spark, x)).toPandas()
    z = (x - x.mean(0)) / x.std(0)
    for j in range(2):
        zc, yc = z - z.mean(0), y[:, j] - y[:, j].mean()
        want = yc - zc @ np.linalg.solve(zc.T @ zc + np.eye(3), zc.T @ yc)
        mine = got[got.item_id == f"i{j}"].sort_values("film_id").value.to_numpy()
        assert np.allclose(mine, want)


def test_cross_validated_adjustment_explains_a_planted_share(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 3))
    y = np.stack([x @ [0.5, -0.3, 0.2] + 0.1 * rng.standard_normal(150), rng.standard_normal(150)], axis=1)
    pos = spark.createDataFrame([(i, a, float(y[i, a])) for i in range(150) for a in range(2)], "film_id bigint, factor_id int, position double")
    out = T.adjusted_positions(pos, _taste(spark, x)).toPandas()
    share = out.groupby("factor_id").taste_explained.first()
    assert share[0] > 0.9 and share[1] < 0.1 and len(out) == 300


def test_taste_dimensions_replicate(spark):
    rng = np.random.default_rng(5)
    u, v = rng.standard_normal((400, 2)), rng.standard_normal((20, 2))
    stars = np.clip(3 + u @ v.T + 0.5 * rng.standard_normal((400, 20)), 0.5, 5)
    rated = rng.random(stars.shape) < 0.8
    pdf = pd.DataFrame([(int(i), f"m{j:02d}", float(stars[i, j])) for i, j in zip(*np.nonzero(rated))], columns=["user_id", "item_id", "stars"])
    load, rep = T.extract(spark.createDataFrame(pdf), 2)
    assert rep.filter("replicates").count() == 2 and load.count() == 20
