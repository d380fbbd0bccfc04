"""Cases of the third round's findings."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from accordant.functions.hashing import hash_hex
from accordant.operators import agreement as A
from accordant.operators import partitions as T
from accordant.operators import ranking as K
from accordant.plans.registry import load_all


def test_a_ratio_at_the_limit_agrees_in_any_order(spark):
    """distances of 25.5 against 30 over 16 items are 0.85 exactly, in whatever order they are summed."""
    rng, rows = random.Random(1), []
    pairs = [(2 * k, 2 * k + 1) for k in range(60)]
    gaps = {"O": [4 / 3, 5 / 3] * 7 + [2.0, 2.5], "F": [4 / 3, 5 / 3] * 6 + [3.0] * 4}
    for parent, child in pairs:
        for variant, values in gaps.items():
            for k, gap in enumerate(rng.sample(values, len(values))):
                rows += [(parent, variant, f"i{k}", gap), (child, variant, f"i{k}", 0.0)]
    cells = spark.createDataFrame(rows, "film_id long, variant string, item_id string, value double")
    out = A.displacement(cells, spark.createDataFrame(pairs, "parent_id long, child_id long"), summary="O", dialogue="F")
    assert {r.reading for r in out.collect()} == {"agrees"}


def test_neighbours_of_twenty_common_raters_count(spark, tmp_path):
    """Two films with 25 common raters are neighbours, in code and in SQL."""
    rows = [(25 * f + u, u, "purchase" if (u + f) % 3 else "error", f'{{"k": {f}}}') for u in range(25) for f in range(3)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    made.withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    entries = load_all()
    assert entries["neighbour_edges"].run(spark, str(tmp_path)).count() == 6
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(con.execute(entries["neighbour_edges"].sql).fetchall()) == 6
    assert entries["neighbour_scores"].run(spark, str(tmp_path)).count() > 0


def test_every_permutation_is_drawn(spark):
    """mean and spread of the replicates, against shuffling by the same digests."""
    rng = np.random.default_rng(3)
    side = {"x": rng.integers(0, 3, 40), "y": rng.integers(0, 4, 40)}
    items = sorted(f"i{k}" for k in range(40))
    parts = [(i, s, int(side[s][k])) for k, i in enumerate(items) for s in side]
    pairs = T.partition_pairs(spark.createDataFrame(parts, "item_id string, scorer string, group_id int"))

    def index(b):
        two = lambda x: (x * (x - 1) / 2).sum()
        table = np.zeros((3, 4))
        np.add.at(table, (side["x"], b), 1)
        pa, pb = two(table.sum(1)), two(table.sum(0))
        expected = pa * pb / (40 * 39 / 2)
        return (two(table) - expected) / ((pa + pb) / 2 - expected)

    draws = []
    for rep in range(50):
        order = sorted(range(40), key=lambda k: hashlib.md5(f"ari|{rep}|x|y|{items[k]}".encode()).hexdigest())
        draws.append(index(side["y"][order]))
    row = T.agreement_with_permutations(pairs, ["scorer_a", "scorer_b"], 50).first()
    assert row.null_mean == pytest.approx(np.mean(draws)) and row.null_sd == pytest.approx(np.std(draws))
    assert row.ari == pytest.approx(index(side["y"])) and row.exact_sd > 0
    assert "range(500)" in load_all()["partition_agreement_null"].sql


def test_grid_is_dealt_by_pairs_and_windows_do_not_move_it(spark):
    """Tasks are bounded by pairs, and the grid itself is never shuffled."""
    sessions = spark.range(200).withColumnRenamed("id", "session_id")
    films = spark.range(50).withColumnRenamed("id", "film_id")
    grid = K.film_grid(sessions, films, per_task=500)
    assert grid.count() == 200 * 50
    sizes = [r["count"] for r in grid.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000
    w = Window.partitionBy("session_id").orderBy("film_id")
    plan = grid.withColumn("r", F.row_number().over(w))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_limits_leave_deck_and_hash_order_whole(spark):
    """The limited draws are those of all films; with few films and with sessions that need many."""
    films = spark.createDataFrame([(f, 1985 + f % 40 if f % 7 else None) for f in range(700)], "film_id long, year int")
    sessions = spark.range(9).withColumnRenamed("id", "session_id")
    full = sessions.crossJoin(films)
    w = Window.partitionBy("session_id").orderBy(F.desc("k"), "film_id")
    key = F.round(K.gumbel_key(K.recency("year"), "t", ["session_id", "film_id"], 0.3), 10)
    want = full.withColumn("k", key).withColumn("slot", F.row_number().over(w)).filter("slot <= 5")
    cols = ["session_id", "film_id", "slot"]
    got = K.weighted_deck(films, "t", sessions, 0.3, 5)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    w = Window.partitionBy("session_id").orderBy(hash_hex("o", "session_id", "film_id"), "film_id")
    need = sessions.withColumn("need", F.expr("CASE session_id WHEN 0 THEN 0 WHEN 1 THEN 650 WHEN 2 THEN 900 ELSE 6 END").cast("long"))
    want = full.withColumn("position", F.row_number().over(w)).join(need, "session_id").filter("position <= need")
    cols = ["session_id", "film_id", "position"]
    got = K.first_in_hash_order(need, films, "o")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_sampled_ranking_equals_the_grid(spark):
    """noise over all films, without the grid; sessions whose every member has a reference set too."""
    rng = np.random.default_rng(4)
    make = spark.createDataFrame
    users = range(18)
    films = make([(f, int(rng.integers(1985, 2024)) if f % 9 else None) for f in range(300)], "film_id long, year int")
    pos = make([(f, a, float(rng.normal()), 1.0) for f in range(300) for a in range(2) if rng.random() < 0.7],
               "film_id long, factor_id int, position double, mass double")
    base = pos.groupBy("factor_id").agg(F.avg("position").alias("middle"), F.stddev("position").alias("spread"))
    members = make([(u // 3, u) for u in users], "session_id long, user_id long")
    scores = make([(u, a, float(rng.normal())) for u in users for a in range(2)], "user_id long, factor_id int, score double")
    cf = make([(u, int(f), float(rng.normal())) for u in users if u % 4 for f in rng.choice(300, 8, replace=False)],
              "user_id long, film_id long, score double")
    seen = make([(u, int(f)) for u in users for f in rng.choice(300, 5, replace=False)], "user_id long, film_id long")
    picks = make([(u, 0.3 if u % 2 else 0.9, f"s{u % 2}") for u in users if u >= 9], "user_id long, weight double, set_id string")
    cents = make([(f"s{s}", a, float(rng.normal())) for s in range(2) for a in range(2 - s)], "set_id string, factor_id int, centroid double")
    cols = ["session_id", "film_id", "year", "agreement", "mean_alignment", "moral_agreement", "members", "note_axis", "rank"]
    want = K.session_ranking(members, films, scores, pos, base, cf, seen, picks.join(cents, "set_id").drop("set_id"), variation=0.05)
    got = K.sampled_ranking(members, films, scores, pos, base, cf, seen, picks, cents)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert want.count() == 6 * 6


def test_alignment_of_a_grid_is_not_grouped(spark):
    """as the grouped parts give it; with axes that a film or a person lacks."""
    rng = np.random.default_rng(6)
    make = spark.createDataFrame
    pos = make([(f, a, float(rng.normal()), float(rng.random() + 0.2)) for f in range(40) for a in range(3) if rng.random() < 0.5],
               "film_id long, factor_id int, position double, mass double")
    base = pos.groupBy("factor_id").agg(F.avg("position").alias("middle"), F.stddev("position").alias("spread"))
    scores = make([(u, a, float(rng.normal()) if u else 0.0) for u in range(15) for a in range(3) if rng.random() < 0.6 or not u],
                  "user_id long, factor_id int, score double")
    every = scores.crossJoin(pos.select("film_id").distinct())
    want = {(r.user_id, r.film_id): r.alignment for r in K.alignment(K.alignment_parts(every, pos, base, ["user_id"]), ["user_id"]).collect()}
    made = K.alignment_grid(scores, pos, base)
    got = {(r.user_id, r.film_id): r.alignment for r in made.collect()}
    assert got == pytest.approx(want) and len(want) > 300
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
