"""Cases of the third round's findings that were open after it."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from accordant.functions.hashing import hash_hex
from accordant.functions import text as X
from accordant.operators import agreement as A
from accordant.operators import clustering as K
from accordant.operators import factors as L
from accordant.operators import persons as H
from accordant.operators import taste as T
from accordant.session import scratch


def test_rounds_leave_one_written_table_and_send_no_vector_with_a_term(spark):
    """a round's tables go with it, and terms meet as narrow rows."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 6)) for _ in range(60)]
    texts += [f"{t} extra" for t in texts[:30]]
    long = K.tfidf(spark.createDataFrame(list(enumerate(texts)), "doc long, text string"))
    vec = long.groupBy(F.col("doc").alias("id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("df").alias("o"), F.col("term").alias("t"), "v"))).alias("vec")).select(
        "id", F.lit(0).alias("block"), F.lit(1).cast("bigint").alias("size"), "vec")
    vec = K.cut_lineage(vec)
    floor = 1 - K.CUT
    found = {r.cid: r.partner for r in K._sparse_nearest(vec.withColumnRenamed("id", "cid"), floor).collect()}
    own = {r.id: {e.t: e.v for e in r.vec} for r in vec.collect()}
    best = {}
    for a in own:
        near = [(round(sum(v * own[b].get(t, 0.0) for t, v in own[a].items()), 9), -min(a, b), -max(a, b), b) for b in own if b != a]
        if max(near)[0] > floor:
            best[a] = max(near)[3]
    assert found == best and len(best) >= 30
    before = scratch()
    K.average_linkage(vec).count()
    assert len(scratch()) - len(before) <= 1


def test_dealt_ratings_are_ranked_as_by_a_window(spark):
    """every draw's rating of rank r goes to the rater of seat r, over many splits."""
    rows = [(u, f, 1.0 if (u + f) % 2 else -0.5) for u in range(40) for f in range(u % 7 + 3)]
    seat = F.row_number().over(Window.orderBy(hash_hex("seat", "user_id", "film_id"))).cast("bigint")
    pool = spark.createDataFrame(rows, "user_id long, film_id long, weight double").withColumn("seat", seat).cache()
    draws = 5
    order = Window.partitionBy("draw").orderBy(hash_hex("7", "draw", "user_id", "film_id"))
    ranked = pool.select("film_id", "user_id", "weight", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn(
        "seat", F.row_number().over(order).cast("bigint")).drop("user_id")
    want = ranked.join(pool.select("seat", "user_id"), "seat").select("draw", "user_id", "film_id", "weight")
    small, T._DEALT_ROWS = T._DEALT_ROWS, 20
    try:
        got = T._dealt(pool, draws, "7")
        assert got.count() == draws * len(rows)
        assert got.exceptAll(want).isEmpty()
    finally:
        T._DEALT_ROWS = small


def test_a_sentence_is_stripped_once(spark):
    """no rule works the stripped sentence out anew."""
    rows = [(" Never Finally a Man in the end , walked home. ", "walked, Home alone"), ("", "x"), (" \t", None), (None, "walked home")]
    df = spark.createDataFrame(rows, "s string, t string")
    out = df.select(X.house_style_problems(F.col("s"), F.col("t")).alias("p"))
    assert [r.p for r in out.collect()] == [
        ["too_short", "names", "title_words", "verdict_words"], ["empty"], ["empty"], ["too_short"]]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(s#") == 1


def test_dividing_clusters_reads_texts_once(spark):
    """sizes, members and the largest id come from texts that were read once."""
    rows = [(k, f"f{k % 2}", ["never again", "must go", "a walk"][k % 3], k // 4) for k in range(12)]
    out = K.split_inverted(spark.createDataFrame(rows, "prop_id long, film_id string, text string, cluster_id long"))
    assert "regexp_replace" not in out._jdf.queryExecution().analyzed().toString()
    got = {r.prop_id: r for r in out.collect()}
    assert [got[k].polarity for k in range(3)] == ["negated", "obliged", "plain"]
    assert [got[k].split_from for k in range(4)] == [None, 0, 0, None]


def _mixed_images(position, column, rep, n, seed):
    """The bijection by its definition, a cell at a time."""
    m64 = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m64
        return x ^ (x >> 33)

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    out = []
    for x, c in zip(position.tolist(), column.tolist()):
        key = mix((c * 0x2545F4914F6CDD1D + seed * 0x9E3779B97F4A7C15 + (rep + 1) * 0xD1B54A32D192ED03) & m64)
        while True:
            left, right = x >> half, x & mask
            for step in range(4):
                left, right = right, left ^ (mix((right + key + step * 0x51ED27) & m64) & mask)
            x = (left << half) | right
            if x < n:
                break
        out.append(x)
    return np.array(out)


def test_images_by_tables_are_those_of_the_bijection():
    """the rounds of a column are looked up, and give what they gave."""
    for n in (1, 7, 1000):
        position, column = np.tile(np.arange(n), 3), np.repeat([0, 5, 149], n)
        assert np.array_equal(L.permute(position, column, 3, n, 11), _mixed_images(position, column, 3, n, 11))


def test_replicates_read_a_readings_cells_once_for_many(spark, monkeypatch):
    """Cells are not sent once a replicate; strata are permuted within themselves
    and their sums make whole spectra."""
    rng = np.random.default_rng(8)
    score = rng.standard_normal((90, 1))
    raw = np.where(rng.random((90, 12)) < 0.8, np.sign(score * np.repeat([1, -1], 6) + 0.4 * rng.standard_normal((90, 12))), 0.0)
    rows = [("s", f, f"i{i:02d}", float(raw[f, i])) for f in range(90) for i in range(12)]
    cells = spark.createDataFrame(rows, "scorer string, film_id long, item_id string, value double")
    whole = L.null_spectra(cells, ["scorer"], n_iter=30).toPandas()
    assert sorted(whole.rep.unique()) == list(range(-1, 30))
    monkeypatch.setattr(L, "CELLS_PER_TASK", 300)
    monkeypatch.setattr(L, "_PLACES", 1)
    cut = L.null_spectra(cells, ["scorer"], n_iter=30)
    assert "_stratum" in cut._jdf.queryExecution().optimizedPlan().toString()
    cut = cut.toPandas()
    both = whole.merge(cut, on=["scorer", "rep", "rank"])
    assert len(both) == len(whole) == len(cut) == 31 * 12
    seen = both[both.rep < 0]
    assert np.abs(seen.eigenvalue_x - seen.eigenvalue_y).max() < 1e-9
    null = both[(both.rep >= 0) & (both["rank"] == 1)]
    assert null.eigenvalue_x.nunique() == null.eigenvalue_y.nunique() == 30
    assert abs(null.eigenvalue_x.mean() - null.eigenvalue_y.mean()) < 0.2 < seen.eigenvalue_x.max() - null.eigenvalue_y.max()


def test_missing_of_a_bank_shuffles_no_asked_pairs(spark):
    """as asked minus answered, from one row a respondent; a null respondent has no answers."""
    answered = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, None), (3, "a"), (3, "b"), (3, "c"), (None, "a"), (4, "x")], "film_id long, item_id string")
    bank = F.array(*map(F.lit, "abc"))
    asked = answered.select("film_id").distinct().select("film_id", F.explode(bank).alias("item_id"))
    want = A.missing_answers(asked, answered, ["film_id", "item_id"])
    found = A.missing_of_bank(answered, bank)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(want) and found.count() == 1 + 3 + 3 + 3
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbour_hits_of_a_person_lie_in_one_bounded_task(spark):
    rng = np.random.default_rng(4)
    weights = pd.DataFrame([(u, f, float(rng.choice([-1.0, -0.5, 0.5, 1.0]))) for u in range(200) for f in rng.choice(30, 12, replace=False)],
                           columns=["user_id", "film_id", "weight"])
    edges = pd.DataFrame([(int(s), int(d), float(rng.uniform(-1, 1))) for s in range(30) for d in rng.choice(30, 6, replace=False) if s != d],
                         columns=["src", "dst", "similarity"])
    hits = edges.merge(weights, left_on="dst", right_on="film_id")
    hits = hits.assign(num=hits.similarity * hits.weight, den=hits.similarity.abs()).groupby(["user_id", "src"])[["num", "den"]].sum()
    want = (hits.num / (hits.den + H.NEIGHBOUR_PRIOR)).to_dict()
    w, e = spark.createDataFrame(weights), spark.createDataFrame(edges)
    for sent in (10**6, 0):  # edges go to every executor, or hits to the person's task
        out = H.neighbour_scores(w, e, per_task=2_000, sent=sent)
        rows = out.withColumn("task", F.spark_partition_id()).toPandas()
        assert rows.task.nunique() > 3 and rows.groupby("user_id").task.nunique().max() == 1
        got = {(r.user_id, r.film_id): r.score for r in rows.itertuples()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    # what leaves the tasks is not what they sum: with few edges no hit is shuffled
    plan = H.neighbour_scores(w, e, per_task=2_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("hashpartitioning")


def test_contributions_are_spread_over_axes_after_the_last_shuffle(spark):
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "b", -1.0), (2, "a", 1.0), (2, "c", 2.0)], "film_id int, item_id string, value double")
    load = spark.createDataFrame([("a", 0, 0.5), ("a", 1, -1.0), ("b", 0, -0.25), ("c", 7, 0.1)], "item_id string, factor_id int, strength double")
    out = H.contributions(cells, load)
    assert "Generate" in out._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    got = {(r.film_id, r.item_id, r.factor_id): round(r.contribution, 9) for r in out.collect()}
    assert got == {(1, "a", 0): round(0.5 / 0.75, 9), (1, "b", 0): round(0.125 / 0.75, 9), (1, "a", 1): -1.0,
                   (2, "a", 0): 0.5, (2, "a", 1): -0.5, (2, "c", 7): 1.0}
