"""Cases of the fourth round's findings."""

import numpy as np

from accordant.llm import spelling
from accordant.operators import agreement as A
from accordant.operators import clustering as K


def test_ratio_of_mixed_fractions_stays_at_the_limit(spark):
    """17 thirds against 4 times five thirds are exactly 0.85, though stored digits give less."""
    moves = {"O": [1 / 3] * 17 + [0.0] * 3, "F": [5 / 3] * 4 + [0.0] * 16}
    rows = [(film, v, i, x if film == 2 else 0.0) for v in moves for i, x in enumerate(moves[v]) for film in (1, 2)]
    cells = spark.createDataFrame(rows, "film_id long, variant string, item_id int, value double")
    pair = spark.createDataFrame([(1, 2)], "parent_id long, child_id long")
    assert {r.reading for r in A.displacement(cells, pair, summary="O", dialogue="F").collect()} == {"agrees"}


def test_no_table_of_words_or_places_is_broadcast(spark, monkeypatch):
    """op11's tables are merged, however small Spark takes them to be."""
    plans, cut = [], spelling.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(spelling, "cut_lineage", seen)
    long = "x" * 70
    words = ["house", "houses", "hause", "mouse", long, long + "y", long[:-1] + "z"]
    docs = spark.createDataFrame([(k, " ".join([w] * (3 + 4 * k))) for k, w in enumerate(words)], "doc_id long, text string")
    out = spelling.variant_groups(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.word: r.n_near for r in out.collect()} == {"house": 3, "houses": 1, "hause": 1, "mouse": 1, long: 2, long + "y": 1, long[:-1] + "z": 1}
    assert any("Join" in x for x in plans) and not any("Broadcast" in x for x in plans)


def test_components_end_in_one_round_as_rounds_end_them(spark, monkeypatch):
    """what rounds merge pair by pair, a task merges at once; larger components still go by rounds."""
    rng = np.random.default_rng(9)
    base = [[f"w{rng.integers(60)}" for _ in range(9)] for _ in range(8)]
    rows = []
    for i in range(64):
        words = list(base[i % 8])
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(9)] = f"w{rng.integers(60)}"
        rows.append((i, f"f{i % 7}", " ".join(words)))
    props = spark.createDataFrame(rows, "prop_id bigint, film_id string, text string")
    rounds, pairs = [], K._sparse_pairs
    monkeypatch.setattr(K, "_sparse_pairs", lambda *a: rounds.append(1) or pairs(*a))
    got = {}
    for most in (3000, 2):
        monkeypatch.setattr(K, "_TOGETHER", most)
        rounds.clear()
        got[most] = ({r.prop_id: r.cluster_id for r in K.cluster_statements(props).collect()}, len(rounds))
    assert got[3000][0] == got[2][0]
    assert 8 <= len(set(got[2][0].values())) < 60
    assert got[3000][1] == 2 < got[2][1]
