"""Clusters against brute force, tracks, sections, greedy choice, house style."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.operators import clustering as K
from accordant.operators import selection as S
from accordant.operators import tracks as T


def greedy_linkage(x, size, cut):
    """Merge the closest pair until none is under the cut; clusters by least member."""
    total, n, members = x * size[:, None], size.astype(float).copy(), {i: [i] for i in range(len(x))}
    while True:
        ids = sorted(members)
        mean = total[ids] / n[ids][:, None]
        sim = np.round(mean @ mean.T, 12)
        best = max(((sim[a, b], -ids[a], -ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids))), default=(-1, 0, 0))
        if best[0] <= 1 - cut:
            return {m: min(group) for group in members.values() for m in group}
        a, b = -best[1], -best[2]
        total[a] += total[b]
        n[a] += n[b]
        members[a] += members.pop(b)


def test_statement_clusters_equal_greedy_linkage(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{rng.integers(40)}" for _ in range(8)] for _ in range(12)]
    texts = []
    for i in range(90):
        words = list(base[i % 12])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(8)] = f"w{rng.integers(40)}"
        texts.append(" ".join(words))
    texts += [texts[0]] * 30  # a third of the table is one copied text
    props = spark.createDataFrame([(i, f"f{i % 7}", t) for i, t in enumerate(texts)], "prop_id bigint, film_id string, text string")
    got = K.cluster_statements(props).toPandas().set_index("prop_id").cluster_id
    points = K.distinct_statements(props)
    tf = K.tfidf(points.select(F.col("prop_id").alias("doc"), "text", "copies"), weight="copies").toPandas()
    copies = points.toPandas().set_index("prop_id").copies.sort_index()
    wide = tf.pivot(index="doc", columns="term", values="v").fillna(0.0).loc[copies.index]
    want = greedy_linkage(wide.to_numpy(), copies.to_numpy(), K.CUT)
    ids = copies.index.to_list()
    for k, v in want.items():
        assert got[ids[k]] == ids[v]
    assert got.loc[range(90, 120)].nunique() == 1


def test_embedded_neighbourhoods_equal_greedy_linkage(spark, monkeypatch):
    monkeypatch.setattr(K, "_DENSE_CHUNK", 10)  # several chunks meet
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 8))
    x = np.repeat(centres, 8, axis=0) + 0.55 * rng.standard_normal((48, 8))
    rows = [(i, 0, [float(v) for v in x[i]]) for i in range(48)]
    got = K.embedded_neighbourhoods(spark.createDataFrame(rows, "id bigint, block int, embedding array<float>")).toPandas().set_index("id").cluster_id
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = greedy_linkage(unit, np.ones(48), K.CUT)
    assert all(got[k] == v for k, v in want.items())
    assert got.nunique() < 48


def test_inverted_statements_split(spark):
    rows = [(1, "a", "violence is never justified"), (2, "b", "violence is morally required"), (3, "c", "violence must not be justified")]
    members = spark.createDataFrame(rows, "prop_id bigint, film_id string, text string").withColumn("cluster_id", F.lit(0).cast("bigint"))
    out = {r.prop_id: r.cluster_id for r in K.split_inverted(members).collect()}
    assert out[1] == out[3] == 0 and out[2] == 1


def test_srt_and_slices(spark):
    raw = "﻿WEBVTT\n\n1\n00:00:01,5 --> 00:00:02,000\n<i>Hello</i>\n{x}there\n\n2\n00:45:00.000 --> 00:45:01.000\nMid\n\nno time\n\n3\n1:29:59,000 --> 1:30:00,000\n42\n"
    cues = T.parse_timed(spark.createDataFrame([("t", raw)], "track_id string, raw string")).orderBy("pos").collect()
    assert [(c.start_ms, c.text) for c in cues] == [(1500, "Hello there"), (2_700_000, "Mid"), (5_399_000, "42")]
    rows = [("f", i, ms, t) for i, (ms, t) in enumerate([(0, "a"), (300_000, "b"), (5_000_000, "c"), (5_399_000, "d")])]
    df = spark.createDataFrame(rows, "film_id string, pos int, start_ms bigint, text string")
    pick = lambda lo, hi: [r.text for r in T.slice_cues(df, lo, hi).orderBy("pos").collect()]
    assert pick(0.0, 0.10) == ["a", "b"] and pick(0.85, 1.0) == ["c", "d"]


def test_section_paths(spark):
    text = "lead\n== Plot ==\nstory\n== Reception ==\ngood\n=== Second reading ===\nreading\n==== Deep ====\nd\n=== Box office ===\nmoney\n== Legacy ==\nend"
    out = T.split_sections(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = [(tuple(r.path), r.body) for r in out.orderBy("section").collect()]
    assert got == [
        (("__lead__",), "lead"), (("plot",), "story"), (("reception",), "good"), (("reception", "second reading"), "reading"),
        (("reception", "second reading", "deep"), "d"), (("reception", "box office"), "money"), (("legacy",), "end")]
    layer = T.collect_layer(out, ["reception"], ["box office"]).first()
    assert layer.sections == 3 and "money" not in layer.content


def test_greedy_coverage_equals_plain_loop(spark):
    rng = np.random.default_rng(8)
    films = [(i, f"L{rng.choice(5, p=[.6, .2, .1, .05, .05])}", f"C{rng.integers(6)}", int(1950 + rng.integers(60))) for i in range(60)]
    df = spark.createDataFrame(films, "film_id bigint, language string, country string, year int")
    facets = {f[0]: [("language", f[1]), ("country", f[2]), ("decade", f"{f[3] // 10 * 10}s")] for f in films}
    seen, pool, want = {}, set(facets) - {0, 1}, []
    for f in (0, 1):
        for x in facets[f]:
            seen[x] = seen.get(x, 0) + 1
    for _ in range(12):
        gain = lambda i: round(sum(S.FACET_WEIGHTS[k] / (1 + seen.get((k, v), 0)) for k, v in facets[i]) / math.sqrt(1 + len(facets[i])), 12)
        best = min(pool, key=lambda i: (-gain(i), i))
        pool.remove(best)
        want.append(best)
        for x in facets[best]:
            seen[x] = seen.get(x, 0) + 1
    got = S.greedy_coverage(df, 12, df.filter("film_id < 2")).orderBy("pick").toPandas()
    assert got.film_id.to_list() == want


def test_house_style(spark):
    rows = [
        ("A woman who repairs radios must decide whether the voice she hears deserves an answer.", "Radio", []),
        ("Short one.", "X", ["too_short"]),
        ("", "X", ["empty"]),
        ("In a small town Maria finally meets the man who wrote the letters she kept. He is evil!", "The Letters Town",
         ["no_full_stop", "many_sentences", "names", "title_words", "verdict_words"]),
    ]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "s string, t string")
    got = [sorted(r[0]) for r in df.select(X.house_style_problems(F.col("s"), F.col("t"))).collect()]
    for mine, (_, _, want) in zip(got, rows):
        assert set(want) <= set(mine) and (want or not mine)


def test_titles(spark):
    df = spark.createDataFrame([("Amélie & the Café of (X)",), ("Gladiator (2000 film)",), ("Heat (1995 American film)",), ("Up (film)",)], "t string")
    keys = [r[0] for r in df.select(X.title_key(F.col("t"))).collect()]
    assert keys[0] == "amelieandcafex"
    split = [(r[0].title, r[0].year) for r in df.select(X.split_disambiguated(F.col("t"))).collect()]
    assert split[1:] == [("Gladiator", 2000), ("Heat", 1995), ("Up", None)]


def test_a_thousand_greedy_picks_take_a_handful_of_jobs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    films = pd.DataFrame({
        "film_id": range(1500), "language": [f"l{x}" for x in rng.zipf(1.6, 1500) % 30], "country": [f"c{x}" for x in rng.zipf(1.5, 1500) % 40],
        "year": rng.integers(1930, 2025, 1500)})
    films.loc[::97, "language"] = ""
    jobs = []
    real = S._most_gaining
    monkeypatch.setattr(S, "_most_gaining", lambda *a: jobs.append(1) or real(*a))
    df = spark.createDataFrame(films)
    got = S.greedy_coverage(df, 1000, df.filter("film_id < 10"), ahead=400).toPandas()
    sig = {
        r.film_id: sorted([("language", r.language)] * bool(r.language) + [("country", r.country), ("decade", f"{r.year // 10 * 10}s")])
        for r in films.itertuples()}
    seen, want = {}, []
    add = lambda f: seen.update({k: seen.get(k, 0) + 1 for k in sig[f]})
    for f in range(10):
        add(f)
    left = {f for f in sig if f >= 10}
    gain = lambda f: round(sum(S.FACET_WEIGHTS[k[0]] / (1 + seen.get(k, 0)) for k in sig[f]) / math.sqrt(1 + len(sig[f])), 12)
    while len(want) < 1000:
        best = min(left, key=lambda f: (-gain(f), f))
        want.append(best)
        left.discard(best)
        add(best)
    assert got.sort_values("pick").film_id.tolist() == want
    assert len(jobs) < 60
