"""Near duplicates, repeated passages and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import common, near_dedup, queries, suffix_dedup

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(width)])) if len(words) >= width else frozenset([tuple(words)])


def brute_components(docs, width, percent):
    sets = {d: shingle_set(t, width) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for held in where.values():
        shared.update((a, b) for i, a in enumerate(held) for b in held[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def near_copies(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    docs = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(1, 14)):
            own[rng.randrange(200)] = rng.choice(words)
        docs.append((i * 3, "A" + " ".join(own)))
    docs += [(5000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))) for i in range(60)]
    return [*docs, (9000, ""), (9001, "one two"), (9002, "One TWO"), (9003, None)]


def test_op10(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_near_dedup(spark, SF).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in small.collect()], 3, 85)


@pytest.mark.parametrize("block", [2048, 40])
def test_large_clusters_lose_no_link(spark, monkeypatch, block):
    """Small blocks force the second pass."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = near_copies()
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, node string")
    got = near_dedup.near_duplicates(df, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_bucket_keep_its_components(spark, monkeypatch):
    """Small blocks of signatures: the same components, and hardly an edge more than members."""
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "SIGNATURES", 16)
    got = near_dedup.near_duplicates(df, 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 3, 85)


def test_joining_equals_the_components_of_all():
    rng = np.random.default_rng(4)
    for n in (2, 9, 40):
        near = rng.random((n, n)) < 1.2 / n
        near |= near.T
        np.fill_diagonal(near, True)
        first = rng.random(n) < 0.5
        within = []
        for side in (np.flatnonzero(first), np.flatnonzero(~first)):
            within += [(side[a], side[b]) for a, b in near_dedup.forest(near[np.ix_(side, side)])]
        both = np.eye(n, dtype=bool)
        across = near_dedup.joining(near, first)
        for a, b in [*within, *across]:
            both[a, b] = both[b, a] = True
        count = lambda m: n - len(near_dedup.forest(m))
        assert count(both) == count(near) and len(within) + len(across) == n - count(near)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(0)
    factors = near_dedup.multipliers(400)
    errors = []
    for share in (0.0, 0.5, 0.85, 1.0):
        base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        k = int(400 * 2 * share / (1 + share))
        other = np.concatenate([base[:k], rng.integers(0, 1 << 63, 400 - k, dtype=np.uint64)])
        rows = [np.frombuffer(near_dedup.pack4(near_dedup.minima(s, factors)), np.uint8)[None] for s in (base, other)]
        errors.append(near_dedup.estimate(*rows)[0] - share)
    assert np.abs(errors).max() < 0.12


def test_shared_counts_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(50)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (near_dedup.shared_counts(sets) == want).all()
    assert (near_dedup.shared_counts(sets[:20], sets[20:]) == want[:20, 20:]).all()


def test_near_dedup_on_odd_tables(spark, odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 12
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.component_id, r.kept))
    assert by_id[None] == {(None, True)} and by_id[5] == {(4, False)} and by_id[1] == {(1, True)}
    assert by_id[2] == {(2, True)} and by_id[3] == {(3, True)} and by_id[7] == {(7, True)}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, 8, None, None])


def test_an_id_with_two_texts_is_one_document(spark):
    rows = [(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "a b c d e f g h"), (3, "k l m n o p q r"), (4, "x y z u v")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize("reach", [1, 3])
def test_components_of_long_chains_in_any_order(spark, reach):
    ids = np.random.default_rng(5).permutation(4000).tolist()
    links = [(ids[i], ids[i + k]) for k in range(1, reach + 1) for i in range(len(ids) - k)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(4000), 0)


def brute_removed(docs):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        raw = (t or "").encode()
        n = len(raw)
        edge = [0] * (n + 1)
        for i in range(n - 99):
            w = raw[i : i + 100]
            if w in seen:
                edge[i] += 1
                edge[i + 100] -= 1
            else:
                seen.add(w)
        gone = np.cumsum(edge[:n]) > 0 if n else np.zeros(0, bool)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if n else 0
        kept = bytes(c for c, r in zip(raw, gone, strict=True) if not r)
        out[d] = (n, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_op6(spark, small):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_suffix_dedup(spark, SF).collect()}
    assert got == brute_removed([(r.doc_id, r.text) for r in small.collect()])


@pytest.mark.parametrize(("wide", "heavy"), [(20_000, "none"), (3, "none"), (20_000, "found"), (20_000, "all")])
def test_repeats_of_all_kinds(spark, monkeypatch, wide, heavy):
    """Overlaps, periods and shared passages; a low ``WIDE`` sends every group down the wide
    path, and anchors are dealt out by their windows if none, some or all are heavy."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    if heavy == "none":
        monkeypatch.setattr(suffix_dedup, "heavy_anchors", lambda docs: None)
    if heavy == "all":
        every = lambda docs: np.array([r.anchor for r in suffix_dedup.first_digits(docs).select("anchor").distinct().collect()], np.int64).view(np.uint64)
        monkeypatch.setattr(suffix_dedup, "heavy_anchors", every)
    rng = random.Random(5)
    shared = ["".join(rng.choice("abc é") for _ in range(rng.randint(60, 260))) for _ in range(12)]
    docs = []
    for i in range(200):
        parts = [rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice("abc é") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 6))]
        docs.append((i, "".join(parts)))
    docs += [(1000, "a" * 500), (1001, "ab" * 300), (1002, "a" * 99), (1003, "a" * 100), (1004, ""), (1005, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    ours = {r.doc_id: (r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got}
    assert ours == brute_removed(docs)


def test_anchors_reach_every_window():
    rng = np.random.default_rng(2)
    for size in (99, 100, 101, 5000):
        data = rng.integers(0, 3, size).astype(np.uint8)
        _, place, before, after, _, _ = suffix_dedup.anchors(data, np.array([size]))
        reached = {s for p, x, y in zip(place, before, after, strict=True) for s in range(p - x, p + y - 99)}
        assert set(range(size - 99)) <= reached


def test_passages_on_odd_tables(spark, odd):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == 12
    removed = {r.doc_id: sum(s.hi - s.lo for s in r.spans) for r in got if r.doc_id is not None and r.doc_id > 3}
    sizes = {r.doc_id: r.n_bytes for r in got}
    assert removed[5] == sizes[5] and removed[6] == 30_000 - 1 and removed[8] == 0
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.filter("doc_id = 5").count() == 0
    assert cut.filter("doc_id = 6").first().text == "x" and cut.filter("doc_id = 6").first().n_chars == 1
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in pipe.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.schema.names == docs.schema.names
        rows = {r.doc_id: r.text for r in after.collect()}
        before = {r.doc_id: r.text for r in docs.collect()}
        assert rows.keys() <= before.keys()
        if name == "near_duplicates":
            want = brute_components(before.items(), 5, 80)
            assert rows.keys() == {d for d, (_, c) in want.items() if c == d}
        if name == "repeated_passages":
            sizes = brute_removed(before.items())
            assert {d: len(t.encode()) for d, t in rows.items()} == {
                d: pytest.approx(n - gone, abs=6 * runs) for d, (n, gone, runs, _) in sizes.items() if n == 0 or gone < n
            }
        docs = common.cut_lineage(after)
    packed = pipe.sequences(spark, docs, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    for _, stage in pipe.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert before
    held = [(r.doc_id, r.text or "") for r in odd.collect()]
    alone = [r.doc_id for r in pipe.distinct(spark, odd, SF).collect()]
    known = [d for d in alone if d is not None]
    assert len(known) == len(set(known)) and alone.count(None) == sum(d is None for d, _ in held)
    assert 4 in known and 5 not in known  # equal long texts: the smaller id
    assert {2, 3, 7} <= set(known)  # texts without words are linked with nothing
    cut = pipe.passages(spark, odd, SF).collect()
    assert all(r.text is not None for r in cut) and {2, 3} <= {r.doc_id for r in cut}
    whole = {d: sum(r.length for r in pipe.sequences(spark, odd.filter("doc_id in (2, 3, 8)"), SF).collect() if r.doc_id == d) for d in (2, 3, 8)}
    assert whole[2] == whole[3] == 1 and whole[8] > 1  # an empty text is its end alone


def test_pipeline_catches_planted_cases(spark, tmp_path):
    import corpus_pipeline as pipe

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'")
    good = docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 and toxic = 0"), "doc_id")
    texts = [r.text for r in good.select("text").distinct().orderBy(F.length("text").desc()).limit(3).collect()]
    words = texts[0].split()
    near = " ".join([*words[:-3], "zza", "zzb", "zzc"])
    passage = " ".join(f"uniq{i}ely" for i in range(60))
    rows = [(0, texts[0]), (1, texts[0]), (2, near), (3, texts[1] + "\n" + passage), (4, texts[2] + "\n" + passage)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipe.distinct(spark, df, SF)
    assert {r.doc_id for r in left.collect()} & {0, 1, 2} == {0}
    cut = {r.doc_id: r.text for r in pipe.passages(spark, common.cut_lineage(left), SF).collect()}
    assert passage in cut[3] and passage[50:] not in cut[4]
