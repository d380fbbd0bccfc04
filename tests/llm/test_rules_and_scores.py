"""Rules, classifiers, licences and fingerprints."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from accordant.llm import cotraining, fingerprints, licences, queries, rules, toxicity

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
        n < 20 or 100 * len(again) > 30 * n,
    )


def test_op4_base_counts(spark, small):
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op4_rule_cascade(spark, SF).collect()}
    assert got == {r.doc_id: expected_rules(r.text) for r in small.collect()}


def test_cascade_order_does_not_change_the_verdict(spark, small):
    verdicts = set()
    for chain in (rules.RULES, rules.RULES[::-1]):
        verdicts.add(tuple(sorted((r.doc_id, r.kept) for r in rules.judge(small, chain).collect())))
    assert len(verdicts) == 1
    for doc, kept in verdicts.pop():
        text = small.filter(f"doc_id = {doc}").first().text if doc < 5 else None
        if text is not None:
            failed = expected_rules(text)[5] or any(r.rejects(rules.Text(text)) for r in rules.RULES)
            assert kept is not failed


def test_cheap_rules_that_reject_much_come_first():
    cost = {r.name: (1.0, 0) for r in rules.RULES} | {"one_word": (1.0, 500), "capitals": (0.1, 100)}
    assert [r.name for r in rules.ordered(cost)][:2] == ["capitals", "one_word"]


def test_rules_keep_good_documents(spark, small, labels):
    kept = rules.judge(small).join(labels, "doc_id").toPandas()
    good = kept[(kept.quality == 1) & ~kept.base_failed]
    assert good.kept.mean() > 0.97
    assert kept[kept.quality == 0].kept.mean() < 0.1


def test_rules_on_odd_tables(spark, odd):
    got = Counter(tuple(r)[:7] for r in rules.judge(odd).collect())
    assert got == Counter((r.doc_id, *expected_rules(r.text)[:5], expected_rules(r.text)[5]) for r in odd.collect())
    assert rules.judge(odd.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id])
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.95
    assert out[out.toxic == 0].predicted.mean() < 0.01


def test_ftrl_is_sparse_and_finds_the_words():
    rng = np.random.default_rng(0)
    model = toxicity.FTRL(1000, l1=4.0)
    for _ in range(1500):
        row = np.unique(rng.integers(0, 1000, 30))
        model.learn(row, int(7 in row or 8 in row))
    weights = model.weights(np.arange(1001))
    assert set(np.argsort(weights[:-1])[-2:]) == {7, 8}
    assert (weights[:-1] != 0).mean() < 0.5


def test_toxicity_edge_cases(spark, odd, labels):
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.score(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score(odd.limit(0), labels).count() == 0
    assert toxicity.keep(odd, labels.limit(0)).columns == odd.columns


def test_cotraining_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_cotraining(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((got.quality == 1) == got.kept).mean() > 0.97
    assert got[got.quality == 1].kept.mean() > 0.99


def test_cotraining_gains_from_unlabelled_rows():
    """A view that saw few labels learns the other view's marks."""
    rng = np.random.default_rng(5)
    n = 600
    truth = rng.integers(0, 2, n)
    views = {
        v: [(np.arange(6), np.append(1.0, rng.normal(0, 1, 5) + 1.5 * (2 * y - 1))) for y in truth] for v in ("content", "page")
    }
    label = np.where(np.arange(n) < 60, truth, -1)
    models = cotraining.cotrain(views, label)
    both = models["both"]
    odds = []
    for v in ("content", "page"):
        x = np.array([models[v][at] @ value for at, value in views[v]])
        odds.append(models[v][-2] * x + models[v][-1])
    z = both[0] * odds[0] + both[1] * odds[1] + both[2]
    assert ((z > 0) == (truth == 1))[60:].mean() > 0.97


def test_cotraining_edge_cases(spark, odd, labels):
    rows = cotraining.score(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    alone = cotraining.score(odd.select("doc_id", "text"), labels.limit(0)).collect()
    assert {(r.score, r.kept) for r in alone} == {(0.5, True)}
    assert cotraining.score(odd.limit(0), labels).count() == 0
    kept = cotraining.keep(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 12


LICENCE = licences.TEXTS["MIT"]


@pytest.mark.parametrize(
    ("text", "places"),
    [
        (LICENCE, {0}),
        ("MIT License\n\nCopyright (c) 2001 Some One\n\n" + LICENCE.replace(". ", ".\n  "), {0}),
        (LICENCE.upper().replace(",", ""), {0}),
        (LICENCE.replace("sublicense", "sub-license").replace("and/or", "& / or"), {0}),
        (LICENCE + " More.", set()),
        ("Words.\nLicenced under the Apache License, Version 2.0.\nWords.", {2}),
        ("Words that go on: licensed under the Apache License, Version 2.0.\nWords.", set()),
        ("Words.\n# licensed under the APACHE licence, version 2.0\nWords.", {2}),
        ("Copyright 2020 X\n", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_licences(spark, text, places):
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, licence string")
    assert {r.place for r in licences.scan(df).collect()} == places


def test_licences_wrapped_at_any_width(spark):
    import textwrap

    wrap = lambda t, n, lead: "\n".join(textwrap.fill(x, n, initial_indent=lead, subsequent_indent=lead, break_long_words=False) for x in t.split("\n"))
    spelt = {k: t.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT") for k, t in licences.TEXTS.items()}
    rows = [
        (f"{k} {n} {lead}", notice + wrap(text, n, lead))
        for texts in (licences.TEXTS, spelt)
        for k, text in texts.items()
        for n in (1, *range(20, 101, 3))
        for lead in ("", " * ")
        for notice in ("", "Copyright (c) 2001 Some One\n", "Copyright Some One and others.\n", "Copyright 2001 by X\n(c) Y\n")
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.licence for r in licences.scan(df).filter("place = 0").collect()}
    assert [name for i, (name, _) in enumerate(rows) if found.get(i) != name.split()[0]] == []


def test_licence_scan_matches_sql(spark, duck):
    got = sorted(map(tuple, queries.op1_licence_scan(spark, SF).select("doc_id", "place", "licence").collect()))
    assert got == sorted(duck.execute(licences.oracle()).fetchall())


def test_licences_on_odd_tables(spark, odd):
    assert licences.scan(odd).count() == 0
    assert licences.scan(odd.limit(0)).count() == 0


def shingle_set(text, width=5):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return set(zip(*[words[i:] for i in range(width)])) if len(words) >= width else {tuple(words)}


def test_op8(spark, small):
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, SF).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in small.collect()), reverse=True)
    errors = []
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((got[d].near_edited, edited), (got[d].near_next, after)):
            a, b = shingle_set(t), shingle_set(other)
            errors.append(value - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.15
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(small).collect()}
    assert plain == {d: r.fingerprint for d, r in got.items()}


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_likeness_is_unbiased(bits):
    rng = np.random.default_rng(bits)
    got = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        other = np.concatenate([base[:200], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])  # similarity 0.5
        a, b = fingerprints.pack(fingerprints.sketch([fingerprints.mix(base), fingerprints.mix(other)]), bits)
        got.append(fingerprints.likeness(a[None], b[None], bits)[0])
    assert abs(np.mean(got) - 0.5) < 0.03


def test_fingerprints_on_odd_tables(spark, odd):
    rows = fingerprints.against_edits(odd).collect()
    assert len(rows) == 12
    by_text = {}
    for r in fingerprints.fingerprints(odd).collect():
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    one = fingerprints.against_edits(odd.filter("doc_id = 8")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(8, 1.0)]
    assert fingerprints.against_edits(odd.limit(0)).count() == 0
