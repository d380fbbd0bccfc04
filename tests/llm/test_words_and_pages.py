"""Spelling variants, page text and phrases against brute force."""

import html
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from accordant.llm import html_text, phrases, queries, spelling

from .conftest import SF


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs, slips, least_letters=5, least_count=3):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slips == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_letters and c >= least_count}
    lists = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, held in lists.items():
        best = min(held, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(lists[w]), n.get(form[w]))
    return out


def as_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("slips", [97, 4])
def test_variants_of_short_and_long_words(spark, slips):
    rng = random.Random(slips)
    long_ = ["x" * 69, "x" * 70, "x" * 71, "y" * 63, "y" * 64, "y" * 64 + "z", "w" * 3000, "w" * 2999 + "v", "ab" * 40, "ab" * 40 + "a"]
    base = ["hello", "helllo", "hallo", "hullo", "Straße", "Ärger", "ÄRGER", "mississippi", *long_]
    docs = [(None if i % 40 == 0 else i, " ".join(rng.choice(base) + rng.choice(["", "", "s", "e"]) for _ in range(30))) for i in range(200)]
    docs += [(7, None), (8, ""), docs[3], docs[3]]
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], "doc_id long, text string, word string, n string")
    assert as_variants(spelling.variant_groups(df, slips=slips)) == variants(docs, slips)


def test_op11(spark, small):
    got = as_variants(queries.op11_spelling_variants(spark, SF))
    assert got == variants([(r.doc_id, r.text) for r in small.collect()], 97)
    assert any(f for f, *_ in got.values())


def test_one_edit():
    rng = random.Random(0)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    for a in words:
        for b in words[:60]:
            assert spelling.one_edit(a, b) == (a != b and near(a, b))


def collocations(rows, limit, least):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {
            p[i : i + k] for p, a in held.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[p[i : i + k]]
        }
        found = []
        for p in held.keys() - dropped:
            score, k = min((2000000 * held[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -held[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("limit", "least", "frontier"), [(2000, 30, None), (40, 3, 10), (300, 2, None)])
def test_phrases(spark, small, limit, least, frontier):
    """A small frontier forces several rounds; ties abound where phrases occur twice."""
    got = sorted(tuple(r) for r in phrases.collocations(small, limit, least, frontier=frontier).collect())
    assert got == collocations([(r.lang, r.text) for r in small.collect()], limit, least)


def test_phrases_of_odd_and_long_texts(spark, odd, monkeypatch):
    """Long texts go by stretches."""
    monkeypatch.setattr(phrases, "LONG_TEXT", 5_000)
    monkeypatch.setattr(phrases, "TOKENS", 1_000)
    got = sorted(tuple(r) for r in phrases.collocations(odd, 500, 2).collect())
    assert got == collocations([(r.lang, r.text) for r in odd.collect()], 500, 2)


def test_shares_are_exact_beyond_64_bits(spark):
    a, of = 7_000_000_000_003, 9_000_000_000_001
    row = spark.createDataFrame([(a, of)], "a long, of long").select(phrases.share(F.col("a"), F.col("of")).alias("s")).first()
    assert row.s == 2_000_000 * a // of


def test_op12(spark):
    """Every page's article, by a pattern that fits these pages alone."""
    rows = queries.op12_html_text(spark, SF).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source) > 0
    for r in rows:
        inside = source[r.page_id].partition("<article>")[2].partition("</article>")[0]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert (r.text, r.n_chars) == (want, len(want))


LONGISH = "A long paragraph of plain words that goes on for a while, as articles do."
PAGES = {
    "": "",
    "plain text only": "plain text only",
    "<p>a<b>b</b>c<br>d": "abc d",
    f"<div><div class=header><a href=1>Home</a></div><div id=c><h2>Title</h2><p>{LONGISH}</p><p>x</p><p>{LONGISH}</p></div>"
    "<div class='sideBar sidebar'>Side words</div><div class=footer>Owner</div></div>": f"Title {LONGISH} x {LONGISH}",
    f"<main><article><header><h1>T</h1></header><p>{LONGISH}</p><div class=comments><article class=comment>{LONGISH * 3}</article></div>"
    "<form>Name</form><aside>See also</aside><footer>By</footer></article></main>": f"T {LONGISH}",
    f"<body class='has-sidebar'><form><article><p>{LONGISH}</p></article></form>": LONGISH,
    "<ul><li>one more item<li>two more items</ul><p>1 < 2 &amp;amp; &#233;&nbsp;x <a href='x>y'>z</a></p>": "one more item two more items 1 < 2 &amp; é x z",
    "<title>T</title><script>var x='<p>no</p>'": "",
    f"<div hidden>no</div><div style='display: none'>no</div><div>{LONGISH}": LONGISH,
    f"<p>{LONGISH}</p><p>cut off <a href=": f"{LONGISH} cut off",
    f"<table><tr><td>{LONGISH}<td>two</table>": f"{LONGISH} two",
}


@pytest.mark.parametrize("source", PAGES, ids=range(len(PAGES)))
def test_main_text(source):
    assert html_text.main_text(source) == PAGES[source]


def test_density_falls_with_links():
    plain = html_text.density(200, 4, 0, 0, 0.2)
    some = html_text.density(200, 4, 50, 2, 0.2)
    assert plain > some > html_text.density(200, 4, 200, 4, 0.2) >= 0


def test_deep_and_broken_pages_end():
    assert html_text.main_text("<div><p>word " * 20_000).startswith("word word")
    for source in ("<b>" * 50_000 + "x", "<a \"'=" * 50_000, "<script>" * 10_000, "<!-- <" * 50_000, "<" * 50_000 + "x"):
        html_text.main_text(source)


def test_pages_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got if r.text) == [(1, "u", "a", 1)] * 2
    assert sum(r.text == "" for r in got) == 2


def test_empty_tables(spark, small):
    none = small.limit(0)
    assert spelling.variant_groups(none).count() == 0
    assert phrases.collocations(none).count() == 0
    assert html_text.extract(spark.read.parquet(f"{SF}/pages.parquet").limit(0)).count() == 0


def test_odd_rows(spark, odd):
    assert as_variants(spelling.variant_groups(odd, slips=97)) == variants([(r.doc_id, r.text) for r in odd.collect()], 97)
