"""Spelling variant grouping: words one edit apart, found by pairs of trie-node numbers.

All prefixes of the words are nodes of a forward trie and all suffixes nodes of a reversed
one; both are numbered once, in tables. A word and a position then are a pair of integers:

* skipping position i: (node of the i letters before, node of the letters after it). Words
  that share such a pair differ by one replaced letter, or are equal;
* inserting before position i: (node of the i letters before, node of the rest). A skipped
  pair that equals an inserted pair is a word with one letter more than the other.

The letters that can stand in a skipped place bound a pair's words (90 letters here), so
replacements are counted and the two best kept group by group, without pairs. A word has at
most one row for every other word that it becomes by losing a letter: of a run of equal
letters only the first is skipped.

Prefixes of a very long word would take memory in the square of its length. Words over
``LONG`` letters are therefore named by running polynomial hashes instead of numbers, and
their pairs are held against the letters before they count.

Tables of places hold many rows a word, which Spark's sizes of compressed and exploded tables
do not tell; so their joins are merges by hint, and no table of words or places is broadcast.

Defined results: null and empty texts have no words; a missing id reads as the empty string;
repeated rows count each; ties for a form go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, keep_only, texts
from accordant.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
LONG = 64
_HELD = 400_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def lower(text: str) -> str:
    """A-Z only."""
    return text.encode().lower().decode()


def slipped(run: str, start: int, every: int) -> str:
    """``run`` less one letter, if ``every`` divides its hash, which goes on from ``start``."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slips: int | None = None) -> DataFrame:
    """``(word, n)`` over all of ``docs (doc_id, text)``; added up in tasks, then by word.

    With ``slips`` one in so many distinct runs of a document loses a letter, chosen by a
    hash of id and run: known misspellings to find again.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts: Counter):
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        keep_only()
        counts: Counter = Counter()
        for b in batches_by_size(batches, "text"):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = RUN.findall(lower(text))
                if slips:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(found).items():
                        counts[slipped(word, start, slips)] += n
                else:
                    counts.update(found)
                if len(counts) > _HELD:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    parts = docs.mapInArrow(run, "word string, n long").filter(F.length("word") >= least_letters)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def numbered(words: DataFrame, strings) -> DataFrame:
    """``(name, number)`` of the distinct strings that ``strings`` (an array column) lists."""
    names = words.select(F.explode(strings).alias("name")).distinct()
    return cut_lineage(names.withColumn("number", F.monotonically_increasing_id()))  # written once, so numbers stay


def trie_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, p, s)``: of every word the nodes of its prefixes of 0, 1, ... letters and
    the nodes of the rests behind them."""
    places = F.sequence(F.lit(0), F.length("word"))
    prefixes = F.transform(places, lambda i: F.substring("word", F.lit(1), i))
    rests = F.transform(places, lambda i: F.substring("word", i + 1, F.length("word")))
    fore = numbered(words, prefixes).select(F.col("name").alias("prefix"), F.col("number").alias("p"))
    back = numbered(words, rests).select(F.col("name").alias("rest"), F.col("number").alias("s"))
    each = words.select("word", "n", F.explode(F.arrays_zip(prefixes.alias("prefix"), rests.alias("rest"), places.alias("i"))).alias("at"))
    each = each.select("word", "n", "at.*").join(fore.hint("merge"), "prefix").join(back.hint("merge"), "rest")
    held = each.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("i", "p", "s"))).alias("nodes"))  # LONG + 1 at most
    return cut_lineage(held.select("word", "n", F.col("nodes.p").alias("p"), F.col("nodes.s").alias("s")))


def near_short(words: DataFrame) -> DataFrame:
    """``(word, near, best)``: numbers of near words, the best of them as (-n, word); several rows a word."""
    nodes = trie_pairs(words)
    at = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i")
    skipped = nodes.select("word", "n", "p", "s", at).select("word", "n", "i", F.expr("p[i]").alias("p"), F.expr("s[i + 1]").alias("s"))
    group = skipped.groupBy("p", "s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "word"))).alias("g"))  # letters at most
    replaced = (
        group.filter(F.size("g") > 1).select("g", F.posexplode("g").alias("place", "own"))
        .select("own.word", (F.size("g") - 1).cast("long").alias("near"), F.when(F.col("place") == 0, F.expr("g[1]")).otherwise(F.expr("g[0]")).alias("best"))
    )
    first = (F.col("i") == 0) | (F.expr("substring(word, i + 1, 1)") != F.expr("substring(word, i, 1)"))
    inserted = nodes.select(F.col("word").alias("less"), F.col("n").alias("m"), F.explode(F.arrays_zip("p", "s")).alias("at"))
    pairs = skipped.filter(first).join(inserted.select("less", "m", "at.p", "at.s").hint("merge"), ["p", "s"])
    return replaced.union(both_ways(pairs.select("word", "n", "less", "m")))


def both_ways(pairs: DataFrame) -> DataFrame:
    """``near_short``'s rows from pairs ``(word, n, less, m)``."""
    one = F.lit(1).cast("long").alias("near")
    ends = F.array(
        F.struct("word", F.struct((-F.col("m")).alias("k"), F.col("less").alias("word")).alias("best")),
        F.struct(F.col("less").alias("word"), F.struct((-F.col("n")).alias("k"), F.col("word").alias("word")).alias("best")),
    )
    return pairs.select(F.explode(ends).alias("e")).select("e.word", one, "e.best")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    lo, hi = 0, len(b)
    while lo < hi:  # longest common prefix by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid]) else (lo, mid - 1)
    return a[lo + 1 :] == b[lo + (len(a) == len(b)) :]


def place_hashes(word: str) -> tuple[list[int], list[int]]:
    """Polynomial hashes of the prefixes of 0, 1, ... letters and of the rests behind them."""
    fore, back, power = [0] * (len(word) + 1), [0] * (len(word) + 1), 1
    for i, c in enumerate(word):
        fore[i + 1] = (fore[i] * _BASE + ord(c)) % _PRIME
    for i in range(len(word), 0, -1):
        back[i - 1] = (ord(word[i - 1]) * power + back[i]) % _PRIME
        power = power * _BASE % _PRIME
    return fore, back


def near_long(words: DataFrame) -> DataFrame:
    """``near_short``'s rows for pairs with a word over ``LONG`` letters, from all words of
    ``LONG`` letters or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for number, word in zip(b.column("number").to_pylist(), b.column("word").to_pylist(), strict=True):
                fore, back = place_hashes(word)
                for skip in (1, 0):
                    if skip and len(word) == LONG:
                        continue  # its longer neighbours find it
                    for lo in range(0, len(word) + 1 - skip, 1 << 16):
                        hi = min(lo + (1 << 16), len(word) + 1 - skip)
                        n = hi - lo
                        columns = [pa.array([x] * n, pa.int64()) for x in (number, skip, len(word) - skip)]
                        columns += [pa.array(x, pa.int64()) for x in (range(lo, hi), fore[lo:hi], back[lo + skip : hi + skip])]
                        yield pa.record_batch(columns, ["number", "skip", "size", "i", "p", "s"])

    def true(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            both = zip(b.column("word").to_pylist(), b.column("less").to_pylist(), strict=True)
            yield b.filter(pa.array([one_edit(x, y) for x, y in both], pa.bool_()))

    named = cut_lineage(words.withColumn("number", F.monotonically_increasing_id()))
    places = "number long, skip long, size long, i long, p long, s long"
    rows = cut_lineage(named.select("number", "word").mapInArrow(run, places))
    by = ["size", "i", "p", "s"]
    skipped = rows.filter("skip = 1").select("number", *by)
    other = rows.select("skip", F.col("number").alias("other"), *by)
    # replaced letters once, from the smaller number; lost ones always
    pairs = skipped.join(other.hint("merge"), by).filter("skip = 0 or number < other").select("number", "other").distinct()
    a = named.select("number", "word", "n")
    b = named.select(F.col("number").alias("other"), F.col("word").alias("less"), F.col("n").alias("m"))
    met = pairs.join(a.hint("merge"), "number").join(b.hint("merge"), "other").select("word", "n", "less", "m")
    return both_ways(met.mapInArrow(true, "word string, n long, less string, m long"))


def forms_of(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` of a table of distinct ``(word, n)``."""
    near = near_short(words.filter(F.length("word") <= LONG)).union(near_long(words.filter(F.length("word") >= LONG)))
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.k") >= ratio * F.col("n")
    return words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.k")).alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form: steps are doubled until none goes on.

    A form is at least twice as frequent as its word, so ways are short and end.
    """
    to = cut_lineage(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if to.join(on.hint("merge"), "root", "left_semi").isEmpty():
            return to
        to = cut_lineage(to.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variant_groups(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    slips: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: every frequent word, its most frequent near
    word if that is ``ratio`` times as frequent, and the word at the end of that way."""
    words = cut_lineage(word_counts(texts(docs, id_col, text_col), least_letters, least_count, slips))
    forms = cut_lineage(forms_of(words, ratio))
    return forms.join(roots(forms).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
