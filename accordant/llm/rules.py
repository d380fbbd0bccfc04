"""Quality rules as a short-circuit cascade.

Every rule can reject a text. What a rule costs and how often it rejects is measured on a
bounded sample, each rule on every sampled text; then rules run in falling order of
rejections per second, and a rejected text is not looked at again. Order affects only time:
a text is kept if no rule rejects it.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``. Defined results: a null text has no
words and fails; repeated rows are judged each; ``doc_id`` may be null.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, texts

SAMPLE_TEXTS = 2000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


class Text:
    """One text's bytes and words; the words are split when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode()
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def count(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))


def dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeat_words(t: Text, width: int = 8) -> int:
    """Words in windows of eight words that occur twice or more in the text."""
    import numpy as np

    n = len(t.words)
    if n <= width:
        return 0
    number: dict = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, t.words), np.int64, n)
    if len(number) == n:
        return 0
    for step in (1, 2, 4):  # windows of two, four and eight words, each by a number of its own
        _, ids = np.unique(ids[:-step] * n + ids[step:], return_inverse=True)
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _crowded(t: Text) -> bool:
    """One word makes up over 3 in 10 of twenty or more."""
    n = len(t.words)
    if n < 20:
        return False
    seen: dict = defaultdict(int)
    for w in t.words:
        seen[w] += 1
    return max(seen.values()) * 10 > 3 * n


RULES = (
    Rule("symbols", lambda t: 10 * t.count(SYMBOLS) > len(t.words)),
    Rule("exclamations", lambda t: 5 * t.raw.count(b"!") > len(t.words)),
    Rule("capitals", lambda t: 2 * t.count(UPPER) > t.count(LETTERS)),
    Rule("few_letters", lambda t: 3 * t.count(LETTERS) < len(t.raw) - t.count(SPACES)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= len(t.raw) - t.count(SPACES) <= 20 * len(t.words)),
    Rule("dup_lines", lambda t: 2 * dup_lines(t) > t.raw.count(b"\n") + 1),
    Rule("one_word", _crowded),
)


def _sampled(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` texts, chosen by a hash of the id over the whole table."""
    every = max(1, docs.count() // most)
    return docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(most)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = SAMPLE_TEXTS) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule on the sample."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spent, hits = [0.0] * len(rules), [0] * len(rules)
        for b in batches:
            for text in b.column("text").to_pylist():
                for i, rule in enumerate(rules):
                    t = Text(text)  # a rule pays for its own words
                    began = time.perf_counter()
                    hits[i] += rule.rejects(t)
                    spent[i] += time.perf_counter() - began
        yield pa.record_batch([pa.array([r.name for r in rules]), pa.array(spent), pa.array(hits, pa.int64())], ["rule", "spent", "hits"])

    sums = _sampled(docs, most).mapInArrow(run, "rule string, spent double, hits long").groupBy("rule")
    return {r["rule"]: (r["s"], r["h"]) for r in sums.agg(F.sum("spent").alias("s"), F.sum("hits").alias("h")).collect()}


def ordered(costs: dict[str, tuple[float, int]], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Most rejections per second first; half a rejection is added so that cheap rules lead among the rest."""

    def rate(rule: Rule) -> float:
        spent, hits = costs.get(rule.name, (0.0, 0))
        return (hits + 0.5) / (spent + 1e-9)

    return sorted(rules, key=rate, reverse=True)


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_TEXTS,
    least_words: int = 20, most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``.

    The base counts are reported for every text. Texts with fewer than ``least_words`` words
    or over ``most_repeated`` % repeated ones fail at once; the others go down the cascade.
    """
    rows = texts(docs, id_col, text_col)
    chain = ordered(measure(rows, rules, sample), rules)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches_by_size(batches, "text", 8 << 20):
            out: list[list] = [[] for _ in range(7)]
            for text in b.column("text").to_pylist():
                t = Text(text)
                n, again = len(t.words), repeat_words(t)
                failed = n < least_words or 100 * again > most_repeated * n
                kept = not failed and not any(rule.rejects(t) for rule in chain)
                chars = len(text) - t.count(SPACES)
                for column, value in zip(out, (n, chars, t.count(SYMBOLS), dup_lines(t), again, failed, kept), strict=True):
                    column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(c, pa.bool_()) for c in out[5:]]
            yield pa.record_batch([b.column("doc_id"), *arrays], ["doc_id", *COLUMNS])

    kinds = ", ".join(f"{c} {'long' if i < 5 else 'boolean'}" for i, c in enumerate(COLUMNS))
    return rows.mapInArrow(run, f"doc_id long, {kinds}")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
