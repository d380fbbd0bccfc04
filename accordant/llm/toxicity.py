"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words, of adjacent pairs, and of pairs with one or
two words between; each counts once. Features in fewer than ``LEAST_TEXTS`` of the learned
rows, by a sketch of counts, are left out before learning. Every coordinate has its own learning rate, and L1
keeps most weights at exactly zero, so what is sent to the tasks is a short list.

Labels are learned from at most ``MOST_LABELLED`` rows (chosen by a hash of the id among
the ids of the documents at hand that may be learned from; one row an id); scoring covers
every row. Labels, language, source and id
are no inputs of a score.

Defined results: a null or empty text scores the bias alone; a repeated row is scored
each time; of repeated labels the largest counts; without any label to learn from every
score is 0.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, keep_only, register_cache, texts

MOST_LABELLED = 12_000
BITS = 32
LEAST_TEXTS = 4
SKETCH = 1 << 24
WORD = re.compile(r"\w+")
# odd multipliers that set the kinds of feature apart
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
GAPS = (1, 2, 3)  # neighbours, and pairs over one and two words


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()
register_cache("toxicity", _HASHES.clear)


def features(texts_: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, feature) for every word and pair of all texts, with repeats."""
    keep_only("toxicity")
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    words = [WORD.findall(t.lower()) for t in texts_]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    get = _HASHES.__getitem__
    flat = np.fromiter((get(w) for ws in words for w in ws), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), counts)
    shift = np.uint64(64 - bits)
    owners, found = [owner], [(flat * MIX[0]) >> shift]
    for k, gap in enumerate(GAPS, 1):
        same = owner[:-gap] == owner[gap:]
        a, b = flat[:-gap][same], flat[gap:][same]
        mixed = (a * MIX[k] + b) * MIX[0]
        owners.append(owner[:-gap][same])
        found.append((mixed ^ (mixed >> np.uint64(29))) * MIX[k] >> shift)
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


class FTRL:
    """Per-coordinate FTRL-proximal for rows of distinct 0/1 features; the last coordinate is the bias.
    A row of the rare class (label 1) counts ``rare`` times."""

    def __init__(self, size: int, alpha: float = 4.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.001, rare: float = 2.0) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.rare = alpha, beta, l1, l2, rare

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)
        small = np.abs(z) <= l1
        return np.where(small, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, row: np.ndarray, label: int) -> None:
        at = np.append(row, len(self.z) - 1)
        w = self.weights(at)
        g = (_sigmoid(w.sum()) - label) * (self.rare if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``(doc_id, text, toxic)``: at most ``most`` labels that may be learned from, with texts.

    Only labels of ids that ``docs`` has are drawn from, and of repeated ids the least text stands."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(remainder() != 0)
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    found = docs.join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, bits: int = BITS, epochs: int = 5) -> dict[str, np.ndarray]:
    """Weights that are not zero: ``at`` (ascending), ``weight``, and the ``bias``; learned in
    one task from rows of ``labelled``, whose number is bounded. The tables are read by many."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows_of(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
            owner, found = features(texts_, bits)
            key = np.unique(owner.astype(np.int64) << 32 | found)
            return (key & 0xFFFFFFFF).astype(np.uint32), np.searchsorted(key >> 32, np.arange(len(texts_) + 1))

        # texts wait packed while features are counted; then only rows of frequent features are made
        kept: list = []
        waiting: list = []
        seen = np.zeros(SKETCH, np.uint16)
        for b in batches_by_size(batches, "text", 1 << 18):
            some = b.column("text").to_pylist()
            np.add.at(seen, rows_of(some)[0] & (SKETCH - 1), 1)
            waiting.append((b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), zlib.compress(json.dumps(some).encode(), 1)))
        for ids, toxic, packed in waiting:
            found, cuts = rows_of(json.loads(zlib.decompress(packed)))
            often = seen[found & (SKETCH - 1)] >= LEAST_TEXTS
            cuts = np.append(0, np.cumsum(often))[cuts]
            found = found[often]
            kept += [(ids[i], toxic[i], found[cuts[i] : cuts[i + 1]]) for i in range(len(ids))]
        del waiting
        kept.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
        kept = [(label, row) for _, label, row in kept]
        known = np.unique(np.concatenate([row for _, row in kept])) if kept else np.empty(0, np.uint32)
        rows = [(label, np.searchsorted(known, row)) for label, row in kept]
        del kept, seen
        model = FTRL(len(known), l1=min(10.0, 4 + len(rows) / 700))  # few rows overcome less
        for _ in range(epochs):
            for label, row in rows:
                model.learn(row, label)
        if rows:
            at = np.append(np.flatnonzero(np.abs(model.z[:-1]) > model.l1), len(known))
            name = np.append(known.astype(np.int64), 1 << bits)[at]  # the bias comes last
            yield pa.record_batch([pa.array(name, pa.int64()), pa.array(model.weights(at))], ["at", "weight"])

    found = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "at long, weight double").toPandas()
    found = found.sort_values("at")
    at, weight = found["at"].to_numpy(np.int64), found["weight"].to_numpy()
    if not len(at):
        return {"at": at, "weight": weight, "bias": np.array([-np.inf])}
    return {"at": at[:-1], "weight": weight[:-1], "bias": weight[-1:]}


def logits(texts_: list[str], model: dict[str, np.ndarray], bits: int = BITS) -> np.ndarray:
    """Bias and the weights of each text's distinct features."""
    total = np.full(len(texts_), model["bias"][0])
    if not len(model["at"]):
        return total
    owner, found = features(texts_, bits)
    few = np.zeros(1 << 16, bool)
    few[model["at"] & 0xFFFF] = True
    near = few[found & 0xFFFF]  # most features end here
    owner, found = owner[near], found[near]
    at = np.minimum(np.searchsorted(model["at"], found), len(model["at"]) - 1)
    hit = model["at"][at] == found
    key = np.unique(owner[hit].astype(np.int64) << 32 | at[hit])
    np.add.at(total, key >> 32, model["weight"][key & 0xFFFFFFFF])
    return total


def score(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    rows = texts(docs, id_col, text_col)
    model = fit(labelled(rows, labels, most))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches_by_size(batches, "text"):
            got = logits(b.column("text").to_pylist(), model)
            value = np.where(np.isneginf(got), 0.0, _sigmoid(got))
            yield pa.record_batch([b.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    model = fit(labelled(texts(docs, id_col, text_col), labels, most))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches_by_size(batches, text_col):
            yield b.filter(pa.array(logits([t or "" for t in b.column(text_col).to_pylist()], model) < 0))

    return docs.mapInArrow(run, docs.schema)
