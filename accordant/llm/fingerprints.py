"""Document fingerprints by one-permutation MinHash.

A text's word shingles are hashed once; the hash's high bits name a bin and the rest is the
value, of which a bin keeps the least. Empty bins are filled by optimal densification: each
bin has a fixed random order of the other bins and borrows from the first one that is not
empty. The lowest ``BITS`` bits of every bin, packed and written as hexadecimal, are the
fingerprint. Two fingerprints' share ``p`` of equal bins estimates the shingle sets'
similarity after chance is taken out: ``(p - c) / (1 - c)`` with ``c = 2 ** -BITS``.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``, letters A-Z in lower case; a shingle
is ``WIDTH`` words. Defined results: a text of fewer words is one shingle; a text without
words (null and empty ones too) has the fingerprint of one empty shingle, so such texts are
alike; repeated rows are fingerprinted each. In ``against_edits`` documents stand in
descending ``doc_id`` order, missing ids last, equal ids by text; a lone document follows
itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, id_bounds, keep_only, partitions, register_cache, texts, with_id_range

WIDTH = 5
BINS = 256
BITS = 8
_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class _Hashes(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        h = self[word] = zlib.crc32(word) | zlib.crc32(word, 0x5BD1E995) << 32
        return h


_HASHES = _Hashes()
register_cache("words", _HASHES.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers evenly."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of ``width`` words; one for all words if they are fewer."""
    width = max(1, min(width, len(words)))
    if not len(words):
        return mix(np.array([0], np.uint64))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = mix(total * _ODD[0] + words[k : len(words) - width + 1 + k])
    return total


def _orders(bins: int) -> np.ndarray:
    rng = np.random.default_rng(20_170_806)
    return np.array([rng.permutation(bins) for _ in range(bins)], np.int16)


_ORDERS: dict[int, np.ndarray] = {}


def densify(least: np.ndarray) -> np.ndarray:
    """Rows of bins with the empty ones (all bits set) filled from others of their row."""
    bins = least.shape[1]
    if bins not in _ORDERS:
        _ORDERS[bins] = _orders(bins)
    order, empty = _ORDERS[bins], np.iinfo(least.dtype).max
    row, col = np.nonzero(least == empty)
    out = least.copy()
    for step in range(bins):
        if not len(row):
            break
        got = least[row, order[col, step]]
        out[row, col] = got
        open_ = got == empty
        row, col = row[open_], col[open_]
    return out


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of densified bin minima for each array of shingle hashes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    shift = np.uint64(64 - bins.bit_length() + 1)
    cell = np.repeat(np.arange(len(sets)), sizes) * bins + (flat >> shift).astype(np.int64)
    least = np.full(len(sets) * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, cell, flat & np.uint64((1 << int(shift)) - 1))
    return densify(least.reshape(len(sets), bins))


def pack(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Lowest ``bits`` bits of each minimum, as bytes."""
    low = (minima & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low
    planes = np.unpackbits(low[..., None], axis=-1)[..., 8 - bits :]
    return np.packbits(planes.reshape(*low.shape[:-1], -1), axis=-1)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of packed rows, from 0 to 1."""
    if bits != 8:
        a, b = (np.unpackbits(x, axis=-1).reshape(*x.shape[:-1], -1, bits) for x in (a, b))
        same = (a == b).all(axis=-1).mean(axis=-1)
    else:
        same = (a == b).mean(axis=-1)
    chance = 2.0**-bits
    return np.clip((same - chance) / (1 - chance), 0, 1)


def fingerprint(texts_: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    return pack(sketch([shingles(word_hashes(t), width) for t in texts_], bins), bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)``: the fingerprint as hexadecimal."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        for b in batches_by_size(batches, "text"):
            held = b.column("text").to_pylist()
            packed = [p.tobytes().hex() for p in fingerprint(held)]
            yield pa.record_batch([b.column("doc_id"), pa.array(list(map(len, held)), pa.int64()), pa.array(packed)], ["doc_id", "n_chars", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows of ``texts`` dealt out by descending ranges of ``doc_id`` and sorted, each range
    followed by the first rows of the next one (``_after``), the last by those of the first.

    Only ids travel to find the ranges' first rows; texts are shuffled once.
    """
    n = partitions(docs.sparkSession)
    # several ranges to a task even out what the hash of the range number deals unevenly
    placed = with_id_range(docs, id_bounds(docs.select("doc_id"), 4 * n), "_range")
    tops = placed.groupBy("_range").agg(F.max("doc_id").alias("_top")).orderBy("_range").collect()  # a row per range
    if not tops:
        return placed.withColumn("_after", F.lit(0))
    follows = [(tops[i]["_range"], t["_range"], t["_top"]) for i, t in zip([*range(1, len(tops)), 0], tops, strict=True)]
    heads = docs.sparkSession.createDataFrame(follows, "_to int, _range int, _top long")
    halo = (
        placed.join(F.broadcast(heads), (placed["_range"] == heads["_range"]) & placed["doc_id"].eqNullSafe(heads["_top"]))
        .select("doc_id", "text", F.col("_to").alias("_range"), F.lit(1).alias("_after"))
    )
    both = placed.withColumn("_after", F.lit(0)).unionByName(halo)
    return both.repartition(n, "_range").sortWithinPartitions("_range", "_after", F.col("doc_id").desc_nulls_last(), "text")


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text has the last ``n_chars // 2`` code points replaced by the first as many
    of the next document in descending order.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        held: list[tuple] = []  # rows that wait for their successor
        last_range = None
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def flush(rows):
            """All but the last row, each with its successor; rows of one range."""
            own = [r[1] for r in rows]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(own, own[1:], strict=False)]
            prints = fingerprint(own)
            changed = fingerprint(edited)
            near_e, near_n = likeness(prints[:-1], changed), likeness(prints[:-1], prints[1:])
            keep = [i for i in range(len(edited)) if not rows[i][2]]
            return pa.record_batch(
                [
                    pa.array([rows[i][0] for i in keep], pa.int64()),
                    pa.array([len(own[i]) for i in keep], pa.int64()),
                    pa.array([edited[i] for i in keep], pa.string()),
                    pa.array([prints[i].tobytes().hex() for i in keep], pa.string()),
                    pa.array([changed[i].tobytes().hex() for i in keep], pa.string()),
                    pa.array(near_e[keep], pa.float64()),
                    pa.array(near_n[keep], pa.float64()),
                ],
                names,
            )

        for b in batches_by_size(batches, "text"):
            for doc, text, rng, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_after")), strict=True):
                if rng != last_range:
                    if len(held) > 1:
                        yield flush(held)
                    held, last_range = [], rng
                if not after or not held or not held[-1][2]:  # the first of the rows after is the successor
                    held.append((doc, text, after))
            if len(held) > 1:
                yield flush(held)
                held = held[-1:]

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(texts(docs, id_col, text_col)).select("doc_id", "text", "_range", "_after").mapInArrow(run, schema)
