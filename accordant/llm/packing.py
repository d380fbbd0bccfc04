"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Only lengths matter to the plan, and there are at most ``capacity`` of them. So the corpus
is reduced to a histogram of piece lengths (one small row per length), the plan is made on
it in multiples ("this pattern, so many times"), and Spark gives each piece its place by
its rank among the pieces of its length.

Reduction, for a length ``j`` and the pieces left beside it:

* nothing fits beside ``j``: it stands alone;
* ``k`` fills the rest exactly: ``{j, k}`` dominates every set with ``j``;
* one piece at most fits beside ``j``: ``{j, k}`` with the longest such ``k``;
* two at most fit: ``{j, k}`` if ``k`` is no shorter than the best pair, or ``{j, a, b}``
  if the best pair has ``a = k`` and no feasible pair has a second piece longer than ``b``.

Each holds again after it was applied, as only pieces go; so it is applied as often as
pieces last. The rest is packed best-fit, longest first. A rule uses up a length, and
best-fit splits at most one group per length, so the plan has at most about ``4 *
capacity`` patterns of at most ``sqrt(2 * capacity)`` different lengths: its size is
bounded by the capacity whatever the corpus, which is why it may go to every task.

Defined results: a null or empty text is one piece holding the end id; repeated rows are
packed each; ``doc_id`` may be null. Only documents longer than the capacity are cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.chunks import json_encoder
from accordant.llm.common import batches_by_size, keep_only, texts
from accordant.session import cut_lineage

CAPACITY = 4096
MOST_STRETCHES = 500_000


def _best_pair(sizes: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int, int]:
    """Longest two pieces that fit ``room`` together, first the longer; and the longest
    second piece of any two that fit. Zeros if no two fit."""
    first = np.arange(len(sizes))
    second = np.minimum(np.searchsorted(sizes, room - sizes, side="right") - 1, first)
    second = np.where((second == first) & (left[first] < 2), second - 1, second)
    fits = second >= 0
    if not fits.any():
        return 0, 0, 0
    a, b = sizes[fits], sizes[second[fits]]
    best = np.lexsort((a, a + b))[-1]
    return int(a[best]), int(b[best]), int(b.max())


def _fixed_set(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """The other lengths of a set that dominates all sets with ``j``; None if none is proven."""
    left = counts.copy()
    left[j] -= 1
    room = capacity - j
    sizes = np.flatnonzero(left)
    fitting = sizes[: np.searchsorted(sizes, room, side="right")]
    if not len(fitting):
        return ()
    k = int(fitting[-1])
    if k == room:
        return (k,)
    small = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
    if len(small) < 2 or small[:2].sum() > room:
        return (k,)
    if len(small) == 3 and small.sum() <= room:
        return None
    a, b, second = _best_pair(fitting, left[fitting], room)
    if k >= a + b:
        return (k,)
    return (a, b) if a == k and second <= b else None


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes proven sets out of ``counts`` (by length, changed in place): (lengths, times)."""
    fixed = []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j]:
                others = _fixed_set(counts, j, capacity)
                if others is None:
                    break
                own = (j, *others)
                kinds, need = np.unique(own, return_counts=True)
                times = int((counts[kinds] // need).min())
                counts[kinds] -= need * times
                fixed.append((own, times))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing in multiples: ([(length, how many), ...], times)."""
    open_bins: dict[int, list] = {}  # room -> [(times, (parent, length, how many))]
    rooms: list[int] = []

    def put(room: int, times: int, node) -> None:
        if not times:
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((times, node))

    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                times, node = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, node = capacity, None
                times = -(-n // (capacity // size))
            each = room // size
            whole = min(times, n // each)
            over = n - whole * each if whole < times else 0
            put(room - each * size, whole, (node, size, each))
            put(room - over * size, 1 if over else 0, (node, size, over))
            put(room, times - whole - (1 if over else 0), node)
            n -= whole * each + over
    out = []
    for groups in open_bins.values():
        for times, node in groups:
            items = []
            while node:
                items.append((node[1], node[2]))
                node = node[0]
            out.append((items[::-1], times))
    return out


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Rows (length, first rank, how many per sequence, first sequence, offset), by length
    and rank: the pieces of ``length`` with ranks from ``lo`` on fill sequences from ``seq``."""
    left = counts.copy()
    patterns = [([(s, 1) for s in own], t) for own, t in reduce_dominated(left, capacity)]
    patterns += best_fit(left, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, seq = [], 0
    for items, times in patterns:
        offset = 0
        for size, each in items:
            rows.append((size, used[size], each, seq, offset))
            used[size] += times * each
            offset += size * each
        seq += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("size", "lo", "each", "seq", "offset"), table.T, strict=True)) | {"sequences": np.array([seq])}


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, spaced: bool = False,
    id_col: str = "doc_id", text_col: str = "text", most_stretches: int = MOST_STRETCHES,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids, part, nth)``: documents' ids and ``end_id``, cut
    at ``capacity``. ``ids``: little-endian unsigned 32-bit. ``nth`` numbers the pieces of
    one length within the task ``part``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = json_encoder(tokenizer, spaced, most_stretches)
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for b in batches_by_size(batches, "text"):
            flat, counts = encoder.ids(b.column("text").to_pylist())
            raw = np.insert(flat, np.cumsum(counts), end_id).astype("<u4").tobytes()
            out: list[list] = [[] for _ in range(6)]
            at = 0
            for doc, n in zip(b.column("doc_id").to_pylist(), (counts + 1).tolist(), strict=True):
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    row = (doc, k, start, length, raw[4 * (at + start) : 4 * (at + start + length)], int(met[length]))
                    met[length] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                at += n
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            arrays.insert(5, pa.array([part] * len(out[0]), pa.int32()))
            yield pa.record_batch(arrays, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    schema = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def place(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored rows of ``pieces``; other columns stay.

    ``stored`` must be a written table (``nth`` must not change between reads).
    """
    per_part = cut_lineage(stored.groupBy("part", "length").count())
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # capacity rows at most
        counts[row["length"]] = row["n"]
    made = plan(counts, capacity)
    keys = made["size"] << 44 | made["lo"]
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    base = per_part.select("part", "length", before.alias("_before"))

    @F.arrow_udf("sequence_id long, offset long")
    def seat(length, rank):
        import pyarrow as pa

        keep_only("stretches")
        size, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, size << 44 | rank, side="right") - 1
        past = rank - made["lo"][at]
        each = made["each"][at]
        found = made["seq"][at] + past // each, made["offset"][at] + past % each * size
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    kept = [c for c in stored.columns if c not in ("part", "nth")]
    return (
        stored.join(base, ["part", "length"])
        .withColumn("_seat", seat("length", F.col("_before") + F.col("nth")))
        .select(*kept, "_seat.sequence_id", "_seat.offset")
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, spaced: bool = False,
    most_stretches: int = MOST_STRETCHES,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)`` for all pieces of ``docs``.

    ``most_stretches`` trades a worker's memory for time; it changes no result."""
    made = pieces(docs, tokenizer, end_id, capacity, spaced, most_stretches=most_stretches)
    return place(cut_lineage(made), capacity)
