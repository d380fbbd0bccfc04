"""Exact duplicate passages by a depth-limited radix sort of byte windows.

A byte is removed if a string of ``THRESHOLD`` bytes that covers it also starts earlier: in
a document with a smaller id, or earlier in the same one. Strings are judged on the input.

Windows of threshold length are ordered by digits, the most significant first, and a window
leaves the order as soon as it shares its digits so far with no other; what is left at full
depth are exactly the repeated windows.

1. The first digit of a window is its anchor: the run of ``GRAM`` bytes in it whose hash is
   least. Equal windows have equal anchors at equal places. Neighbouring windows mostly
   share their anchor, so one row per anchor (one in about 35 bytes) stands for all of them.
2. The second digit is all bytes that windows with this anchor can have around it. Rows
   with both digits equal are copies: all but the first are repeated as a whole. A task
   settles that for its own rows first, so a copied passage gives a task one row to send,
   however often it stands there.
3. Where one anchor has several surroundings, the first row of each is looked at again at
   full depth: its surrounding bytes are fetched and all windows in them compared. A group
   of over ``WIDE`` such rows is compared by the windows themselves in an aggregation.

An anchor at the edge of a passage that very many documents hold has a row for each of
them. Such anchors are found on a sample and replaced by their windows from the start, so
that no key holds a large share of the rows.

Steps are written tables in the shared checkpoint folder. Digits are compared as 128 bits of
hashes, windows of a group as 64 bits beside the anchor.

Defined results: a null text is the empty one; texts shorter than the threshold lose
nothing; rows equal in id and text are one document and get the same result; other rows of
one id are documents of their own, ordered by a hash of the text; missing ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, free_shuffles, keep_only, partitions, texts
from accordant.session import cut_lineage

THRESHOLD = 100
GRAM = 32
WIDE = 20_000
# rows a task sorts at once
SETTLED_ROWS = 600_000
SAMPLE_TEXTS = 2_000
HEAVY_SHARE = 0.01
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_BASE = 0x5851F42D4C957F2D
_TABLE = np.random.default_rng(1990).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD[4])
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the base of the rolling hash and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)
            )
        return self.up, self.down


_POWERS = _Powers()


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(
    data: np.ndarray, sizes: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM, heavy: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Of texts one after another: (text, place, bytes of context before and after the
    place, hash of the anchor, hash of the context) of every anchor.

    An anchor listed in ``heavy`` is replaced by the windows around it, each of which is its
    own anchor and has nothing around it."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < threshold:
        return none
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    letter = _TABLE[data]
    g, span = letter, 1
    for odd in _ODD[:5]:  # runs of 2, 4, 8, 16 and 32 bytes
        g = g[:-span] * np.uint64(odd) + g[span:]
        span *= 2
    assert span == gram
    g = _mix(g) | np.uint64(1)
    width = threshold - gram + 1
    least = _sliding(g, width, np.minimum)
    least[owner[: len(least)] != owner[threshold - 1 :]] = 0  # no window across texts
    pad = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == g)
    text = owner[place].astype(np.int64)
    begin = ends[text] - sizes[text]
    before = np.minimum(place - begin, width - 1)
    after = np.minimum(ends[text] - place, threshold)
    up, down = _POWERS(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[: len(data)])])
    context = (total[place + after] - total[place - before]) * down[place - before]
    context = _mix(context + (before * 256 + after).astype(np.uint64) * np.uint64(_ODD[5]))
    anchor = g[place]
    place -= begin
    if heavy is None or not len(heavy):
        return text, place, before, after, anchor, context
    hit = np.isin(anchor, heavy)
    least = np.maximum(0, threshold - after[hit])
    many = np.maximum(0, before[hit] - least + 1)
    row = np.repeat(np.flatnonzero(hit), many)
    back = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(least, many)
    start = place[row] + begin[row] - back
    value = (total[start + threshold] - total[start]) * down[start]
    name = _mix(value ^ _mix(anchor[row] + back.astype(np.uint64) * np.uint64(_ODD[1])))
    rest = ~hit
    same = np.full(len(row), threshold)
    more = (text[row], place[row] - back, same - threshold, same, name, value)
    return tuple(np.concatenate([c[rest], m]) for c, m in zip((text, place, before, after, anchor, context), more, strict=True))


def _equal_before(*columns: np.ndarray) -> np.ndarray:
    """Whether a row equals the one before it in all columns."""
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same


_ROW = ("anchor", "context", "doc", "place", "extent")
_ROW_SCHEMA = "anchor long, context long, doc long, place int, extent int"
_SPAN_SCHEMA = "anchor long, doc long, lo int, hi int"


def heavy_anchors(docs: DataFrame, most: int = SAMPLE_TEXTS, share: float = HEAVY_SHARE) -> np.ndarray:
    """Anchors that stand in different surroundings in over ``share`` of a sample of texts:
    the edges of passages that very many documents hold.

    They decide how rows are dealt out, never what is compared. A text has an anchor in
    about 35 bytes, so the list is bounded by a text's anchors over ``share``.
    """
    every = max(1, docs.count() // most)
    some = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)
    kinds = first_digits(some).filter("context is not null").groupBy("anchor").count()
    least = max(20, int(share * most))
    return np.array([r["anchor"] for r in kinds.filter(F.col("count") >= least).collect()], np.int64).view(np.uint64)


def first_digits(docs: DataFrame, heavy: np.ndarray | None = None) -> DataFrame:
    """Rows ``(anchor, context, doc, place, extent)`` that are first of their kind in their
    task; ``extent`` packs the bytes before and after. Others become spans: rows without
    ``context``, ``place`` to ``extent`` being the repeated bytes."""

    def settle(held: list[tuple[np.ndarray, ...]]):
        import pyarrow as pa

        anchor, context, doc, place, before, after = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, doc, anchor * np.uint64(_ODD[0]) + context))
        anchor, context, doc, place, before, after = (c[order] for c in (anchor, context, doc, place, before, after))
        copy = _equal_before(anchor, context)
        lo, hi, of = (place - before)[copy], (place + after)[copy], doc[copy]
        by = np.lexsort((lo, of))
        lo, hi, of = lo[by], hi[by], of[by]
        # contexts have one length but at a text's edges, so ends ascend with beginnings
        new = ~_equal_before(of)
        new[1:] |= lo[1:] > hi[:-1]
        at = np.flatnonzero(new)
        lo, of = lo[at], of[at]
        hi = np.maximum.reduceat(hi, at) if len(at) else hi
        keep = ~copy
        n = len(lo)
        columns = [
            np.concatenate([anchor[keep].view(np.int64), _mix(of.astype(np.uint64)).view(np.int64)]),
            np.concatenate([context[keep].view(np.int64), np.zeros(n, np.int64)]),
            np.concatenate([doc[keep], of]),
            np.concatenate([place[keep], lo]).astype(np.int32),
            np.concatenate([before[keep] << 16 | after[keep], hi]).astype(np.int32),
        ]
        arrays = [pa.array(c) for c in columns]
        arrays[1] = pa.array(columns[1], mask=np.arange(len(columns[0])) >= keep.sum())
        return pa.record_batch(arrays, list(_ROW))

    def run(batches: Iterator) -> Iterator:
        keep_only()
        held, n = [], 0
        for b in batches_by_size(batches, "text", 1 << 18):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            text, place, before, after, anchor, context = anchors(np.frombuffer(b"".join(raw), np.uint8), sizes, heavy=heavy)
            if len(text):
                held.append((anchor, context, b.column("doc").to_numpy()[text], place, before, after))
                n += len(text)
            if n > SETTLED_ROWS:
                yield settle(held)
                held, n = [], 0
        if held:
            yield settle(held)

    return docs.mapInArrow(run, _ROW_SCHEMA)


def second_digits(rows: DataFrame) -> DataFrame:
    """From rows of ``first_digits``: spans (``lo``, ``hi``), and in rows without ``hi`` the
    places of anchors (``lo``) that need full depth. Streams over sorted rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only()

        last = None  # (anchor, context) of the last row
        waiting = None  # the only first row of the last anchor so far: (anchor, doc, place)
        several = False  # whether the last anchor has shown several contexts

        def out(anchor, doc, lo, hi, no_hi):
            arrays = [pa.array(anchor), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32), mask=no_hi)]
            return pa.record_batch(arrays, ["anchor", "doc", "lo", "hi"])

        for b in batches:
            if not b.num_rows:
                continue
            anchor, doc, place, extent = (b.column(c).to_numpy() for c in ("anchor", "doc", "place", "extent"))
            spans = b.column("context").is_null().to_numpy(zero_copy_only=False)
            yield out(anchor[spans], doc[spans], place[spans], extent[spans], np.zeros(spans.sum(), bool))
            real = ~spans
            if not real.any():
                continue
            context = b.column("context").fill_null(0).to_numpy()[real]
            anchor, doc, place, extent = (c[real] for c in (anchor, doc, place, extent))
            before, after = extent >> 16, extent & 0xFFFF
            copy = _equal_before(anchor, context)
            copy[0] = last == (anchor[0], context[0])
            first = np.flatnonzero(~copy)
            kind = anchor[first]
            # how many firsts of the same anchor, those of earlier batches included
            begin = np.flatnonzero(~_equal_before(kind))
            count = np.diff(np.append(begin, len(kind)))
            goes_on = len(kind) > 0 and last is not None and kind[0] == last[0]
            many = count > 1
            if goes_on:
                many[0] = True
            emit = first[np.repeat(many, count)]
            extra = [waiting] if goes_on and not several and waiting is not None else []
            lo = np.concatenate([(place - before)[copy], place[emit], [w[2] for w in extra]]).astype(np.int64)
            hi = np.concatenate([(place + after)[copy], np.zeros(len(emit) + len(extra), np.int64)])
            who = np.concatenate([doc[copy], doc[emit], [w[1] for w in extra]]).astype(np.int64)
            what = np.concatenate([anchor[copy], anchor[emit], [w[0] for w in extra]]).astype(np.int64)
            yield out(what, who, lo, hi, np.arange(len(lo)) >= copy.sum())
            if len(kind):
                alone = not many[-1]
                several = not alone
                waiting = (kind[-1], doc[first[-1]], place[first[-1]]) if alone else None
            last = (anchor[-1], context[-1])

    n = partitions(rows.sparkSession)
    by = ("anchor", "context", "doc", "place")
    return rows.repartition(n, "anchor").sortWithinPartitions(*by).select(*_ROW).mapInArrow(run, _SPAN_SCHEMA)


def contexts(docs: DataFrame, places: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``(anchor, doc, place, before, held)``: the bytes around each place, fetched from the texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only()

        for b in batches_by_size(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text, found in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "found")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for f in found:
                    at = f["lo"]
                    before = min(at, threshold - gram)
                    for column, value in zip(out, (f["anchor"], doc, at, before, raw[at - before : at + threshold]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "doc", "place", "before", "held"])

    # one text's anchors, at most one per byte of it
    found = places.groupBy("doc").agg(F.collect_list(F.struct("anchor", "lo")).alias("found"))
    return docs.join(found, "doc").select("doc", "text", "found").mapInArrow(run, "anchor long, doc long, place int, before int, held binary")


def _windows(before: np.ndarray, held: list[bytes], threshold: int, gram: int):
    """(row, bytes of the window before the anchor, hash of the window) for all windows of all rows."""
    width = threshold - gram
    cells = np.zeros((len(held), width + threshold), np.uint8)
    filled = np.zeros(cells.shape, bool)
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    row = np.repeat(np.arange(len(held)), sizes)
    column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(width - before, sizes)
    cells[row, column] = np.frombuffer(b"".join(held), np.uint8)
    filled[row, column] = True
    up, down = _POWERS(cells.shape[1])
    total = np.cumsum(_TABLE[cells] * up[: cells.shape[1]], axis=1)
    total = np.concatenate([np.zeros((len(held), 1), np.uint64), total], axis=1)
    begin = np.arange(width + 1)
    value = (total[:, begin + threshold] - total[:, begin]) * down[begin]
    whole = filled[:, begin] & filled[:, begin + threshold - 1]
    row, at = np.nonzero(whole)
    return row, width - at, _mix(value[row, at])


def full_depth(rows: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Spans of repeated windows among ``contexts`` rows; groups of ``WIDE`` rows at most.

    A task keeps whole groups together, about ``WIDE`` rows at a time."""

    def compare(parts: list):
        import pyarrow as pa

        t = pa.Table.from_batches(parts).combine_chunks()
        anchor, doc, place = (t.column(c).to_numpy() for c in ("anchor", "doc", "place"))
        before = t.column("before").to_numpy().astype(np.int64)
        row, back, value = _windows(before, t.column("held").to_pylist(), threshold, gram)
        key = _mix(value + _mix(anchor.view(np.uint64))[row] * np.uint64(_ODD[1])) + back.astype(np.uint64) * np.uint64(_ODD[2])
        order = np.lexsort((row, key))  # rows stand in the order of documents and places
        again = np.zeros(len(key), bool)
        again[order] = _equal_before(key[order])
        row, back = row[again], back[again]
        if not len(row):
            return None
        at = np.flatnonzero(~_equal_before(row))
        # windows around one anchor overlap, so they make one span
        lo = place[row[at]] - np.maximum.reduceat(back, at)
        hi = place[row[at]] - np.minimum.reduceat(back, at) + threshold
        return pa.record_batch([pa.array(doc[row[at]]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "lo", "hi"])

    def run(batches: Iterator) -> Iterator:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column("anchor").to_numpy()
            if n > WIDE:
                # the group that the rows held end with may go on: cut where it ends
                new = np.flatnonzero(anchor != held[-1].column("anchor")[-1].as_py())
                cut = int(new[0]) if len(new) else b.num_rows
                held.append(b.slice(0, cut))
                if len(new):
                    if (got := compare(held)) is not None:
                        yield got
                    held, n = [], 0
                b = b.slice(cut)
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held and (got := compare(held)) is not None:
            yield got

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "doc", "place").mapInArrow(run, "doc long, lo int, hi int")


def wide_groups(rows: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """The same for groups of any size: every window a row, its first place by aggregation."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only()

        for b in batches_by_size(batches, "held", 1 << 18):
            anchor, doc, place = (b.column(c).to_numpy() for c in ("anchor", "doc", "place"))
            row, back, value = _windows(b.column("before").to_numpy().astype(np.int64), b.column("held").to_pylist(), threshold, gram)
            columns = (anchor[row], value.view(np.int64), doc[row], (place[row] - back).astype(np.int32))
            yield pa.record_batch([pa.array(c) for c in columns], ["anchor", "value", "doc", "lo"])

    windows = cut_lineage(rows.mapInArrow(run, "anchor long, value long, doc long, lo int"))
    first = windows.groupBy("anchor", "value").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = windows.join(first, ["anchor", "value"]).filter(F.struct("doc", "lo") > F.col("first"))
    return again.select("doc", "lo", (F.col("lo") + threshold).cast("int").alias("hi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, lo, hi)``: bytes to remove, in overlapping pieces. ``docs``: (doc, text), ids distinct."""
    spark = docs.sparkSession
    found = cut_lineage(second_digits(first_digits(docs, heavy_anchors(docs))))
    free_shuffles(spark)
    places = found.filter("hi is null")
    sizes = places.groupBy("anchor").count()
    wide = cut_lineage(sizes.filter(F.col("count") > WIDE).select("anchor"))
    around = contexts(docs, places)
    spans = found.filter("hi is not null").select("doc", "lo", "hi")
    if wide.isEmpty():
        deep = cut_lineage(full_depth(around))
    else:
        around = cut_lineage(around)
        deep = cut_lineage(full_depth(around.join(wide, "anchor", "left_anti")).union(wide_groups(around.join(wide, "anchor", "left_semi"))))
    free_shuffles(spark)
    return spans.union(deep)


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a distinct number ``doc`` in document order, and the numbers of the rows:
    the ids themselves if they are distinct, else places in the order of (id, hash of text)."""
    slim = rows.select("doc_id", F.xxhash64("text").alias("hash"))
    doubtful = slim.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    if doubtful.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "text"), None
    order = slim.distinct().orderBy(F.col("doc_id").asc_nulls_first(), "hash").rdd.zipWithIndex()
    number = cut_lineage(order.map(lambda r: (r[0][0], r[0][1], r[1])).toDF("doc_id long, hash long, doc long"))
    numbered = _join_number(rows, number).select("doc", "text").dropDuplicates(["doc"])
    return cut_lineage(numbered), number


def _join_number(rows: DataFrame, number: DataFrame) -> DataFrame:
    own = rows.withColumn("hash", F.xxhash64("text"))
    to = number.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "doc")
    return own.join(to, own["doc_id"].eqNullSafe(to["_id"]) & (own["hash"] == to["_hash"]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: maximal removed runs as (lo, hi) and the bytes left.

    With ``carry`` there is a fifth column ``row``, a struct of all columns but the text.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if carry else [F.col(f"`{id_col}`")]
    rows = texts(docs, id_col, text_col, F.struct(*others).alias("row"))
    numbered, number = _numbered(rows)
    spans = repeated_spans(numbered)
    # a text's spans, at most a few per byte of it
    per_doc = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("found"))
    if number is None:
        base = rows.withColumn("doc", F.col("doc_id"))
    else:
        base = _join_number(rows, number).select("doc_id", "text", "doc", "row")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only()

        for b in batches_by_size(batches, "text"):
            sizes, runs, kept = [], [], []
            column = b.column("found")
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            lows, highs = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            at = offsets - offsets[0]
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                lo, hi = lows[at[i] : at[i + 1]], highs[at[i] : at[i + 1]]
                sizes.append(len(raw))
                if not len(lo):
                    runs.append([])
                    kept.append(raw)
                    continue
                hi = np.maximum.accumulate(hi)
                new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                begin, end = lo[new].tolist(), hi[np.append(new[1:] - 1, len(hi) - 1)].tolist()
                runs.append([{"lo": x, "hi": y} for x, y in zip(begin, end, strict=True)])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *end], [*begin, len(raw)], strict=True)))
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()), b.column("row")], ["doc_id", "n_bytes", "spans", "kept", "row"])

    none = F.array().cast("array<struct<lo:int,hi:int>>")
    joined = base.join(per_doc, "doc", "left").select("doc_id", "text", F.coalesce("found", none).alias("found"), "row")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"doc_id long, n_bytes long, spans array<struct<lo:int,hi:int>>, kept binary, row {kind}")
    return out if carry else out.drop("row")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts, same columns. Where a cut
    falls into a character, the rest of it goes too. A null text becomes the empty one. A text that was all repeats goes with its
    row; ``n_chars``, if there, is counted anew."""

    @F.arrow_udf("string")
    def decode(raw):
        import pyarrow as pa

        keep_only()
        return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in raw.to_pylist()], pa.string())

    left = remove_repeats(docs, id_col, text_col, carry=True).filter("n_bytes = 0 or length(kept) > 0")
    text = F.when(F.size("spans") > 0, decode("kept")).otherwise(F.col("kept").cast("string"))
    left = left.withColumn("text", text)
    columns = []
    for f in docs.schema:
        if f.name == text_col:
            column = F.col("text")
        elif f.name == "n_chars":
            column = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("row")[f.name]).cast(f.dataType)
        else:
            column = F.col("row")[f.name]
        columns.append(column.alias(f.name))
    return left.select(*columns)
