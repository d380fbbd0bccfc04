"""Leading eigenvectors of item-by-item matrices that are never made.

The matrix is ``X'X`` of sparse rows ``X`` (one packed row per entity), less a rank-one and
a diagonal part: ``A v = X'(X v) - shift (shift . v) - ridge * v``.  Its leading vectors come
from a block Krylov basis (block Lanczos with full reorthogonalisation): a block of vectors
is sent to the rows, each task multiplies its own rows with it and hands back sums by strips
of items, and the new block is made orthogonal to the basis.  Vectors live in strips of
items, a table row each; a block is orthonormalised by a tree QR, where tasks reduce their
strips to small triangles and one small triangle is left.  What the driver holds is the
block that it sends, in slices of ``SLICE_BYTES`` where items are many, and matrices of the
basis size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.session import cut_lineage, discard, scratch

STRIP = 1024
SPARE = 8
SLICE_BYTES = 64 << 20
_CELLS = 65_536
_BASIS = "strip int, n int, shift binary, ridge binary, q binary"


@dataclass
class Eigen:
    """Descending ``values`` and a table of vectors: (i int, vector array<double>)."""

    values: np.ndarray
    vectors: DataFrame


def _array(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(n, -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: batch.column(name)[r].as_py() for name in batch.schema.names}


def _mapped(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``fn`` turns the rows of a task into rows of ``ddl``."""

    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in fn(_rows(batches)):
            yield pa.RecordBatch.from_pylist([row], schema)

    return df.mapInArrow(run, ddl)


def strips(spark, items: int, shift: np.ndarray | None = None, ridge: np.ndarray | None = None, strip: int = STRIP) -> DataFrame:
    """The items in strips with an empty basis."""

    def made(rows):
        for r in rows:
            lo, n = r["id"] * strip, min(strip, items - r["id"] * strip)
            part = lambda x: (np.zeros(n) if x is None else x[lo : lo + n]).tobytes()
            yield {"strip": r["id"], "n": n, "shift": part(shift), "ridge": part(ridge), "q": b""}

    count = -(-items // strip)
    return _mapped(spark.range(0, count, 1, max(1, min(count, spark.sparkContext.defaultParallelism))), made, _BASIS)


def product(rows: DataFrame, block: np.ndarray, strip: int = STRIP) -> DataFrame:
    """``X'(X block)`` in strips: (strip, y)."""
    width = max(1, SLICE_BYTES // (8 * len(block)))
    out = None
    for at in range(0, block.shape[1], width):
        one = _product(rows, np.ascontiguousarray(block[:, at : at + width]), strip).withColumn("slice", F.lit(at))
        out = one if out is None else out.unionByName(one)
    if block.shape[1] <= width:
        return out.drop("slice")

    def side_by_side(group: pa.Table) -> pa.Table:
        held = group.sort_by("slice").to_pylist()
        n = len(held[0]["y"]) // (8 * min(width, block.shape[1]))
        return pa.table({"strip": pa.array([held[0]["strip"]], pa.int32()), "y": [np.hstack([_array(h["y"], n) for h in held]).tobytes()]})

    return out.groupBy("strip").applyInArrow(side_by_side, "strip int, y binary")


def _product(rows: DataFrame, block: np.ndarray, strip: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)
    items, width = block.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = shared.value, np.zeros((items, width))
        met = np.zeros(items, bool)
        for batch in batches:
            lengths = np.diff(batch.column("idx").offsets.to_numpy())
            idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False)
            val = batch.column("val").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(lengths):  # some rows at a time
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + _CELLS, side="right")))
                i, x = idx[before : ends[hi - 1]], val[before : ends[hi - 1]]
                row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
                onto = np.empty((hi - lo, width))
                for c in range(width):
                    onto[:, c] = np.bincount(row, x * v[i, c], hi - lo)
                for c in range(width):
                    total[:, c] += np.bincount(i, x * onto[row, c], items)
                met[i] = True
                lo = hi
        for k in range(0, items, strip):
            if met[k : k + strip].any():
                yield pa.RecordBatch.from_pydict({"strip": pa.array([k // strip], pa.int32()), "y": [total[k : k + strip].tobytes()]})

    def add(rows_):
        last, total = None, None
        for r in rows_:
            y = np.frombuffer(r["y"])
            if r["strip"] != last:
                if last is not None:
                    yield {"strip": last, "y": total.tobytes()}
                last, total = r["strip"], np.zeros(len(y))
            total += y
        if last is not None:
            yield {"strip": last, "y": total.tobytes()}

    parts = rows.select("idx", "val").mapInArrow(partial, "strip int, y binary")
    return _mapped(parts.repartition("strip").sortWithinPartitions("strip"), add, "strip int, y binary")


def _sum(df: DataFrame, fn, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of the small matrices that ``fn`` makes, added up in tasks first."""

    def partial(rows):
        total = np.zeros(shape)
        for r in rows:
            total += fn(r)
        yield {"x": total.tobytes()}

    total = np.zeros(shape)
    for row in _mapped(df, partial, "x binary").toLocalIterator():
        total += np.frombuffer(row["x"]).reshape(shape)
    return total


def tree_triangle(df: DataFrame, fn, width: int) -> np.ndarray:
    """R of the QR of all rows' matrices ``fn(row)``, stacked: strips are reduced to
    triangles in tasks, and these to one."""

    def partial(rows):
        r = np.zeros((0, width))
        for row in rows:
            r = np.linalg.qr(np.vstack([r, fn(row)]), mode="r")
        yield {"x": r.tobytes()}

    r = np.zeros((0, width))
    for row in _mapped(df, partial, "x binary").toLocalIterator():
        part = np.frombuffer(row["x"]).reshape(-1, width)
        r = np.linalg.qr(np.vstack([r, part]), mode="r") if len(part) else r
    return r


def _block(basis: DataFrame, width: int) -> np.ndarray:
    """The last ``width`` vectors of the basis."""

    def last(rows):
        for r in rows:
            yield {"strip": r["strip"], "y": np.ascontiguousarray(_array(r["q"], r["n"])[:, -width:]).tobytes()}

    found = sorted(_mapped(basis, last, "strip int, y binary").toLocalIterator(), key=lambda r: r["strip"])
    return np.vstack([np.frombuffer(r["y"]).reshape(-1, width) for r in found])


def _extended(held: DataFrame, m: int, width: int, first: bool) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The basis with the part of ``y`` that is new, and the parts of ``y`` in the old and the
    new basis.  ``held``: the basis with ``y``; directions that are nothing but noise are left out."""
    def left_of(r: dict, c: np.ndarray | None) -> np.ndarray:
        y = _array(r["y"], r["n"])
        return y if first or c is None else y - _array(r["q"], r["n"]) @ c

    c = None
    if not first:
        for _ in range(2):  # twice is enough
            more = _sum(held, lambda r, c=c: _array(r["q"], r["n"]).T @ left_of(r, c), (m, width))
            c = more if c is None else c + more
    r = tree_triangle(held, lambda row: left_of(row, c), width)
    size = np.linalg.norm(c) if c is not None else 0.0
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    live = s > 1e-13 * max(size, s.max(initial=0.0), 1e-300)
    turn = vt[live].T / s[live]

    def grown(rows):
        for row in rows:
            new = left_of(row, c) @ turn
            q = new if first else np.hstack([_array(row["q"], row["n"]), new])
            yield {k: row[k] for k in ("strip", "n", "shift", "ridge")} | {"q": np.ascontiguousarray(q).tobytes()}

    return cut_lineage(_mapped(held, grown, _BASIS)), (np.zeros((0, width)) if c is None else c), s[live, None] * vt[live]


def leading(
    rows: DataFrame, items: int, k: int, shift: np.ndarray | None = None, ridge: np.ndarray | None = None,
    tolerance: float = 1e-12, most: int = 400, start: np.ndarray | None = None, seed: int = 0, strip: int = STRIP,
) -> Eigen:
    """The ``k`` largest eigenvalues and their vectors of ``A`` over packed ``rows`` (idx, val).

    Ends when the residuals of all ``k`` are under ``tolerance`` of the largest value or the
    basis spans all it can; a basis of ``most`` vectors starts anew from the best ones."""
    spark = rows.sparkSession
    k = min(k, items)
    width = min(items, k + SPARE)
    empty = strips(spark, items, shift, ridge, strip)

    def begun(rows_):
        for r in rows_:
            at = r["strip"] * strip
            y = np.random.default_rng([seed, r["strip"]]).standard_normal((r["n"], width))
            if start is not None:
                y[:, : start.shape[1]] = start[at : at + r["n"]]
            yield r | {"y": np.ascontiguousarray(y).tobytes()}

    while True:
        basis, _, _ = _extended(_mapped(empty, begun, _BASIS + ", y binary"), 0, width, True)
        own = scratch()[-1:]
        sizes: list[int] = []  # vectors of each block
        small = np.zeros((0, 0))
        m = 0
        block = _block(basis, width)
        while True:
            sizes.append(block.shape[1])
            m += block.shape[1]
            across = 0.0 if shift is None else (shift @ block)[None, :]

            def whole(rows_, across=across, w=block.shape[1]):
                for r in rows_:
                    q = _array(r["q"], r["n"])[:, -w:]
                    y = _array(r["y"], r["n"]) if r["y"] else np.zeros((r["n"], w))
                    y = y - np.frombuffer(r["shift"])[:, None] * across - np.frombuffer(r["ridge"])[:, None] * q
                    yield {c: r[c] for c in ("strip", "n", "shift", "ridge", "q")} | {"y": np.ascontiguousarray(y).tobytes()}

            held = cut_lineage(_mapped(basis.join(product(rows, block, strip), "strip", "left"), whole, _BASIS + ", y binary"))
            between = scratch()[-1:]
            basis, c, r = _extended(held, m, block.shape[1], False)
            discard(spark, own + between)  # the new basis is written
            own = scratch()[-1:]
            grown = np.zeros((m, m))
            grown[: len(small), : len(small)] = small
            grown[:, m - block.shape[1] :] = c
            grown[m - block.shape[1] :, :] = c.T
            small = grown
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            off = np.linalg.norm(r @ turn[m - block.shape[1] :, :k], axis=0) if len(r) else np.zeros(k)
            if not len(r) or m + len(r) > items or off.max() <= tolerance * max(abs(values[0]), 1e-300):
                found = Eigen(values[:k], _vectors(basis, turn[:, :k], m, strip))
                discard(spark, own)
                return found
            if m + len(r) > most:
                start = _dense(basis, turn[:, : min(width, turn.shape[1])], m, strip)
                discard(spark, own)
                break
            block = _block(basis, len(r))


def _vectors(basis: DataFrame, turn: np.ndarray, m: int, strip: int) -> DataFrame:
    def turned(rows):
        for r in rows:
            for k, x in enumerate(_array(r["q"], r["n"])[:, :m] @ turn):
                yield {"i": r["strip"] * strip + k, "vector": x.tolist()}

    return cut_lineage(_mapped(basis, turned, "i int, vector array<double>"))


def _dense(basis: DataFrame, turn: np.ndarray, m: int, strip: int) -> np.ndarray:
    """The turned vectors as one array: as large as a block that is sent to the rows."""
    def turned(rows):
        for r in rows:
            yield {"strip": r["strip"], "y": np.ascontiguousarray(_array(r["q"], r["n"])[:, :m] @ turn).tobytes()}

    found = sorted(_mapped(basis, turned, "strip int, y binary").toLocalIterator(), key=lambda r: r["strip"])
    return np.vstack([np.frombuffer(r["y"]).reshape(-1, turn.shape[1]) for r in found])
