"""Near-duplicate documents by b-bit MinHash.

A document's set is the distinct hashes of its word shingles. Sets that are equal count as
one (by a 128-bit digest), so copies cost a row each and no comparison. Of every other set
``rows * bands`` minima are taken; bands of minima are hashed into buckets, whose members
are candidates, and the lowest four bits of each minimum are packed into a signature.

* A bucket of at most ``SMALL`` sets gives its pairs. Their signatures' matching bits,
  corrected for chance, estimate the similarity; pairs far below the threshold (five
  standard deviations) end here.
* A larger bucket is estimated in blocks of ``SIGNATURES`` signatures inside tasks, which return
  a forest of the components of what may be similar, one edge per member at most.

Clusters are the components of both. So documents that only share a common passage meet
in buckets, but not in clusters. Similarity is then decided on whole sets, cluster by
cluster: intersections of all sets of a block at once, from counts of shared shingles. A
cluster over ``BLOCK`` sets is dealt out to several blocks; what the first pass leaves
outside the cluster's largest component meets all blocks in a second one. Tasks return
component edges, never all pairs.

With ``bands`` chosen for the threshold a pair exactly at it is missed with probability
below one in a million; pairs above it less often.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``, A-Z in lower case. Defined results: a
text with fewer words than a shingle is one shingle; one without words has an empty set, is
linked with nothing and is its own component; rows of equal ``doc_id`` are one document for
linking; a row without ``doc_id`` is linked with nothing, has no component and is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.common import batches_by_size, components, keep_only, partitions, texts
from accordant.llm.fingerprints import shingles, word_hashes
from accordant.session import cut_lineage

WIDTH, PERCENT, ROWS = 5, 80, 5
SMALL = 12
BLOCK = 2048
SIGNATURES = 256
BLOCK_SHINGLES = 3_000_000


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(1997).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def document_set(text: str, width: int) -> np.ndarray:
    """Ascending distinct shingle hashes."""
    words = word_hashes(text)
    return np.unique(shingles(words, width)) if len(words) else np.empty(0, np.uint64)


def set_digest(held: np.ndarray) -> bytes:
    return hashlib.blake2b(held.tobytes(), digest_size=16).digest()


def minima(held: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least value of each hash function (multiply, high half) over a set that is not empty."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(held), 2048):
        least = np.minimum(least, (np.multiply.outer(factors, held[at : at + 2048]) >> np.uint64(32)).min(axis=1))
    return least


def pack4(least: np.ndarray) -> bytes:
    low = (least & np.uint64(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


_ZERO_HALVES = np.array([(not i >> 4) + (not i & 15) for i in range(256)], np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed rows: share of equal values less what chance gives (1 in 16)."""
    same = _ZERO_HALVES[a ^ b].sum(axis=1) / (2 * a.shape[1])
    return (same - 1 / 16) / (1 - 1 / 16)


def sketches(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, signature)``; the last three null for an empty set."""
    n_bands = bands_for(percent)
    n = n_bands * ROWS + n_bands * ROWS % 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        factors = multipliers(n)
        weigh = multipliers(n + ROWS)[n:]
        number = np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches_by_size(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text in b.column("text").to_pylist():
                held = document_set(text, width)
                if len(held):
                    least = minima(held, factors)
                    key = (least[: n_bands * ROWS].reshape(n_bands, ROWS) * weigh).sum(axis=1, dtype=np.uint64)
                    key = (key ^ (key >> np.uint64(31))) * weigh[0] ^ number
                    row = (len(held), set_digest(held), key.view(np.int64), pack4(least))
                else:
                    row = (0, None, None, None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.record_batch([b.column("doc_id"), *arrays], ["doc_id", "n_shingles", "digest", "bands", "signature"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary")


def _least_estimate(percent: int) -> float:
    """Five standard deviations of the estimate below the threshold."""
    share = percent / 100
    return share - 5 * math.sqrt(share * (1 - share) / (bands_for(percent) * ROWS))


def _may_be_similar(rows: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate of each pair of packed rows reaches ``least``; some rows at a time."""
    out = np.empty((len(rows), len(rows)), bool)
    values = 2 * rows.shape[1]
    same = (least * (1 - 1 / 16) + 1 / 16) * values
    for at in range(0, len(rows), 32):
        met = np.zeros((len(rows[at : at + 32]), len(rows)), np.uint16)
        for c in range(rows.shape[1]):
            met += _ZERO_HALVES[rows[at : at + 32, c, None] ^ rows[None, :, c]]
        out[at : at + 32] = met >= same
    return out


def candidate_edges(reps: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: component edges of the pairs that share a bucket and may be similar."""
    least = _least_estimate(percent)
    members = reps.select(F.explode("bands").alias("key"), F.col("node"))
    counts = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(members.join(counts, "key"))
    held = shared.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # SMALL at most
    pairs = (
        held.select("nodes", F.posexplode("nodes").alias("i", "a"))
        .select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.greatest(F.size("nodes") - F.col("i") - 1, F.lit(0)))).alias("b"))
        .distinct()
    )

    @F.arrow_udf("double")
    def alike(x, y):
        import pyarrow as pa

        keep_only("words")
        if not len(x):
            return pa.array([], pa.float64())
        rows = [np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1) for s in (x, y)]
        return pa.array(estimate(*rows))

    own = reps.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    other = reps.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    near = pairs.join(own, "a").join(other, "b").filter(alike("sa", "sb") >= least).select("a", "b")
    return near.union(large_buckets(shared.filter(F.col("n") > SMALL), reps, least).distinct())


def large_buckets(shared: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Component edges within buckets of any size: every block of a bucket meets every other.

    A block by itself gives the edges of its own components. Two blocks give only what joins
    their components, so a bucket that is all alike gives one edge a member and one a pair of
    blocks.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        for t in _groups(batches, ("key", "lo", "hi"), SIGNATURES):
            nodes, first = t.column("node").to_numpy(), t.column("first").to_numpy()
            raw = t.column("signature").to_pylist()
            similar = _may_be_similar(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), least)
            edges = forest(similar) if t.column("lo")[0] == t.column("hi")[0] else joining(similar, first)
            if edges:
                a, b = np.array(edges).T
                yield pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    blocks = F.ceil(F.col("n") / SIGNATURES).cast("int")
    rows = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(reps.select("node", "signature"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    rows = rows.select("key", lo, hi, "node", "signature", (F.col("block") <= F.col("other")).alias("first"))
    by = ("key", "lo", "hi")
    # in the order of nodes: components begin with their least node, so buckets of the same members give the same edges
    dealt = rows.repartition(partitions(reps.sparkSession), *by).sortWithinPartitions(*by, "node")
    return dealt.mapInArrow(run, "a long, b long")


def joining(similar: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the components of the rows in ``first`` with those of the others."""
    owner = np.arange(len(first))
    for side in (np.flatnonzero(first), np.flatnonzero(~first)):
        for root, member in forest(similar[np.ix_(side, side)]):
            owner[side[member]] = side[root]
    i, j = np.nonzero(similar & first[:, None] & ~first[None, :])
    met = np.unique(np.stack([owner[i], owner[j]]), axis=1).T if len(i) else np.empty((0, 2), np.int64)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    edges = []
    for a, b in met.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[y] = x
            edges.append((a, b))
    return edges


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``rows`` with all of ``columns`` (or of ``rows``)."""
    both = rows + (columns or [])
    sizes = np.fromiter(map(len, both), np.int64, len(both))
    owner = np.repeat(np.arange(len(both), dtype=np.int64), sizes)
    flat = np.concatenate(both)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begins = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    df = np.diff(np.append(begins, len(flat)))
    m, k = len(rows), len(columns or rows)
    out = np.zeros((m, k), np.float32)
    # shingles of a few sets: their pairs one by one, the earlier set first
    for d in range(2, min(16, len(both)) + 1):
        at = begins[df == d]
        if not len(at):
            continue
        who = owner[at[:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        first, second = who[:, i].ravel(), who[:, j].ravel()
        if columns:
            fits = (first < m) & (second >= m)
            np.add.at(out, (first[fits], second[fits] - m), 1)
        else:
            np.add.at(out, (first, second), 1)
            np.add.at(out, (second, first), 1)
    # shingles of many sets: as a matrix product, some columns at a time
    often = np.flatnonzero(df > 16)
    for at in range(0, len(often), 2048):
        part = often[at : at + 2048]
        x = np.zeros((len(both), len(part)), np.float32)
        for c, g in enumerate(part.tolist()):
            x[owner[begins[g] : begins[g] + df[g]], c] = 1
        out += x[:m] @ (x[m:] if columns else x).T
    if not columns:
        np.fill_diagonal(out, sizes)
    return out


def linked(rows: list[np.ndarray], percent: int, columns: list[np.ndarray] | None = None) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for all rows and columns."""
    inter = shared_counts(rows, columns).astype(np.int32)
    a = np.fromiter(map(len, rows), np.int32, len(rows))
    b = np.fromiter(map(len, columns), np.int32, len(columns)) if columns else a
    return 100 * inter >= percent * (a[:, None] + b[None, :] - inter)


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each component of a symmetric relation."""
    open_ = np.ones(len(link), bool)
    out = []
    for root in range(len(link)):
        if not open_[root]:
            continue
        open_[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(link[front].any(axis=0) & open_)
            open_[front] = False
            out += [(root, i) for i in front.tolist()]
    return out


def _groups(batches: Iterator, keys: tuple[str, ...], size: int) -> Iterator:
    """Tables of the rows of one key each, from batches sorted by ``keys``."""
    import pyarrow as pa

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *new], [*new, b.num_rows], strict=True):
            key = tuple(c[lo] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _sets(table, name: str = "held") -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in table.column(name).to_pylist()]


def first_pass(blocks: DataFrame, percent: int) -> DataFrame:
    """Component edges within each block of each cluster."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        for t in _groups(batches, ("cluster", "block"), BLOCK):
            nodes = t.column("node").to_numpy()
            edges = forest(linked(_sets(t), percent))
            if edges:
                a, b = np.array(edges).T
                yield pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    n = partitions(blocks.sparkSession)
    return (
        blocks.repartition(n, "cluster", "block").sortWithinPartitions("cluster", "block")
        .select("cluster", "block", "node", "held").mapInArrow(run, "a long, b long")
    )


def second_pass(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges between sets outside their cluster's largest component and all others of it.

    ``blocks`` carries ``component`` and ``largest``; a task meets one block of the former
    with one block of all, and returns one edge per set and component.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        for t in _groups(batches, ("cluster", "outer", "block"), BLOCK):
            outside = t.filter(t.column("side"))
            inside = t.filter(pa.compute.invert(t.column("side")))
            if not outside.num_rows or not inside.num_rows:
                continue
            link = linked(_sets(outside), percent, _sets(inside))
            parts = inside.column("component").to_numpy()
            mine, nodes, others = outside.column("component").to_numpy(), outside.column("node").to_numpy(), inside.column("node").to_numpy()
            edges = []
            for i in range(len(link)):
                at = np.flatnonzero(link[i] & (parts != mine[i]))
                edges += [(nodes[i], others[at[j]]) for j in np.unique(parts[at], return_index=True)[1]]
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    n = partitions(blocks.sparkSession)
    outside = blocks.filter("component <> largest")
    counts = outside.select("cluster", F.col("block").alias("outer")).distinct()
    inner = blocks.select("cluster", "block").distinct()
    grid = counts.join(inner, "cluster")  # blocks of a cluster, not rows
    columns = ["cluster", "outer", "block", "side", "node", "component", "held"]
    left = outside.withColumnRenamed("block", "outer").join(grid, ["cluster", "outer"]).withColumn("side", F.lit(True))
    right = blocks.join(grid, ["cluster", "block"]).withColumn("side", F.lit(False))
    return (
        left.select(*columns).union(right.select(*columns))
        .repartition(n, "cluster", "outer", "block").sortWithinPartitions("cluster", "outer", "block")
        .mapInArrow(run, "a long, b long")
    )


def confirmed(rows: DataFrame, reps: DataFrame, edges: DataFrame, width: int, percent: int) -> DataFrame:
    """Component edges that whole sets confirm, among the clusters that ``edges`` makes."""
    clusters = components(edges).withColumnRenamed("component", "cluster")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only("words")
        for b in batches_by_size(batches, "text"):
            held = [document_set(t, width) for t in b.column("text").to_pylist()]
            same = [set_digest(h) == d for h, d in zip(held, b.column("digest").to_pylist(), strict=True)]
            arrays = [b.column(c) for c in ("cluster", "node")] + [pa.array([h.tobytes() for h in held], pa.binary())]
            yield pa.record_batch(arrays, ["cluster", "node", "held"]).filter(pa.array(same))

    wanted = clusters.join(reps.select("node", "own", "digest"), "node")
    sets = (
        rows.join(wanted, rows["doc_id"] == wanted["own"]).select("cluster", "node", "digest", "text")
        .mapInArrow(run, "cluster long, node long, held binary").dropDuplicates(["node"])
    )
    sets = cut_lineage(sets.withColumn("size", F.length("held") / 8))
    extent = sets.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    blocks_of = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("s") / BLOCK_SHINGLES))
    # only clusters of several blocks are listed, so the list is short and hot keys meet no shuffle
    wide = cut_lineage(extent.withColumn("blocks", blocks_of.cast("int")).filter("blocks > 1").select("cluster", "blocks"))
    blocks = sets.join(wide, "cluster", "left")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    links = cut_lineage(first_pass(blocks, percent))
    if wide.isEmpty():
        return links
    found = components(links)
    own = (
        blocks.join(wide.select("cluster"), "cluster", "left_semi")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    sizes = own.groupBy("cluster", "component").count()
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    return links.union(cut_lineage(second_pass(own.join(largest, "cluster"), percent)))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: the smallest id reachable over links."""
    rows = texts(docs, id_col, text_col)
    made = cut_lineage(sketches(rows, width, percent))
    real = made.filter("doc_id is not null and digest is not null")
    # equal sets: one row for each, found by partial aggregation
    reps = real.groupBy("digest").agg(
        F.min("doc_id").alias("own"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    # an id with several texts stands for several sets, which need names of their own
    several = real.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("two")).filter("one <> two")
    clash = not several.isEmpty()
    name = F.col("own")
    if clash:
        nth = F.row_number().over(Window.partitionBy("own").orderBy("digest"))
        name = F.when(nth == 1, F.col("own")).otherwise(F.xxhash64("own", "digest"))
    reps = cut_lineage(reps.withColumn("node", name))
    links = confirmed(rows, reps, cut_lineage(candidate_edges(reps, percent)), width, percent)
    if clash:
        same_id = real.select("doc_id", "digest").distinct().join(reps.select("digest", "node"), "digest")
        least = same_id.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.union(same_id.join(least, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")))
    found = components(links)
    to = reps.select("digest", "own", "node").join(found, "node", "left").select("digest", "own", F.coalesce("component", "node").alias("label"))
    least = to.groupBy("label").agg(F.min("own").alias("component_id"))
    to = to.join(least, "label").select("digest", "component_id")
    return (
        made.select("doc_id", "n_shingles", "digest").join(to, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component; of several rows of
    one id one stays. Rows without an id stay."""
    kept = near_duplicates(docs, width, percent, id_col, text_col).filter("kept and doc_id is not null").select("doc_id").distinct()
    key = docs[id_col].cast("long")
    known = docs.filter(key.isNotNull())
    left = known.join(kept, key == kept["doc_id"], "left_semi")
    if not known.groupBy(key.alias("id")).count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([id_col])
    return left.union(docs.filter(key.isNull()))
