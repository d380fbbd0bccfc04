"""Token ids in Arrow files of equal-length sequences and masks.

A file is an Arrow IPC file: the stream format with a footer that gives every record
batch's place, so a reader maps the file and reaches sequence ``k`` of batch ``k //
rows_per_batch`` without copying or parsing. Columns, each of ``sequence_length`` values
per row:

* ``ids``: fixed-size list of unsigned 16-bit integers (32-bit if the vocabulary needs it),
* ``mask``: fixed-size list of booleans, false where the last sequence of a file is padded,
* ``begins``: fixed-size list of booleans, true on the first id of a document.

Every document's ids end with ``end_id``. The masked ids of all files in order are the
stream of all documents in ascending ``doc_id`` order. The schema's metadata holds the
file's place in that order (``part``, ``shard``) and its documents (``doc_ids``,
``lengths`` as little-endian 64-bit integers; ``known`` is 0 where an id is missing).

Documents are dealt out by ranges of ``doc_id`` and sorted within them; each task closes a
file at a document's end after ``file_tokens`` ids. So a file depends on its own range
alone: a lost executor costs its ranges, and no task waits for the count of another.

Files go through Spark's own committed text writer, as one record per file, and come back
through the binary-file reader, so any store that Spark reads and writes will do. The
record separator is set to the six bytes that end every Arrow IPC file, which makes the
written file exactly that format.

Defined results: a null text is the empty one and holds its end id alone; null ids come
first; equal ids are ordered by text. An empty table gives no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.llm.chunks import json_encoder
from accordant.llm.common import batches_by_size, partitions, texts
from accordant.session import ensure_checkpoint_dir

TAIL = b"ARROW1"  # fixed value: the closing magic of the Arrow IPC file format
SEQUENCE_LENGTH = 2048
FILE_TOKENS = 4 << 20
ROWS_PER_BATCH = 64


def build_file(ids, doc_ids: list, lengths: list[int], length: int, wide: bool, place: dict[str, str]) -> bytes:
    """One file's bytes. ``ids``: all ids of its documents one after another."""
    import numpy as np
    import pyarrow as pa

    rows = -(-len(ids) // length)
    kind = np.uint32 if wide else np.uint16
    padded = np.zeros(rows * length, kind)
    padded[: len(ids)] = ids
    begins = np.zeros(rows * length, bool)
    ends = np.cumsum(np.asarray(lengths, np.int64))
    begins[ends - np.asarray(lengths, np.int64)] = True
    mask = np.arange(rows * length) < len(ids)
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (padded, mask, begins)]
    known = np.array([d is not None for d in doc_ids], bool)
    meta = place | {
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        "known": known.tobytes(),
        "lengths": np.asarray(lengths, "<i8").tobytes(),
        "tokens": str(len(ids)),
    }
    table = pa.table(columns, names=["ids", "mask", "begins"]).replace_schema_metadata(meta)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table, max_chunksize=ROWS_PER_BATCH)
    return sink.getvalue().to_pybytes()


def open_file(content: bytes):
    """The file's reader, over ``content`` without copying it."""
    import pyarrow as pa

    return pa.ipc.open_file(pa.py_buffer(content))


def sequence(reader, k: int) -> tuple:
    """Ids and mask of sequence ``k`` as views into the file."""
    batch = reader.get_batch(k // ROWS_PER_BATCH)
    row = k % ROWS_PER_BATCH
    ids, mask = batch.column("ids"), batch.column("mask")
    size = ids.type.list_size
    return (
        ids.flatten().slice(row * size, size).to_numpy(zero_copy_only=True),
        mask.flatten().slice(row * size, size),
    )


def write(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = 0,
    sequence_length: int = SEQUENCE_LENGTH,
    file_tokens: int = FILE_TOKENS,
    spaced: bool = True,
    wide: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode ``docs`` and write the files of this module's format into folder ``path``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = json_encoder(tokenizer, spaced)
        part, shard = TaskContext.get().partitionId(), 0
        held: list = []
        doc_ids: list = []
        lengths: list[int] = []
        size = 0

        def close():
            content = build_file(
                np.concatenate(held), doc_ids, lengths, sequence_length, wide, {"part": str(part), "shard": str(shard)}
            )
            assert content.endswith(TAIL)
            return pa.record_batch([pa.array([content[: -len(TAIL)]], pa.binary())], ["content"])

        for b in batches_by_size(batches, "text"):
            flat, counts = encoder.ids(b.column("text").to_pylist())
            ends = np.cumsum(counts)
            whole = np.insert(flat, ends, end_id)
            if not wide and len(whole) and whole.max() > 0xFFFF:
                raise ValueError("these ids need wide=True")
            held.append(whole.astype(np.uint32 if wide else np.uint16))
            doc_ids += b.column("doc_id").to_pylist()
            lengths += (counts + 1).tolist()
            size += len(whole)
            if size >= file_tokens:
                yield close()
                held, doc_ids, lengths, size, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close()

    rows = texts(docs, id_col, text_col)
    n = partitions(docs.sparkSession)
    (
        rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(run, "content binary")
        .select(F.col("content").cast("string").alias("value"))
        .write.option("lineSep", TAIL.decode())
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(part, shard, place, doc_id, n_tokens, ids)`` from the files: a document's ids,
    end id included, as little-endian unsigned 32-bit integers. ``place`` counts within the file."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches_by_size(batches, "content"):
            for content in b.column("content"):
                reader = open_file(content.as_buffer())
                meta = reader.schema.metadata
                doc_ids, lengths = (np.frombuffer(meta[k], "<i8") for k in (b"doc_ids", b"lengths"))
                known = np.frombuffer(meta[b"known"], bool)
                chunks = []
                for i in range(reader.num_record_batches):
                    batch = reader.get_batch(i)
                    ids = batch.column("ids").flatten().to_numpy()
                    chunks.append(ids[batch.column("mask").flatten().to_numpy(zero_copy_only=False)])
                flat = np.concatenate(chunks).astype("<u4")
                ends = np.cumsum(lengths)
                for at in range(0, len(doc_ids), 1000):
                    to = min(at + 1000, len(doc_ids))
                    raw = [flat[e - n : e].tobytes() for e, n in zip(ends[at:to], lengths[at:to], strict=True)]
                    yield pa.record_batch(
                        [
                            pa.array([int(meta[b"part"])] * (to - at), pa.int32()),
                            pa.array([int(meta[b"shard"])] * (to - at), pa.int32()),
                            pa.array(np.arange(at, to), pa.int64()),
                            pa.array(doc_ids[at:to], pa.int64(), mask=~known[at:to]),
                            pa.array(lengths[at:to], pa.int64()),
                            pa.array(raw, pa.binary()),
                        ],
                        ["part", "shard", "place", "doc_id", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part int, shard int, place long, doc_id long, n_tokens long, ids binary")


def with_start(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before, to slim rows of ``read``.

    The files' totals are summed up over their order (a row per file and per part), then
    the lengths within each file.
    """
    own = ["part", "shard"]
    per_file = rows.groupBy(*own).agg(F.sum("n_tokens").alias("total"))
    per_part = per_file.groupBy("part").agg(F.sum("total").alias("total"))
    before_part = per_part.select(
        "part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("_part")
    )
    before_file = per_file.select(
        *own, (F.sum("total").over(Window.partitionBy("part").orderBy("shard")) - F.col("total")).alias("_file")
    )
    within = F.sum("n_tokens").over(Window.partitionBy(*own).orderBy("place")) - F.col("n_tokens")
    return (
        rows.withColumn("_within", within)
        .join(before_file, own)
        .join(before_part, "part")
        .withColumn("start", F.col("_part") + F.col("_file") + F.col("_within"))
        .drop("_part", "_file", "_within")
    )


def folder(spark: SparkSession) -> str:
    """A new folder for files in the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
