"""Token ids as binary blocks: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a Parquet table of blocks, so that Spark's committers write it to any store. A block holds the documents of a run of
ascending ids: `doc_ids`, and two streams, the documents' lengths and the ranks of all their ids. A stream is

    magic "BVB1", count (4 bytes, little-endian), count / 4 control bytes (rounded up), data

A control byte holds four 2-bit codes, the first value's in the lowest bits: code c means the value has c + 1 little-endian data
bytes. The table of ids by rank lies beside the blocks; the most frequent id has rank 0, ties go to the smaller id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices, spill, utf8
from .pretokens import words_of

MAGIC = b"BVB1"
#: Ids in a block, but for a longer document's.
BLOCK = 1 << 16
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_stream(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, "<u4")
    code = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return MAGIC + struct.pack("<I", len(values)) + control.astype(np.uint8).tobytes() + data.tobytes()


def decode_stream(blob: bytes) -> np.ndarray:
    """Lengths come from a table by control byte; values from the bytes at their running sums."""
    if blob[:4] != MAGIC:
        raise ValueError("not a stream of this format")
    (n,) = struct.unpack_from("<I", blob, 4)
    raw = np.frombuffer(blob, np.uint8, offset=8)
    controls = -(-n // 4)
    lengths = _LENGTHS[raw[:controls]].reshape(-1)[:n].astype(np.int64)
    at = controls + np.cumsum(lengths) - lengths
    if n and at[-1] + lengths[-1] != len(raw):
        raise ValueError("stream is cut or has bytes left over")
    raw = np.concatenate([raw, np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for i in range(1, 4):
        long = np.flatnonzero(lengths > i)
        out[long] |= raw[at[long] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _tokenize(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for part in slices(batch):
                ids = words.encode([t or "" for t in part.column("text").to_pylist()])
                if end_id is not None:
                    ids = [np.append(x, np.uint32(end_id)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype("<u4").tobytes() if len(x) and x.max() > 0xFFFF else x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array([bool(len(x) and x.max() > 0xFFFF) for x in ids]), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["doc_id", "ids", "wide", "crc"])

    return run


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, "ids"):
            n = np.bincount(np.concatenate([np.zeros(0, np.uint32), *_ids(part)]).astype(np.int64), minlength=len(total))
            n[: len(total)] += total
            total = n
    id = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(id, pa.int64()), pa.array(total[id], pa.int64())], ["id", "n"])


def _blocks(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, k = ranks.value, TaskContext.get().partitionId()
        block, held, docs, number = [], 0, [], 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, np.uint32), *block])
            row = [k, number, docs, len(flat), encode_stream(np.array([len(x) for x in block], np.uint32)), encode_stream(rank[flat])]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "doc_ids", "n_ids", "lengths", "ranks"])

        for batch in batches:
            for part in slices(batch, "ids"):
                for doc, x in zip(part.column("doc_id").to_pylist(), _ids(part)):
                    if block and held + len(x) > BLOCK:
                        yield out()
                        block, held, docs, number = [], 0, [], number + 1
                    block.append(x)
                    docs.append(doc)
                    held += len(x)
        if block:
            yield out()

    return run


def write(docs: DataFrame, path: str, *, tokenizer: str, end_id: int | None = None) -> None:
    """Writes docs(doc_id, text) to path/blocks, in ascending doc_id order (nulls first, equal ids by the crc of their ids), and
    the ids by rank to path/ranks. A null text is empty; an empty text still gets end_id. Repeated rows are written each for itself; a text
    longer than BLOCK ids is a block of its own. Other columns are ignored, whatever their names; an empty table gives an empty file.

    Texts are encoded once; ids wait in the shared folder while they are counted (the counts have a row for each id of the
    vocabulary at most, which bounds the table of ranks that goes to every task).
    """
    spark = docs.sparkSession
    ids = spill(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, ids binary, wide boolean, crc long"), compression="zstd")
    counts = ids.select("ids", "wide").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r.id for r in counts.orderBy(F.desc("n"), "id").collect()], np.int64)
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(ranks)
    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "crc").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc").select("doc_id", "ids", "wide")
    ordered.mapInArrow(_blocks(sent), "part int, block long, doc_ids array<long>, n_ids long, lengths binary, ranks binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(by_rank.tolist(),)], "ids array<long>").write.parquet(f"{path}/ranks")


def _unblock(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, start, lengths, ranks = (batch.column(c)[i].as_py() for c in ("doc_ids", "start", "lengths", "ranks"))
                n, ids = decode_stream(lengths).astype(np.int64), by_rank[decode_stream(ranks)]
                stop = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + stop - n, pa.int64()), pa.array(n, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in np.split(ids, stop[:-1])], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of the documents in path, a row for each
    that was written, of null ids, equal ids and empty texts too; no rows for an empty file. A damaged stream is an error.
    Starts add up sums of the parts of the file (a row for each) and, inside a part, of its blocks."""
    blocks = spark.read.parquet(f"{path}/blocks")
    by_rank = spark.read.parquet(f"{path}/ranks").first().ids
    sent = spark.sparkContext.broadcast(np.array(by_rank or [], np.int64).astype(np.uint32))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    inner = blocks.select("part", "block", "n_ids").select(F.col("part").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("block")), F.lit(0)).alias("block_start"))
    # Written down, so that its size is known when the blocks are joined to it: a small one is sent to them, a large one isn't.
    starts = spill(inner.join(parts, inner.p == parts.part).select("p", "b", (F.col("part_start") + F.col("block_start")).alias("start")))
    located = blocks.join(starts, (blocks.part == F.col("p")) & (blocks.block == F.col("b")))
    return located.select("doc_ids", "start", "lengths", "ranks").mapInArrow(_unblock(sent), "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, deleted with the other scratch files."""
    return scratch(spark)
