"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import shared_folder

#: A word is a maximal run of characters other than these six; the same class as bytes, for numpy.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text handled at once in numpy; temporaries take about 60 bytes for each.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _without_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of what is written here once it is written; the setting is put back."""
    before = spark.conf.get(_SHUFFLES, None)
    spark.conf.set(_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES) if before is None else spark.conf.set(_SHUFFLES, before)


#: Folders and tables of this Python process in the shared folder: (session, path, table or None).
_scratch: list[tuple[SparkSession, str, str | None]] = []


def _delete(spark: SparkSession, path: str, name: str | None = None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(since: int = 0, but: DataFrame | None = None) -> None:
    """Drops the tables and folders that operators have written to the shared folder, from the since-th on, but the one of a DataFrame
    that spill() gave. Results that are still to be computed from them can't be any more, so call it when what was asked for has
    been written."""
    gone = _scratch[since:]
    kept = [x for x in gone if but is not None and x[1] == but._spilled]
    _scratch[since:] = kept
    for spark, path, name in reversed([x for x in gone if x not in kept]):
        if spark.sparkContext._jsc is not None:  # a session that has ended can't reach its store
            _delete(spark, path, name)


def held() -> int:
    """How many tables and folders there are; release(held()) before and after a step keeps what was there before."""
    return len(_scratch)


def drop(df: DataFrame) -> None:
    """Deletes what spill() wrote for df, when nothing will read it again."""
    path = getattr(df, "_spilled", None)
    for i, (spark, at, _) in enumerate(_scratch):
        if at == path:
            del _scratch[i]
            return _delete(spark, at)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may have ended before Python does
        pass


def scratch(spark: SparkSession, name: str | None = None) -> str:
    """A new path in the shared folder, for a table of this name if there is one."""
    path = f"{shared_folder(spark)}/brindle/{name or uuid.uuid4().hex}"
    _scratch.append((spark, path, name))
    return path


def spill(df: DataFrame, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch(spark)
    with _without_shuffles(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by key: joins on the key don't shuffle it again, as often as it is joined."""
    spark = df.sparkSession
    name = f"brindle_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    with _without_shuffles(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).options(path=path, compression="zstd").saveAsTable(name)
    return spark.table(name)


def not_made(keep: tuple[str, ...], made: tuple[str, ...]) -> None:
    """ValueError if a kept column has the name of one that an operator makes."""
    if taken := {c.lower() for c in keep} & {c.lower() for c in made}:
        raise ValueError(f"columns made here can't be kept: {sorted(taken)}")


def words_in(text: str = "text"):
    """Number of words of a text column, 0 for null: runs of other characters end where a space or the text follows."""
    flat = F.translate(F.col(text), "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.regexp_count(flat, F.lit("[^ ]+")), F.lit(0)).cast("long")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as decimal text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets into them. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of at most limit bytes of text or one row."""
    n = batch.num_rows
    if not n:
        return
    offsets = utf8(batch.column(column))[1]
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def blank_marks(data: np.ndarray, flat: np.ndarray) -> None:
    """Puts spaces into flat where data has U+2000 to U+206F (quotes, dashes) or U+00A0 to U+00BF but its letters."""
    for lead, width in ((0xE2, 3), (0xC2, 2)):
        at = np.flatnonzero(data[: 1 - width] == lead)
        if len(at):
            second = data[at + 1]
            at = at[(second == 0x80) | (second == 0x81) if lead == 0xE2 else ~np.isin(second, (0xAA, 0xB5, 0xBA))]
            for k in range(width):
                flat[at + k] = 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0 .. n - 1 modulo 2 ** 64."""
    have = _powers.get(factor)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), factor, np.uint64)
        have[0] = 1
        _powers[factor] = have = np.multiply.accumulate(have)
    return have[:n]


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends], equal for equal bytes: a polynomial over prefix sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers(_FACTOR, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return mix64(raw ^ (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data[offsets[0]:offsets[-1]], relative to offsets[0], and the row of each. Words end with their row."""
    base, rows = offsets[0], len(offsets) - 1
    inside = np.zeros(offsets[-1] - base + 2, bool)
    inside[1:-1] = ~SPACE[data[base : offsets[-1]]]
    edge = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    cuts = offsets[1:-1] - base
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(inside) - 2)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word on both sides
    if len(cuts):
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
    row = np.searchsorted(offsets[1:] - base, starts, "right")
    return starts, ends, np.minimum(row, max(rows - 1, 0))
