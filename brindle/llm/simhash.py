"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, padded to the 23 bits of the perfect binary Golay code. The keys of
a segment are the indices of all codewords within distance 4: one, or six where the nearest is at distance 3. Two segments that
differ in one bit share a key: the codeword nearest to one is within 3 of it and so within 4 of the other.

Three errors or fewer over three segments leave two cases: either every segment has one at most, and then one half of the last
segment has none; or one segment has two or more, and then of the other two one has none and the other one at most. So a
fingerprint's keys are (key of segment 1, key of segment 2, half of segment 3), for both halves, and (segment i, key of segment j)
for all i, j: about 34 bits each, 89 of them on average. Fingerprints that link share one; those that share one are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spill
from .components import HUB, HUBS, components, forest

SHINGLE, DIFFER = 3, 3
#: Fingerprints of a key that are compared in one block; those of a key with more are dealt to blocks of pairs of parts.
HOT = 2048

_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_BITS, _INDEX = 23, 12


def _parity() -> np.ndarray:
    """The 11 check bits of each 12-bit index."""
    rest = np.arange(1 << _INDEX, dtype=np.int64) << 11
    for i in range(_BITS - 1, 10, -1):
        rest ^= np.where(rest >> i & 1, _GENERATOR << (i - 11), 0)
    return rest


_PARITY = _parity()


def syndrome(words: np.ndarray) -> np.ndarray:
    return _PARITY[words >> 11] ^ (words & 0x7FF)


def _errors() -> np.ndarray:
    """Error patterns of weight 4 or less by syndrome: the one of weight 3 or less first, then five or none (-1)."""
    table, used = np.full((1 << 11, 6), -1, np.int64), np.zeros(1 << 11, int)
    for weight in range(5):
        for bits in combinations(range(_BITS), weight):
            pattern = sum(1 << b for b in bits)
            s = int(syndrome(np.array([pattern]))[0])
            table[s, used[s]] = pattern
            used[s] += 1
    return table


_ERRORS: list[np.ndarray] = []


def golay_keys(segments: np.ndarray) -> np.ndarray:
    """n x 6: indices of the codewords within distance 4 of each 23-bit word, -1 where there are fewer."""
    if not _ERRORS:
        _ERRORS.append(_errors())
    errors = _ERRORS[0][syndrome(segments)]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (unsigned 64-bit), and the position of the fingerprint of each."""
    parts = [(prints >> np.uint64(s)).astype(np.int64) & (1 << n) - 1 for s, n in ((42, 22), (21, 21), (0, 21))]
    codes = [golay_keys(p) for p in parts]
    at = np.arange(len(prints))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for tag, half in ((0, parts[2] & 0x3FF), (1, parts[2] >> 10)):
        for i in range(6):
            for j in range(6):
                ok = (codes[0][:, i] >= 0) & (codes[1][:, j] >= 0)
                out.append((tag << 40 | codes[0][ok, i] << 24 | codes[1][ok, j] << 12 | half[ok], at[ok]))
    for exact in range(3):
        for near in range(3):
            if exact != near:
                for i in range(6):
                    ok = codes[near][:, i] >= 0
                    out.append(((2 + 3 * exact + near) << 40 | parts[exact][ok] << 12 | codes[near][ok, i], at[ok]))
    return np.concatenate([k for k, _ in out]), np.concatenate([a for _, a in out])


def fingerprint(text: str) -> int:
    """The majority of the bits of XXH64 (seed 42) over all 3-word shingles of the text with A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 42) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _prints(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, "_text"):
                hashes: list[int] = []
                counts = []
                for text in part.column("_text").cast(pa.binary()).to_pylist():
                    words = (text or b"").lower().split()  # bytes: A-Z only, and the six space characters only
                    before = len(hashes)
                    if words:
                        flat = b" ".join(words)
                        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                        hashes += [digest(flat[a : b - 1], 42) for a, b in zip([0, *ends], ends[SHINGLE - 1 :] or ends[-1:])]
                    counts.append(len(hashes) - before)
                n = np.array(counts)
                out = np.zeros(len(n), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
                    out[some] = np.packbits(sums * 2 > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(out.view(np.int64))], [*keep, "fingerprint"])

    return run


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fingerprint (long) of each row of docs; a null text has no words."""
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(_prints(list(keep)), docs.select(*keep).schema.add("fingerprint", "long"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        for i in range(0, len(prints), 4096):
            k, at = keys(prints[i : i + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(prints[i : i + 4096][at])], ["key", "fingerprint"])


def _link(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of fingerprints of the same key; keys in order."""
    a, b = [], []
    bits = prints.view(np.uint64)
    live = np.arange(len(key))
    lag = 1
    while True:
        live = live[live + lag < len(key)]
        live = live[key[live] == key[live + lag]]
        if not len(live):
            break
        near = live[np.bitwise_count(bits[live] ^ bits[live + lag]) <= DIFFER]
        a.append(prints[near])
        b.append(prints[near + lag])
        lag += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (prints[:0], prints[:0])


def _verified(most: int):
    """Rows in the order of their keys; the runs of a key go over the edges of batches. Edges (a, b), or (key, fingerprint) of the
    members of a key with more than most, which are only told to be so."""
    out = lambda k, a, b: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def done(key: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.diff(key, prepend=-1))
        long = np.diff(np.append(first, len(key)))
        many = np.repeat(long > most, long)
        if many.any():
            yield out(key[many], prints[many], prints[many])
        key, prints = key[~many], prints[~many]
        if len(key):
            a, b = _link(key, prints)
            if len(a):
                x, y = forest(a, b)
                yield out(np.full(len(x), -1), x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
        for batch in batches:
            key = np.concatenate([held[0], batch.column("key").to_numpy()])
            prints = np.concatenate([held[1], batch.column("fingerprint").to_numpy()])
            if hot is not None:
                same = key == hot
                if same.any():
                    yield out(key[same], prints[same], prints[same])
                key, prints = key[~same], prints[~same]
            if not len(key):
                held = key, prints
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield from done(key[:last], prints[:last])
            key, prints = key[last:], prints[last:]
            hot = None
            if len(key) > most:  # so long that it needn't wait for its end
                hot = key[0]
                yield out(key, prints, prints)
                key, prints = key[:0], prints[:0]
            held = key, prints
        yield from done(*held)

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the parts of hot keys: runs of (block, half), each half of about as many rows as one task compares."""
    import pandas as pd

    held = None
    for batch in _with_end(batches):
        rows = None if batch is None else batch.to_pandas()
        held = rows if held is None else held if rows is None else pd.concat([held, rows])
        if held is None or not len(held):
            continue
        last = held["block"].iloc[-1]
        ready = held if batch is None else held[held["block"] != last]
        held = held[held["block"] == last] if batch is not None else None
        for _, block in ready.groupby("block", sort=False):
            left, right = (block.loc[block["half"] == h, "a"].to_numpy() for h in (0, 1))
            if not len(right):
                right = left
            for i in range(0, len(left), 256):
                x, y = np.nonzero(np.bitwise_count(left[i : i + 256, None].view(np.uint64) ^ right[None, :].view(np.uint64)) <= DIFFER)
                a, b = left[i : i + 256][x], right[y]
                if (a != b).any():
                    u, v = forest(a[a != b], b[a != b])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def links(prints: DataFrame, most: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (distinct, column fingerprint) that differ in 3 bits or fewer. Not every linked pair
    is an edge: the pairs that a task finds are reduced to a forest. A key of over most fingerprints is cut into parts and every
    two of its parts meet in a task of their own, so no task holds them all."""
    keyed = prints.mapInArrow(_keyed, "key long, fingerprint long")
    found = spill(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verified(most), "key long, a long, b long"))
    edges = found.where("key = -1").select("a", "b")
    hot = found.where("key <> -1").select("key", "a")
    if not hot.isEmpty():
        parts = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
        own = hot.join(F.broadcast(parts) if parts.count() < 10_000 else parts, "key").withColumn("own", F.pmod(F.xxhash64("a"), "parts"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        met = met.select(block.alias("block"), (F.col("own") > F.col("other")).cast("int").alias("half"), "a")
        edges = edges.unionByName(met.repartition("block").sortWithinPartitions("block").mapInArrow(_dealt, "a long, b long"))
    return edges.distinct()


def _grouped(docs: DataFrame, keep: tuple[str, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """fingerprint of each row with its kept columns (doc_id among them); and for each fingerprint (_print) its group's smallest
    doc_id (component_id) and fingerprint (root). Both are written tables."""
    prints = spill(fingerprints(docs, keep))
    nodes = spill(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fingerprint"), most))
    tree = spill(nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")))
    linked = roots.select("root").distinct()
    lows = tree.join(linked, "root", "left_semi").groupBy("root").agg(F.min("low").alias("least")).withColumnRenamed("root", "_root")
    of_print = tree.join(lows, F.col("root") == F.col("_root"), "left").select(F.col("fingerprint").alias("_print"), F.coalesce("least", "low").alias("component_id"), "root")
    return prints, spill(of_print)


def near_duplicates(docs: DataFrame, most: int = HOT) -> DataFrame:
    """doc_id, fingerprint (long), component_id (smallest doc_id that can be reached over links of 3 bits or fewer, itself included),
    for each row of docs(doc_id, text).

    Equal fingerprints are one node, so copies cost one aggregation. Null or blank texts have fingerprint 0, linked like any other.
    A null doc_id is never a component_id unless all of its component are null. A text of any length is one row of a task. Other columns
    are ignored, whatever their names; repeated rows give repeated rows; empty in, empty out.
    """
    prints, of_print = _grouped(docs, ("doc_id",), most)
    # Rows of a fingerprint that many share stay where they are: fewer than HUBS such fingerprints are sent to them.
    hot = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HUB, prints.count() // HUBS)).select(F.col("fingerprint").alias("_hot"))
    sent = F.broadcast(of_print.join(hot, F.col("_print") == F.col("_hot")).select("_hot", F.col("component_id").alias("_of_hot")))
    tagged = prints.join(sent, F.col("fingerprint") == F.col("_hot"), "left")
    few = tagged.where("_hot is null").select("doc_id", "fingerprint").join(of_print, F.col("fingerprint") == F.col("_print")).select("doc_id", "fingerprint", "component_id")
    return few.unionByName(tagged.where("_hot is not null").select("doc_id", "fingerprint", F.col("_of_hot").alias("component_id")))


def one_of_each(docs: DataFrame, most: int = HOT) -> DataFrame:
    """One row of each group of near-duplicates of docs(doc_id, text, ...), with all its columns: that of the smallest doc_id, any of
    them where rows share it, one of a null doc_id only if the group has no other. Rows get numbers and wait in the shared folder
    while they are grouped, so that the same rows are read again. Null and empty texts are one group. Columns may have any names; empty
    in, empty out."""
    numbered = spill(docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.monotonically_increasing_id().alias("_number")), compression="zstd")
    prints, of_print = _grouped(numbered, ("doc_id", "_number"), most)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_number").alias("c")))
    stay = prints.groupBy("fingerprint").agg(first.alias("m")).join(of_print, F.col("fingerprint") == F.col("_print")).groupBy("root").agg(F.min("m").alias("m"))
    return numbered.join(stay.select(F.col("m.c").alias("_kept")), F.col("_number") == F.col("_kept"), "left_semi").select("_row.*")
