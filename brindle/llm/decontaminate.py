"""Benchmark decontamination by greedy string tiling.

Texts are words without case and punctuation. Seeds, 5 words in a row, are joined to those of the benchmark by hash, in map tasks:
each pass over the documents takes a part of the benchmark of bounded size, so that a larger benchmark means more passes, never a
larger table in a task. For each document and item whose shared seeds stand on enough of the item's words, tiles are marked: running Karp-Rabin hashes of 5 words give
the matches, the longest match of words not marked yet is marked in both, and so on until none of 5 words is left. An item whose
words are covered to the threshold, in whatever order its passages stand, contaminates the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blank_marks, mix64, not_made, slices, span_hashes, spill, utf8, word_spans

SEED, COVERED = 5, 0.8
#: Bytes of benchmark text in one pass; a single longer item is a pass of its own.
PASS_BYTES = 16 << 20
#: Places of equal seeds in an item and a document that are held at once; texts with more are tiled length by length.
PLACES = 1 << 20

_LETTERS = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _LETTERS[_c] = _c
_TIMES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with spaces for punctuation (ASCII's, U+2000 to U+206F, and U+00A0 to U+00BF but letters), and offsets."""
    data, offsets = utf8(pc.utf8_lower(texts))
    data = data[: offsets[-1]]
    flat = _LETTERS[data]
    blank_marks(data, flat)
    return flat, offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the text of each."""
    flat, offsets = fold(texts)
    starts, ends, row = word_spans(flat, offsets)
    return span_hashes(flat[offsets[0] : offsets[-1]], starts, ends), row


def seeds(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out += words[k : k + m] * _TIMES[k % 64]
        if k % 64 == 63:
            out = mix64(out)
    return mix64(out)


def tiles(item: np.ndarray, doc: np.ndarray, least: int, places: int = PLACES, theirs: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (begin in item, begin in doc, words): always the longest match of least words or more that are unmarked in both;
    ties go to the first in the item, then in the document. Texts that repeat themselves share seeds at very many places; beyond
    places of them the same tiles are found with hashes of one length after another, in memory that grows with the texts only. theirs
    are the document's seeds, if they are at hand."""
    mine, theirs = seeds(item, least), seeds(doc, least) if theirs is None else theirs
    order = np.argsort(mine, kind="stable")
    low, high = np.searchsorted(mine[order], theirs, "left"), np.searchsorted(mine[order], theirs, "right")
    n = high - low
    if n.sum() > places:
        return _by_length(item, doc, least)
    at = np.repeat(np.arange(len(theirs)), n)
    p = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(at))]
    keep = item[p] == doc[at]
    for k in range(1, least):  # the words themselves decide, not the hashes of their runs
        keep &= item[p + k] == doc[at + k]
    p, at = p[keep], at[keep]
    order = np.lexsort((p, at - p))
    p, at = p[order], at[order]
    first = np.flatnonzero((np.diff(at - p, prepend=np.iinfo(np.int64).min) != 0) | (np.diff(p, prepend=-9) != 1))
    heap = [(-(int(e - b) + least - 1), int(p[b]), int(at[b])) for b, e in zip(first, np.append(first[1:], len(p)))]
    heapq.heapify(heap)
    mark_item, mark_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = ~(mark_item[i : i + length] | mark_doc[j : j + length])
        if free.all():
            out.append((i, j, length))
            mark_item[i : i + length] = mark_doc[j : j + length] = True
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if e - b >= least:
                heapq.heappush(heap, (-int(e - b), i + int(b), j + int(b)))
    return out


def _free(gone: np.ndarray, n: int) -> np.ndarray:
    """Where n words in a row are unmarked."""
    sums = np.append(0, np.cumsum(gone))
    return np.flatnonzero(sums[n:] == sums[:-n])


def _common(item: np.ndarray, doc: np.ndarray, mark_item: np.ndarray, mark_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of unmarked runs of n words whose hash the other text has, too, and the hashes there."""
    i, j = _free(mark_item, n), _free(mark_doc, n)
    a, b = seeds(item, n)[i], seeds(doc, n)[j]
    ours, other = np.isin(a, b), np.isin(b, a)
    return i[ours], a[ours], j[other], b[other]


def _by_length(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """tiles() by running Karp-Rabin hashes: the longest length that unmarked runs share is found by halving, its matches are marked in
    order, and so on."""
    mark_item, mark_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out, most = [], min(len(item), len(doc))
    while True:
        low, high = least - 1, most
        while low < high:
            n = (low + high + 1) // 2
            if len(_common(item, doc, mark_item, mark_doc, n)[0]):
                low = n
            else:
                high = n - 1
        if low < least:
            return out
        i, a, j, b = _common(item, doc, mark_item, mark_doc, low)
        by = np.lexsort((j, b))
        j, b = j[by], b[by]
        first, stop = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        begin: dict[int, int] = {}
        marked = False
        for p, lo, hi in zip(i.tolist(), first.tolist(), stop.tolist()):
            if mark_item[p : p + low].any():
                continue
            at = begin.get(lo, lo)
            while at < hi and mark_doc[j[at] : j[at] + low].any():
                at += 1
            begin[lo] = at  # marked places stay so
            q = next((int(x) for x in j[at:hi] if not mark_doc[x : x + low].any() and (item[p : p + low] == doc[x : x + low]).all()), None)
            if q is not None:
                out.append((p, q, low))
                mark_item[p : p + low] = mark_doc[q : q + low] = True
                marked = True
        most = low if marked else low - 1


@dataclass
class Index:
    """Items by number, and their seeds in order."""

    words: list[np.ndarray]
    least: list[int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    filters: dict[int, np.ndarray]

    @classmethod
    def of(cls, texts: list[str], seed: int) -> "Index":
        hashes, row = word_hashes(pa.array(texts, pa.string()))
        words = np.split(hashes, np.searchsorted(row, np.arange(1, len(texts)))) if texts else []
        least = [min(seed, len(w)) for w in words]
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        filters = {}
        for n in sorted(set(least) - {0}):
            own = [(seeds(w, n), i) for i, (w, m) in enumerate(zip(words, least)) if m == n]
            keys, of, at = np.concatenate([s for s, _ in own]), np.concatenate([np.full(len(s), i) for s, i in own]), np.concatenate([np.arange(len(s)) for s, _ in own])
            order = np.argsort(keys, kind="stable")
            found[n] = keys[order], of[order], at[order]
            filters[n] = np.zeros(1 << 20, bool)
            filters[n][(keys >> np.uint64(44)).astype(np.int64)] = True
        return cls(words, least, found, filters)

    def candidates(self, words: np.ndarray, row: np.ndarray, covered: float, places: int = PLACES) -> list[tuple[int, int]]:
        """Text and item, in order, of all pairs whose shared seeds stand on enough of the item's words. Tiles are made of shared seeds, so
        no other pair can reach the threshold. Places of seeds in items are counted places at once, or a text's."""
        out: list[tuple[int, int]] = []
        need = np.array([covered * len(w) for w in self.words])
        for n, (keys, of, at) in self.seeds.items():
            own = seeds(words, n)
            if not len(own):
                continue
            here = np.flatnonzero(self.filters[n][(own >> np.uint64(44)).astype(np.int64)] & (row[: len(own)] == row[n - 1 :]))
            low, high = np.searchsorted(keys, own[here], "left"), np.searchsorted(keys, own[here], "right")
            hit = np.flatnonzero(high > low)
            met = np.unique(np.stack([row[here[hit]], low[hit], high[hit]], 1), axis=0)  # a seed counts once for a text
            upto = np.cumsum(met[:, 2] - met[:, 1])
            ends = np.flatnonzero(np.diff(met[:, 0], append=-1)) + 1 if len(met) else np.zeros(0, np.int64)
            begin = 0
            while begin < len(met):
                most = (upto[begin - 1] if begin else 0) + places
                fits = ends[(ends > begin) & (upto[ends - 1] <= most)]
                end = int(fits[-1] if len(fits) else ends[ends > begin][0])
                r, b, e = met[begin:end].T
                size = e - b
                entry = np.repeat(b - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                text, item, place = np.repeat(r, size), of[entry], at[entry]
                order = np.lexsort((place, item, text))
                text, item, place = text[order], item[order], place[order]
                first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
                gain = np.append(np.minimum(np.diff(place), n), n)  # words that a seed covers before the next one begins
                gain[first[1:] - 1] = n
                enough = np.add.reduceat(gain, first) >= need[item[first]]
                out += zip(text[first[enough]].tolist(), item[first[enough]].tolist())
                begin = end
        return sorted(out)


class _Seeds:
    """A text's seeds of each length, hashed once."""

    def __init__(self, words: np.ndarray):
        self.words, self.of = words, {}

    def tiles(self, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        if least not in self.of:
            self.of[least] = seeds(self.words, least)
        return tiles(item, self.words, least, theirs=self.of[least])


def _compared(index: Index, texts: pa.Array, covered: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Text, item and tiles of the pairs that reach the threshold."""
    words, row = word_hashes(texts)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    last, text = -1, None
    for r, i in index.candidates(words, row, covered):
        if r != last:
            last, text = r, _Seeds(words[first[r] : first[r + 1]])
        found = text.tiles(index.words[i], index.least[i])
        if sum(x[2] for x in found) >= covered * len(index.words[i]):
            yield r, i, found


def _parts(benchmark: DataFrame, pass_bytes: int) -> Iterator[list]:
    """The benchmark's different items, in lists of at most pass_bytes and one item. Items are dealt to buckets by a hash of all their
    columns; running sums inside a bucket say which list of it an item falls into."""
    size = F.octet_length("text") + 16
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = -(-(items.agg(F.sum(size)).first()[0] or 0) // pass_bytes)
    before = Window.partitionBy("bucket").orderBy("item_id", "text")
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
    placed = spill(dealt.withColumn("part", F.floor(F.sum(size).over(before) / F.lit(pass_bytes))))
    for bucket, part in sorted((r.bucket, r.part) for r in placed.select("bucket", "part").distinct().collect()):
        yield placed.where((F.col("bucket") == bucket) & (F.col("part") == part)).orderBy("item_id", "text").collect()


def matches(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), seed: int = SEED, covered: float = COVERED, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The kept columns of docs(doc_id, text), item_id, item_words, covered (words of the item in tiles), coverage (their share), and
    tiles, an array of item_begin, doc_begin, words: for each document and item of benchmark(item_id, text) with a coverage of
    covered or more.

    An item of fewer than seed words counts where all its words stand in a row; one without words never does. Null texts have no
    words. Equal items are one; a repeated document gives repeated rows. A text of any length is one row of a task; ties between tiles
    go to the first place. Other columns are ignored, whatever their names; keep can't name a column that is made here. Empty
    tables give an empty result.
    """
    not_made(keep, ("item_id", "item_words", "covered", "coverage", "tiles", "_text"))
    schema = docs.select(*keep).schema
    for name, kind in (("item_id", "long"), ("item_words", "long"), ("covered", "long"), ("coverage", "double")):
        schema = schema.add(name, kind)
    from pyspark.sql.types import ArrayType, StructType

    schema = schema.add("tiles", ArrayType(StructType.fromDDL("item_begin long, doc_begin long, words long")))
    kind = pa.list_(pa.struct([("item_begin", pa.int64()), ("doc_begin", pa.int64()), ("words", pa.int64())]))
    narrow = docs.select(*keep, F.col("text").alias("_text"))
    context, out = docs.sparkSession.sparkContext, None
    for part in _parts(benchmark, pass_bytes):
        sent = context.broadcast(([r.item_id for r in part], Index.of([r.text for r in part], seed)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, index = sent.value
            for batch in batches:
                for rows in slices(batch, "_text"):
                    found = []
                    for r, i, t in _compared(index, rows.column("_text"), covered):
                        n, c = len(index.words[i]), sum(x[2] for x in t)
                        found.append((r, ids[i], n, c, c / n, [dict(zip(("item_begin", "doc_begin", "words"), x)) for x in t]))
                    at = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in keep), *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, kind)))], [*keep, "item_id", "item_words", "covered", "coverage", "tiles"])

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, *, seed: int = SEED, covered: float = COVERED, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs(text, ...) that no item contaminates, with all their columns, whatever their names. Null and empty texts stay, as
    do all rows where the benchmark is empty or has no words; repeated rows stay or go together; a text of any length is one row of a
    task; empty in, empty out."""
    for part in _parts(benchmark, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Index.of([r.text for r in part], seed))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for rows in slices(batch):
                    good = np.ones(rows.num_rows, bool)
                    for r, _, _ in _compared(index, rows.column("text"), covered):
                        good[r] = False
                    yield rows.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
