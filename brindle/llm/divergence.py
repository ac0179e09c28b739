"""Divergence between the sources of each language, by a systolic tournament.

Terms are counted in tasks and added up by Spark; those in few documents go. The terms of a language are dealt by hash to ranges of
about TERMS, and a source's counts in a range are one compressed vector. The sources of a language are dealt to cells of CELL; a cell's
vectors of a range rest in a table that is bucketed by language, range and cell, so that no round moves them. In round 0 the language's own
vector visits each cell: sources of a cell meet there, and a heap for each keeps its best terms of the range. In round r the vectors
of cell i + r visit cell i, in a ring, so after half as many rounds as there are cells each two have met once, and a meeting gives both
directions. Sums over ranges are a source pair's value. A task holds the vectors of two cells in one range.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _without_shuffles, scratch, slices, spill, utf8, word_spans
from .tokenbin import decode_stream, encode_stream

#: Terms of a range, sources of a cell, and rows of counts that a task adds up before it sends them.
TERMS, CELL, ROWS = 1 << 12, 8, 1 << 18
#: Below it a thousandfold denominator is still a long.
_DIVISOR = 9 * 10**15

# Letters of ASCII in lower case and all bytes of other characters; what stands between terms becomes a space.
_TERM = np.full(256, 32, np.uint8)
_TERM[128:] = np.arange(128, 256)
_TERM[97:123] = _TERM[65:91] = np.arange(97, 123)


def _terms(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms of a batch, and row and number of each occurrence."""
    data, offsets = utf8(part.column("text"))
    flat = _TERM[data[: offsets[-1]]]
    starts, ends, row = word_spans(flat, offsets)
    letters = flat[offsets[0] :]
    letters = letters[letters != 32]
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    all_terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters)))
    coded = all_terms.dictionary_encode()
    return coded.dictionary, row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of what a task reads, added up as far as ROWS rows hold it."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def added() -> pa.Table:
        one = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return one.rename_columns({"n_sum": "n", "docs_sum": "docs"})

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(groups)
        of = table.column("group").combine_chunks()
        lang, source = (pa.array([g[k] for g in names], pa.string()).take(of) for k in (0, 1))
        yield from pa.table([lang, source, *(table.column(c) for c in ("term", "n", "docs"))], ["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        for part in slices(batch):
            terms, row, code = _terms(part)
            if not len(code):
                continue
            of_row = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
            in_row, n = np.unique(row * len(terms) + code, return_counts=True)
            key, at = np.unique(of_row[in_row // len(terms)] * len(terms) + in_row % len(terms), return_inverse=True)
            total, docs = np.zeros(len(key), np.int64), np.bincount(at.reshape(-1), minlength=len(key))
            np.add.at(total, at.reshape(-1), n)
            held.append(pa.table([pa.array(key // len(terms)), terms.take(pa.array(key % len(terms))), pa.array(total), pa.array(docs)], ["group", "term", "n", "docs"]))
            if sum(t.num_rows for t in held) > ROWS:
                one = added()
                held = [one]
                if one.num_rows > ROWS // 2:
                    yield from out(one)
                    held = []
                pa.default_memory_pool().release_unused()
    if held:
        yield from out(added())


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Counts n at ascending places: gaps and counts as streams of byte-aligned numbers, the counts' upper halves where there are any."""
    parts = [encode_stream(np.diff(at, prepend=0)), encode_stream(n & 0xFFFFFFFF), encode_stream(n >> 32) if (n >> 32).any() else b""]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpacked(blob: bytes | None, size: int) -> np.ndarray:
    """The counts at all places."""
    out, at, parts = np.zeros(size, np.int64), 0, []
    if not blob:
        return out
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        parts.append(decode_stream(blob[at + 4 : at + 4 + n]).astype(np.int64) if n else 0)
        at += 4 + n
    out[np.cumsum(parts[0])] = parts[1] + (parts[2] << 32 if isinstance(parts[2], np.ndarray) else 0)
    return out


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = batch.column("counts")
        blobs = []
        for i in range(batch.num_rows):
            own = counts[i].values
            at, n = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
            order = np.argsort(at)
            blobs.append(packed(at[order], n[order]))
        kept = [c for c in batch.schema.names if c != "counts"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(blobs, pa.binary())], [*kept, "vector"])


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * kept)), exactly: three digits of the quotient at a time."""
    whole = total + 2 * kept
    rest = counts + 2
    if whole >= _DIVISOR:
        return np.array([1 + 10**9 * int(c) // whole for c in rest.tolist()], np.int64)
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _of(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sources, counts and shares of vectors of one range, a row each."""
    size = table.column("terms")[0].as_py()
    counts = [unpacked(v, size) for v in table.column("vector").to_pylist()]
    p = [shares(c, n, v) if size else c for c, n, v in zip(counts, table.column("total").to_pylist(), table.column("kept").to_pylist())]
    return table.column("source").to_pylist(), np.stack(counts), np.stack(p)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pairs(lang: str, met: list[tuple[str, str, int]]) -> dict:
    """Both directions of each meeting."""
    both = met + [(b, a, v) for a, b, v in met]
    return {"lang": [lang] * len(both), "source": [x[0] for x in both], "item": [x[1] for x in both], "range": [None] * len(both), "place": [None] * len(both), "value": [x[2] for x in both]}


_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("range", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])


def _at_home(top: int):
    """Round 0: the vectors of a cell, and the language's that visits it."""

    def run(own: pa.Table, guest: pa.Table) -> pa.Table:
        if not own.num_rows or not guest.num_rows:
            return _MET.empty_table()
        lang, number = own.column("lang")[0].as_py(), own.column("range")[0].as_py()
        sources, counts, p = _of(own)
        q = _of(guest)[2][0]
        out = _pairs(lang, [(sources[i], sources[j], int(v)) for i in range(len(sources)) for j, v in enumerate(_divergence(p[i], p[i + 1 :]).sum(1).tolist(), i + 1)])
        for i, source in enumerate(sources):
            at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = _divergence(p[i][at], q[at])
            if len(at) > top:
                least = np.partition(value, len(at) - top)[len(at) - top]
                at, value = at[value >= least], value[value >= least]
            for v, place in heapq.nsmallest(top, zip((-value).tolist(), at.tolist())):
                for name, x in (("lang", lang), ("source", source), ("item", None), ("range", number), ("place", place), ("value", -v)):
                    out[name].append(x)
        return pa.table(out, _MET)

    return run


def _visited(own: pa.Table, guests: pa.Table) -> pa.Table:
    """A later round: the vectors of a cell, and those of the one that visits it."""
    if not own.num_rows or not guests.num_rows:
        return _MET.empty_table()
    (mine, _, p), (theirs, _, q) = _of(own), _of(guests)
    return pa.table(_pairs(own.column("lang")[0].as_py(), [(a, b, int(v)) for i, a in enumerate(mine) for b, v in zip(theirs, _divergence(p[i], q).sum(1).tolist())]), _MET)


_KEY = ("lang", "range", "cell")
_FIELDS = "lang string, source string, item string, range int, place int, value long"


def audit(docs: DataFrame, *, least: int = 10, top: int = 10, terms: int = TERMS, cell: int = CELL) -> DataFrame:
    """lang, source, part, item, value, rank of docs(text, lang, source), null being '' in all three.

    Terms are runs of letters of ASCII, lower-cased, and other characters beyond ASCII; a language keeps those in least or more of its rows.
    A group, (lang, source), and each lang give each kept term a share of 10 ** 9 with 2 added to each count, and two shares p and q
    differ by floor((p - q) ** 2 / (p + q)). Part pair: item is each other source of the language, value the sum over all kept terms, 0
    where none is kept. Part term: item is a term that the group has and whose share is above the language's, the top ones. Ranks go by
    value, the largest first, ties by the item's bytes.

    Groups without terms are groups; a lone source has no pair. Repeated rows and ids count each for itself. Texts of any
    length are rows of a task. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    part = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = spill(part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), compression="zstd")
    kept = spill(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "n"), compression="zstd")
    groups = rows.select("lang", "source").distinct().withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = spill(groups)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sizes, "lang", "left").fillna(0, ["kept", "total"])
    up = lambda n, d: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(float(d)))).cast("int")
    langs = spill(langs.select("lang", "kept", "total", up("kept", terms).alias("ranges"), up("sources", cell).alias("cells")))
    hashed = kept.join(langs.select("lang", "ranges"), "lang").withColumn("range", F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy("term")) - 1
    named = spill(hashed.select("lang", "range", place.alias("place"), "term", "n"), compression="zstd")
    gathered = F.collect_list(F.struct(F.col("place").alias("at"), "n")).alias("counts")
    of_group = counts.select("lang", "source", "term", "n").join(named.select("lang", "term", "range", "place"), ["lang", "term"]).groupBy("lang", "source", "range").agg(gathered, F.sum("n").alias("held"))
    vectors = spill(of_group.mapInArrow(_compressed, "lang string, source string, range int, held long, vector binary"))
    of_lang = named.groupBy("lang", "range").agg(gathered, F.count(F.lit(1)).alias("terms")).mapInArrow(_compressed, "lang string, range int, terms long, vector binary")
    ranges = langs.select("lang", "kept", "total", "cells", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
    of_lang = spill(ranges.join(of_lang, ["lang", "range"], "left").fillna(0, ["terms"]))
    totals = vectors.groupBy("lang", "source").agg(F.sum("held").alias("held"))
    grid = groups.join(totals, ["lang", "source"], "left").join(of_lang.select("lang", "range", "kept", "cells", "terms"), "lang")
    grid = grid.join(vectors.select("lang", "source", "range", "vector"), ["lang", "source", "range"], "left")
    homes = grid.select("lang", "range", F.pmod(F.col("number"), F.col("cells")).alias("cell"), "cells", "source", F.coalesce("held", F.lit(0)).alias("total"), "kept", "terms", "vector")
    most, all_cells = langs.agg(F.max("cells"), F.sum(F.col("cells") * F.col("ranges"))).first()
    homes = _resident(homes, max(1, min(all_cells or 1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    at = homes.groupBy(*_KEY)
    guests = of_lang.select("lang", "range", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit("").alias("source"), "total", "kept", "terms", "vector")
    met = [spill(at.cogroup(guests.groupBy(*_KEY)).applyInArrow(_at_home(top), _FIELDS))]
    for r in range(1, (most or 1) // 2 + 1):
        host = F.pmod(F.col("cell") - r, F.col("cells"))
        once = (F.lit(2 * r) < F.col("cells")) | (F.lit(2 * r) == F.col("cells")) & (host < r)
        guests = homes.where(once).withColumn("cell", host)
        met.append(spill(at.cogroup(guests.groupBy(*_KEY)).applyInArrow(_visited, _FIELDS)))
    pairs = met[0].where("item is not null")
    for x in met[1:]:
        pairs = pairs.unionByName(x)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = met[0].where("item is null").drop("item").join(named.select("lang", "range", "place", F.col("term").alias("item")), ["lang", "range", "place"])
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(best, "term").where(F.col("rank") <= top))


def _resident(homes: DataFrame, buckets: int) -> DataFrame:
    """homes as a table bucketed by language, range and cell."""
    name = f"brindle_{uuid.uuid4().hex}"
    path = scratch(homes.sparkSession, name)
    with _without_shuffles(homes.sparkSession):
        homes.repartition(buckets, *_KEY).write.bucketBy(buckets, *_KEY).sortBy(*_KEY).options(path=path).saveAsTable(name)
    return homes.sparkSession.table(name)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS n FROM x GROUP BY ALL),
p AS MATERIALIZED (SELECT x.lang, x.source, x.term, x.n, CAST(1 + 1000000000 * CAST(x.n + 2 AS HUGEINT) // (t.n + 2 * v.v) AS BIGINT) AS p, CAST(1 + 1000000000 * CAST(x.all_n + 2 AS HUGEINT) // (v.n + 2 * v.v) AS BIGINT) AS q
      FROM x JOIN t ON x.lang = t.lang AND x.source = t.source JOIN v ON x.lang = v.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
