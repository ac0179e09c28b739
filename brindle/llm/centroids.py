"""Lloyd's clustering of integer vectors by weighted deduplication.

Vectors that are equal after quantisation are one vector with a weight. The rounds run over the different vectors only: each task
sends one row a cluster, the weighted sums of its components, and Spark adds them up, so a round moves a few rows a task and the
driver sees a row a cluster. Assignments are joined back to the ids of all rows at the end; the few vectors that many rows share
meet their rows in a broadcast, all others in a join by hash. Sums are exact integers, so centroids don't depend on how
rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill

#: A vector that more than one of HOT rows holds is joined by broadcast: HOT rows of a vector each at most.
HOT = 256
#: Below the first, products of 64 components are exact as double; below the second, squared distances fit a long.
_EXACT, _LONG = 1 << 22, 1 << 27
_ROWS = 8192


def quantised(column: str, size: int, factor: int) -> Column:
    """floor(factor * x) of each component, as long; null unless there are size components, all finite."""
    x = F.col(column).cast("array<double>")
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * F.lit(float(factor)))))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance to it. Both hold int64."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = max(int(rows.max()), -int(rows.min()), int(centroids.max()), -int(centroids.min()))
    if largest >= _LONG:
        raise ValueError("components of 2 ** 27 and more have distances that don't fit a long")
    if largest < _EXACT // max(1, int(np.sqrt(rows.shape[1]))):
        x, c = rows.astype(float), centroids.astype(float)
        d = ((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)).astype(np.int64)
    else:
        d = np.stack([((rows - c) ** 2).sum(1) for c in centroids], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(rows)), at]


def _rows(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    flat = batch.column(column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _summed(centroids: np.ndarray):
    """cluster, and in decimal its weight, inertia and weighted sums of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        count, inertia, sums = [0] * k, [0] * k, [[0] * size for _ in range(k)]
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                part = batch.slice(begin, _ROWS)
                rows, weight = _rows(part, "v", size), part.column("weight").to_numpy(zero_copy_only=False)
                at, distance = nearest(rows, centroids)
                fits = int(np.abs(rows).max()) * int(weight.sum()) < 1 << 62 and int(distance.max()) * int(weight.sum()) < 1 << 62
                w, r, d = (weight, rows, distance) if fits else (weight.astype(object), rows.astype(object), distance.astype(object))
                for c in np.unique(at).tolist():
                    own = at == c
                    count[c] += int(w[own].sum())
                    inertia[c] += int((d[own] * w[own]).sum())
                    sums[c] = [a + int(b) for a, b in zip(sums[c], (r[own] * w[own, None]).sum(0))]
        some = [c for c in range(k) if count[c]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([[str(x) for x in (count[c], inertia[c], *sums[c])] for c in some], pa.list_(pa.string()))], ["cluster", "sums"])

    return run


def _totals(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Weight, inertia and component sums of each cluster that has vectors, exact at any size: the driver gets size + 2 rows a cluster."""
    part = distinct.mapInArrow(_summed(centroids), "cluster int, sums array<string>")
    total = part.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("string").alias("x"))
    out: dict[int, list[int]] = {}
    for r in sorted(total.collect(), key=lambda r: (r.cluster, r.i)):
        out.setdefault(r.cluster, []).append(int(r.x))
    return {c: (x[0], x[1], x[2:]) for c, x in out.items()}


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(_rows(batch, "v", centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("weight"), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], ["v", "weight", "cluster", "distance"])

    return run


def _long(x: int) -> int:
    if x >= 1 << 63:
        raise ValueError(f"a sum of squared distances doesn't fit a long: {x}")
    return x


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, dict[int, tuple[int, int, list[int]]]]:
    """The centroids after so many rounds over distinct(v, weight), and the totals of the assignment to them. A round that moves no
    centroid is the last that is run, for all after it would do the same."""
    for n in range(rounds + 1):
        totals = _totals(distinct, centroids)
        if n == rounds:
            break
        moved = np.array([[s // totals[c][0] for s in totals[c][2]] if c in totals else row for c, row in enumerate(centroids.tolist())], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids, totals


def clusters(vectors: DataFrame, *, id: str = "vec_id", column: str = "embedding", size: int = 64, factor: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each row of vectors(id, column) that has size
    components, none null or not finite; other rows take no part. Components become floor(factor * x).

    Centroids begin as the k rows with the smallest sha256 of "seed:id" (equal ids by their components, null ids last), in that order; fewer
    rows give fewer centroids. Equal vectors of different ids may begin as centroids of equal place: the smaller number gets all. Repeated
    rows count and are returned each for itself, null ids too. An empty table gives an empty result. Other columns are ignored, whatever
    their names. Components of 2 ** 27 and more, or inertias of 2 ** 63, are an error, for their squares don't fit the result.
    """
    kept = vectors.select(F.col(id).alias("_id"), quantised(column, size, factor).alias("v")).where(F.col("v").isNotNull())
    distinct = spill(kept.groupBy("v").agg(F.count(F.lit(1)).alias("weight")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    fields = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    kind = vectors.schema[id].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"`{id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, totals = lloyd(distinct, np.array([r.v for r in first], np.int64), rounds)
    rows, inertia = sum(t[0] for t in totals.values()), _long(sum(t[1] for t in totals.values()))
    made = vectors.sparkSession.createDataFrame([(c, _long(t[1]), inertia, digest(centroids[c].tolist())) for c, t in sorted(totals.items())], fields)
    assigned = distinct.mapInArrow(_assigned(centroids), "v array<long>, weight long, cluster int, distance long").withColumn("h", F.xxhash64("v"))
    hot = F.col("weight") * F.lit(HOT) > F.lit(rows)  # fewer than HOT of them
    few = [r.h for r in distinct.where(hot).select(F.xxhash64("v").alias("h")).collect()]
    each = kept.withColumn("h", F.xxhash64("v"))
    in_few = F.col("h").isin(few) if few else F.lit(False)
    parts = [each.where(~in_few).join(assigned.where(~in_few), ["h", "v"])]
    if few:
        parts.append(each.where(in_few).join(F.broadcast(assigned.where(in_few)), ["h", "v"]))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.join(F.broadcast(made), "cluster").select(F.col("_id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
