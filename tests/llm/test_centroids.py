"""Lloyd's rounds over weighted distinct vectors, against the same rounds over all rows in plain Python."""

import hashlib

import numpy as np
import pytest

from brindle.llm import centroids

FIELDS = "vec_id long, embedding array<double>, label int, v string, h long, weight int, cluster int, distance string, _id int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", 1, 2, 3, "d", 4) for i, e in rows], FIELDS)


def brute(rows, size, factor, k, rounds):
    import math

    kept = [(i, tuple(math.floor(factor * x) for x in e)) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    at = [e for _, e in sorted(kept, key=key)[:k]]
    near = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, e in kept:
            own.setdefault(near(e)[1], []).append(e)
        at = [tuple(sum(x) // len(own[n]) for x in zip(*own[n])) if n in own else c for n, c in enumerate(at)]
    found = [(i, *near(e)[::-1]) for i, e in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(len(at))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, n, d in found), key=repr)


def got(spark, rows, **options):
    found = centroids.clusters(table(spark, rows), **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("spread, size, factor", [(1.0, 3, 8), (0.2, 2, 4), (10_000.0, 3, 1024)])
def test_as_brute_force(spark, spread, size, factor):
    """Small factors make many equal vectors and ties; large components leave the products that are exact as double."""
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(0, spread, size)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000, rows[3][1]), (2000, rows[3][1]), (2000, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    rows += [(3000, None), (3001, [0.5]), (3002, [None] * size), (3003, [float("nan")] * size), (3004, [float("-inf")] * size), (3005, []), (3006, [0.1] * (size + 1))]
    assert got(spark, rows, size=size, factor=factor, rounds=4) == brute(rows, size, factor, 8, 4)


def test_fewer_rows_than_centroids_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [-1.0, 2.0])]
    assert got(spark, rows, size=2) == brute(rows, 2, 1024, 8, 10)
    assert got(spark, [], size=2) == [] and got(spark, [(1, None)], size=2) == []


def test_a_hot_vector_and_the_rest(spark, monkeypatch):
    monkeypatch.setattr(centroids, "HOT", 10)
    r = np.random.default_rng(6)
    rows = [(i, [0.25, 0.25]) for i in range(90)] + [(100 + i, r.normal(0, 1, 2).tolist()) for i in range(60)]
    assert got(spark, rows, size=2, factor=16) == brute(rows, 2, 16, 8, 10)


def test_too_large(spark):
    with pytest.raises(Exception, match="fit a long"):
        got(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], size=2)


def test_sums_beyond_a_long():
    big = np.full((2, 2), (1 << 27) - 1, np.int64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(big.tolist(), pa.list_(pa.int64())), pa.array([1 << 40, 1 << 41], pa.int64())], ["v", "weight"])
    (out,) = centroids._summed(np.zeros((1, 2), np.int64))(iter([batch]))
    value, weight = (1 << 27) - 1, 3 << 40
    assert out.column("sums")[0].as_py() == [str(weight), str(2 * value * value * weight), str(value * weight), str(value * weight)]
