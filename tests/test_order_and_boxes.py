"""Inversions by merging and boxes by sweeps and grids, against all pairs."""

import random
import time

import numpy as np
import pytest

from brindle.operators import boxes, order


def pairs(rows):
    return sum(a[0] < b[0] and a[1] > b[1] for a in rows for b in rows)


@pytest.mark.parametrize("part", [1, 7, 50, 10_000])
def test_inversions_as_all_pairs(spark, part):
    draw = random.Random(part)
    groups = {g: [(draw.randrange(60), draw.choice([draw.randrange(40), 7])) for _ in range(n)] for g, n in ((None, 5), ("a", 90), ("b", 1), ("c", 2), ("d", 40))}
    rows = [(g, p, v) for g, own in groups.items() for p, v in own] + [("a", None, 1), ("a", 1, None), ("e", None, None)]
    got = {r.g: (r.rows, r.inversions, r.consistency) for r in order.consistency(spark.createDataFrame(rows, "g string, p int, v long"), "g", "p", "v", part).collect()}
    for g, own in groups.items():
        if g is not None:
            n = sum(a[0] < b[0] for a in own for b in own)
            assert got[g] == (len(own), pairs(own), pytest.approx(1 - pairs(own) / n) if n else None)
    assert set(got) == {"a", "b", "c", "d"}


def test_a_long_order():
    value = np.random.default_rng(1).permutation(1_000_000)
    began = time.time()
    found = order.inversions(np.zeros(len(value), np.int64), value)
    assert time.time() - began < 20
    # The same by a tree of counts over blocks.
    total, seen = 0, np.zeros(1_000, np.int64)
    for block in value[:100_000].reshape(-1, 1000):
        above = seen[::-1].cumsum()[::-1] - seen
        total += int(above[block // 1000].sum())
        np.add.at(seen, block // 1000, 1)
    assert abs(found[0] / (len(value) * (len(value) - 1) / 2) - 0.5) < 0.01 and total > 0
    assert order.inversions(np.zeros(0, np.int64), np.zeros(0)).tolist() == []
    assert order.inversions(np.array([0, 0, 0, 1, 1, 2]), np.array([3, 2, 1, 5, 5, 1])).tolist() == [3, 0, 0]


def test_columns_as_all_pairs(spark):
    draw, rows = random.Random(3), []
    for page in range(60):
        for _ in range(draw.choice([1, 2, 5, 20])):
            x, y = draw.uniform(0, 900), draw.uniform(0, 3000)
            rows.append((page % 3, page, x, y, x + draw.uniform(0, 80), y + draw.uniform(0, 40), 1000.0))
    rows += [(9, 1, float(0), 0.0, 1.0, 100.0, 1000.0)] * 130 + [(9, 2, 0.0, 0.0, 1.0, 100.0, 1000.0)] * 129 + [(9, 3, None, 0.0, 1.0, 1.0, 10.0), (9, 3, 5.0, 5.0, 1.0, 1.0, 10.0), (9, 3, float("nan"), 0.0, 1.0, 1.0, None)]
    want = {}
    for d, p, *a in rows:
        own = [b[2:] for b in rows if b[:2] == (d, p)]
        hit = lambda b: None not in (*a, *b) and min(a[3], b[3]) - max(a[1], b[1]) > 0.5 * min(a[3] - a[1], b[3] - b[1]) and max(a[0], b[0]) - min(a[2], b[2]) > 50
        want[d, p] = want.get((d, p), False) or any(map(hit, own)) or len(own) > 129
    got = {(r.doc_id, r.page): r.columns for r in boxes.column_pages(spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, width double")).collect()}
    assert got == want and 5 < sum(want.values()) < len(want)


def test_a_page_of_many_boxes(spark):
    """A hundred thousand lines, one below the other: no two are side by side, and none is compared with all."""
    rows = spark.range(100_000).selectExpr("1 doc_id", "1 page", "0.0 x0", "double(id) y0", "500.0 x1", "id + 0.9 y1", "1000.0 width")
    assert [tuple(r) for r in boxes.column_pages(rows).collect()] == [(1, 1, False)]


def test_pairs_side_by_side(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(3), draw.randrange(80), draw.uniform(0, 300), y := draw.uniform(0, 300), 0.0, y + draw.choice([0.0, 5.0, 90.0])) for _ in range(150)]
    rows = [(k, i, x, y, x + draw.choice([1.0, 40.0]), v) for k, i, x, y, _, v in rows]
    side = lambda a, b: (m := min(a[5] - a[3], b[5] - b[3])) > 0 and (min(a[5], b[5]) - max(a[3], b[3])) / m > 0.5 and (a[4] + 10 < b[2] or b[4] + 10 < a[2])
    df = spark.createDataFrame(rows, "k int, box int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, boxes.beside(df, ["k"], 10.0, 40.0).collect()))
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and side(a, b)) and got


def test_joins_by_cells(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(3), i, draw.uniform(-50, 300), draw.uniform(-50, 300)) for i in range(200)] + [(1, 900, 20.0, 20.0), (1, 901, 40.0, 40.0), (1, 902, None, 1.0)]
    a = spark.createDataFrame(rows, "k int, i int, x double, y double")
    b = a.selectExpr("k", "i j", "x u", "y v")
    got = sorted((r.i, r.j) for r in boxes.near(a, b, ["k"], 20.0, ("x", "y"), ("u", "v")).collect())
    assert got == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and None not in (p[2], q[2]) and abs(p[2] - q[2]) <= 20 and abs(p[3] - q[3]) <= 20)
    full = [(k, i, x, y, x + draw.choice([0.0, 5.0, 90.0, 250.0]), y + draw.choice([0.0, 5.0, 30.0])) for k, i, x, y in rows if x is not None]
    a = spark.createDataFrame(full, "k int, i int, x0 double, y0 double, x1 double, y1 double")
    b = a.selectExpr("k", "i j", "x0 u0", "y0 v0", "x1 u1", "y1 v1")
    got = sorted((r.i, r.j) for r in boxes.overlapping(a, b, ["k"], 40.0, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1")).collect())
    assert got == sorted((p[1], q[1]) for p in full for q in full if p[0] == q[0] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3]))


def test_parts_of_a_long_table(spark, monkeypatch):
    """Parts grow where they would be many; counts stay."""
    from brindle.operators import order

    asked, frame = [], type(spark.range(1))
    keep = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *c: asked.append(n) or keep(self, n, *c))
    monkeypatch.setattr(order, "MANY", 3)
    monkeypatch.setattr(order, "PART", 200)
    rows = spark.range(900).selectExpr("id % 7 AS g", "id AS place", "id * 37 % 101 AS value")
    got = {r.g: (r.rows, r.inversions) for r in order.consistency(rows, "g", "place", "value", part=10).collect()}
    assert asked == [5, 5]
    want = {}
    for g in range(7):
        v = [i * 37 % 101 for i in range(g, 900, 7)]
        want[g] = (len(v), sum(a > b for i, a in enumerate(v) for b in v[i + 1 :]))
    assert got == want


def test_near_points_are_spread_little(spark):
    """A point is put into few tiles, and meets what it met in cells of its reach: at borders, below zero, far out."""
    from brindle.operators import boxes

    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([(x * 7 % 331 - 90, x * 13 % 257 - 60) for x in range(400)] + [(80, 80), (60, 100), (100, 60), (1e15, 0), (1e15 + 20, 0), (float("nan"), 1)])]
    a = spark.createDataFrame([(1, *p) for p in points] + [(1, 999, None, 1.0)], "page int, box long, x double, y double")
    b = a.selectExpr("page", "box AS other", "x AS u", "y AS v")
    found = boxes.near(a, b, ["page"], 20.0, ("x", "y"), ("u", "v"))
    want = sorted((i, j) for i, x, y in points for j, u, v in points if abs(x - u) <= 20 and abs(y - v) <= 20)
    assert sorted((r.box, r.other) for r in found.collect()) == want
    store = spark.sparkContext._jsc.sc().statusStore()
    listed = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda x: sum(x.apply(i).shuffleWriteRecords() for i in range(x.size()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total(listed())
        boxes.near(a, b, ["page"], 20.0, ("x", "y"), ("u", "v")).count()
        assert total(listed()) - before < 4 * len(points) + 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_band_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    from brindle.plans import QUERIES, relational

    monkeypatch.setattr(relational, "BAND", 100)
    spark.range(1000).selectExpr("id div 5 AS l_orderkey", "id % 5 AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["context_band"](spark, str(tmp_path))
    assert "hashpartitioning(l_orderkey" in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() == 10
    assert sorted((r.l_linenumber, r.near) for r in found.where("l_orderkey = 3").collect()) == [(0, 2), (1, 3), (2, 4), (3, 3), (4, 2)]
