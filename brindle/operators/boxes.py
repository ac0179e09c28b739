"""Boxes on pages, without pairing all of a page: sweeps with a bounded active set, and joins by grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A page with more boxes at one height counts as set in columns, as do boxes side by side this far apart, as a share of the
# page's width, over more than this share of the lower one's height. A tile's side, as a multiple of the reach of near points.
ACTIVE, GAP, SIDE, TILE = 128, 0.05, 0.5, 4


class _Sweep:
    """The boxes of one page from top to bottom; active are those that reach below the top of the next."""

    def __init__(self, width: float):
        self.gap, self.active, self.found = width * GAP, np.zeros((0, 4)), False

    def put(self, box: tuple[float, float, float, float]) -> None:
        if self.found:
            return
        x0, y0, x1, y1 = box
        live = self.active[self.active[:, 3] > y0]
        common = np.minimum(live[:, 3], y1) - np.maximum(live[:, 1], y0)
        beside = common > SIDE * np.minimum(live[:, 3] - live[:, 1], y1 - y0)
        apart = np.maximum(live[:, 0], x0) - np.minimum(live[:, 2], x1) > self.gap
        self.found = len(live) > ACTIVE or bool((beside & apart).any())
        self.active = np.concatenate([live, [box]])


def column_pages(boxes: DataFrame) -> DataFrame:
    """doc_id, page, columns of boxes(doc_id, page, x0, y0, x1, y1, width): whether a page looks set in columns. Boxes of a page pass by in
    order of their tops, a page of any number; ACTIVE of them and one are held. Boxes with a null or a number that isn't finite, or
    whose corners are in no order, say nothing; a page of such boxes only has no columns. width is that of the page's first box."""
    kind = boxes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sweep, out = None, None, []

        def table() -> pa.RecordBatch:
            of = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(list(of[0]), batch_kind), pa.array(list(of[1]), pa.int32()), pa.array(list(of[2]), pa.bool_())], ["doc_id", "page", "columns"])

        batch_kind = None
        for batch in batches:
            batch_kind = batch.schema.field("doc_id").type
            for doc, page, width, *box in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "width", "x0", "y0", "x1", "y1"))):
                if sweep is None or (doc, page) != last:
                    if sweep is not None:
                        out.append((*last, sweep.found))
                    last, sweep = (doc, page), _Sweep(width or 0.0)
                if None not in box and np.isfinite(box).all() and box[0] <= box[2] and box[1] <= box[3]:
                    sweep.put(tuple(box))
            if len(out) > 8192:
                yield table()
                out.clear()
        if sweep is not None:
            out.append((*last, sweep.found))
            yield table()

    rows = boxes.select("doc_id", F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width")])
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y0", "x0", "y1", "x1").mapInArrow(run, f"doc_id {kind}, page int, columns boolean")


def near(a: DataFrame, b: DataFrame, on: list[str], reach: float, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """Rows of a and b, equal in on, whose points (columns left of a, right of b) are no more than reach apart in both directions. Points lie in
    tiles of TILE times that side, and one of a is put into those that its reach touches (2.25 on the average), so it meets the points around
    it, not all of its page."""
    tile = lambda x: F.floor(x / F.lit(float(TILE * reach or 1)))
    slack = lambda c: F.lit(float(reach)) + F.abs(F.col(c)) * 2.0**-51  # noqa: E731  # as the sum is rounded
    touched = lambda c: F.explode(F.sequence(tile(F.col(c) - slack(c)), tile(F.col(c) + slack(c))))
    spread = a.withColumn("_cx", touched(left[0])).withColumn("_cy", touched(left[1]))
    placed = b.withColumns({"_cx": tile(F.col(right[0])), "_cy": tile(F.col(right[1]))})
    close = (F.abs(F.col(left[0]) - F.col(right[0])) <= reach) & (F.abs(F.col(left[1]) - F.col(right[1])) <= reach)
    return spread.join(placed, [*on, "_cx", "_cy"]).where(close).drop("_cx", "_cy")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], size: float, left: tuple[str, str, str, str], right: tuple[str, str, str, str]) -> DataFrame:
    """Rows of a and b, equal in on, whose boxes (columns x0, y0, x1, y1) have an area in common. A box lies in all cells of a grid of this size
    that it touches; two meet once, in the cell of their common area's first corner."""
    cell = lambda c: F.floor(c / F.lit(float(size)))

    def spread(df: DataFrame, c: tuple[str, str, str, str]) -> DataFrame:
        whole = df.where((F.col(c[0]) <= F.col(c[2])) & (F.col(c[1]) <= F.col(c[3])))
        return whole.withColumn("_cx", F.explode(F.sequence(cell(F.col(c[0])), cell(F.col(c[2]))))).withColumn("_cy", F.explode(F.sequence(cell(F.col(c[1])), cell(F.col(c[3])))))

    x0, y0 = F.greatest(left[0], right[0]), F.greatest(left[1], right[1])
    area = (F.least(left[2], right[2]) > x0) & (F.least(left[3], right[3]) > y0)
    return spread(a, left).join(spread(b, right), [*on, "_cx", "_cy"]).where(area & (cell(x0) == F.col("_cx")) & (cell(y0) == F.col("_cy"))).drop("_cx", "_cy")


def beside(boxes: DataFrame, on: list[str], gap: float, size: float) -> DataFrame:
    """Pairs, in on, of boxes(box, x0, y0, x1, y1) that stand side by side: box, other, of over SIDE of the lower one's height in common and more
    than gap between them. Boxes lie in all strips of size that they touch, and two meet once, in the strip where their common height begins."""
    strip = lambda c: F.floor(c / F.lit(float(size)))
    own = boxes.where("y0 < y1").withColumn("_strip", F.explode(F.sequence(strip(F.col("y0")), strip(F.col("y1")))))
    other = own.select(*on, "_strip", *[F.col(c).alias(f"_{c}") for c in ("box", "x0", "y0", "x1", "y1")])
    top = F.greatest("y0", "_y0")
    common, lower = F.least("y1", "_y1") - top, F.least(F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0"))
    apart = (F.col("x1") + gap < F.col("_x0")) | (F.col("_x1") + gap < F.col("x0"))
    met = own.join(other, [*on, "_strip"]).where((F.col("box") < F.col("_box")) & (common > 0) & (common / lower > SIDE) & apart & (strip(top) == F.col("_strip")))
    return met.select(*on, "box", F.col("_box").alias("other"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Of two boxes x0, y0, x1, y1."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(width * height, area(a) + area(b) - width * height), F.lit(0.0))
