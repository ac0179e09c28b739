"""How far one order agrees with another: inversions counted by merging, however long an order is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a part, which a task holds; parts beyond which they grow to that, as what parts exchange grows with their number's square.
PART, MANY = 1 << 20, 64


def inversions(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each run (numbered from 0, its values together and in order) how many pairs of it have the larger value first.

    Values become ranks, and the ranks' bits are merged from the highest down: values that agree above a bit stay together in their order,
    and where they differ in it each 0 counts the 1s before it."""
    total = np.zeros(int(run[-1]) + 1 if len(run) else 0, np.int64)
    if not len(run):
        return total
    by = np.lexsort((value, run))
    rank = np.zeros(len(run), np.int64)
    new = (np.diff(run[by], prepend=-1) != 0) | (np.diff(value[by], prepend=value[by[0]]) != 0)
    rank[by] = np.cumsum(new)  # equal values are equal
    group = run.astype(np.int64)
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        one = rank >> bit & 1
        first = np.flatnonzero(np.diff(group, prepend=-1) != 0)
        size = np.diff(first, append=len(group))
        ones = np.cumsum(one) - one  # before each
        ones -= np.repeat(ones[first], size)
        total += np.bincount(run, np.where(one == 0, ones, 0), len(total)).astype(np.int64)
        zeros = np.arange(len(one)) - np.repeat(first, size) - ones
        many = np.repeat(np.add.reduceat(1 - one, first), size)
        at = np.repeat(first, size) + np.where(one == 0, zeros, many + ones)
        group2, rank2, run2 = np.empty_like(group), np.empty_like(rank), np.empty_like(run)
        group2[at], rank2[at], run2[at] = group * 2 + one, rank, run
        group, rank, run = np.cumsum(np.diff(group2, prepend=group2[0]) != 0), rank2, run2
    return total


def _counted(keys: tuple[str, ...], sign: int):
    """Sums of a part's inversions for each different _group; rows come by keys, then in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(rows.num_rows, bool)
        for k in keys:
            codes = rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change |= np.diff(codes, prepend=codes[0]) != 0
        found = inversions(np.cumsum(change), rows.column("_value").to_numpy())
        first = np.flatnonzero(np.append(True, change[1:]))
        yield pa.RecordBatch.from_arrays([rows.column("_group").combine_chunks().take(pa.array(first)), pa.array(sign * found)], ["_group", "n"])

    return run


def _between(cells: pa.Table) -> pa.Table:
    """Pairs of one group in different parts by place and by value: a count for each two parts, in the order of places."""
    p, v, n = (cells.column(c).to_numpy().astype(np.int64) for c in ("_p", "_v", "n"))
    order = np.lexsort((v, p))
    p, v, n = p[order], np.unique(v, return_inverse=True)[1].reshape(-1)[order], n[order]
    before, total = np.zeros(int(v.max()) + 1, np.int64), 0
    for own in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
        above = before.sum() - np.cumsum(before)
        total += int((above[v[own]] * n[own]).sum())
        np.add.at(before, v[own], n[own])
    return pa.table({"_group": cells.column("_group").slice(0, 1), "n": pa.array([total], pa.int64())})


def consistency(rows: DataFrame, group: str, place: str, value: str, part: int = PART) -> DataFrame:
    """group, rows, pairs (of different places), inversions, consistency of rows(group, place, value): 1 less the share of pairs whose values stand in the other order than
    their places, of all pairs of different places; null where there is none. Pairs of equal values are no inversions.

    Rows are cut into parts of about part, or of up to PART where these would be over MANY, by (group, place), and again by (group, value). Pairs within one part by place are counted there;
    pairs of different ones within a part by value are counted there; for all others the parts' order decides, and the sizes of what two
    parts have in common count them. So nothing is joined with itself and a group of any length is spread. Rows without a group, place or
    value don't count. place and value are integers, dates or decimals cast to long, or doubles.
    """
    kind = rows.schema[group].dataType.simpleString()
    number = lambda c: F.col(c) if rows.schema[c].dataType.simpleString() == "double" else F.col(c).cast("long")
    known = rows.select(F.col(group).alias("_group"), number(place).alias("_place"), number(value).alias("_value")).dropna()
    n = known.count()
    parts = max(1, min(-(-n // part), max(MANY, -(-n // PART))))
    by_place = known.repartitionByRange(parts, "_group", "_place", "_value").sortWithinPartitions("_group", "_place", "_value")
    placed = written(by_place.withColumn("_p", F.spark_partition_id()))
    by_value = placed.repartitionByRange(parts, "_group", "_value", "_place").withColumn("_v", F.spark_partition_id())
    dealt = written(by_value.sortWithinPartitions("_group", "_p", "_place", "_value"))
    form = f"_group {kind}, n long"
    # Files keep the parts; a reader may put several into a task or cut one, so parts are gathered again by their number.
    gathered = lambda df, by, *order: df.repartition(parts, by).sortWithinPartitions(by, *order)
    inside = gathered(placed, "_p", "_group", "_place", "_value").mapInArrow(_counted(("_p", "_group"), 1), form)
    across = gathered(dealt, "_v", "_group", "_place", "_value").mapInArrow(_counted(("_v", "_group"), 1), form)
    both = gathered(dealt, "_v", "_group", "_p", "_place", "_value").mapInArrow(_counted(("_v", "_group", "_p"), -1), form)
    cells = dealt.groupBy("_group", "_p", "_v").agg(F.count(F.lit(1)).alias("n"))
    ends = cells.groupBy("_group").agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("_p", "_v") for f in (F.min, F.max)])
    wide = ends.where("min_p < max_p and min_v < max_v").select("_group")  # few: others lie within one part
    between = cells.join(wide, "_group", "left_semi").groupBy("_group").applyInArrow(_between, form)
    found = inside.unionByName(across).unionByName(both).unionByName(between).groupBy("_group").agg(F.sum("n").alias("inversions"))
    two = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    at_place = placed.groupBy("_group", "_place").agg(F.count(F.lit(1)).alias("n"))
    sizes = at_place.groupBy("_group").agg(F.sum("n").alias("rows"), F.sum(two("n")).alias("tied"))
    pairs = two("rows") - F.col("tied")
    return sizes.join(found, "_group").select(F.col("_group").alias(group), "rows", pairs.alias("pairs"), "inversions", F.when(pairs > 0, 1 - F.col("inversions") / pairs).alias("consistency"))
