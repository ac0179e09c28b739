"""Eligibility, integrity audits and bookkeeping over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key parent lacks."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(child_key) == F.col("_parent"), "left_anti")


def repeated(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_lookup(asked: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """asked with value where found has exactly one row of the key, else null."""
    one = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return asked.join(one, key, "left")


def set_equality(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """only_a, only_b, equal: how many different keys one side has alone, in one row."""
    left, right = a.select(F.col(key_a).alias("k")).distinct().withColumn("a", F.lit(1)), b.select(F.col(key_b).alias("k")).distinct().withColumn("b", F.lit(1))
    both = left.join(right, "k", "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return both.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def manifest_findings(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, finding of a manifest(path, bytes, sha256) against files(path, bytes, sha256): missing, not listed, repeated, or differs."""
    listed = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("bytes").alias("b"), F.min("sha256").alias("h"))
    both = listed.join(files, "path", "full_outer")
    finding = F.when(F.col("n") > 1, "repeated").when(F.col("n").isNull(), "not listed").when(F.col("sha256").isNull(), "missing").when((F.col("b") != F.col("bytes")) | (F.col("h") != F.col("sha256")), "differs")
    return both.select("path", finding.alias("finding")).where("finding is not null")


def rubric_reason(weights: Column, criteria: Column) -> Column:
    """Why a weighted rubric can't be used, null if it can."""
    bad = F.exists(weights, lambda w: w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0))
    return F.when(weights.isNull() | criteria.isNull() | (F.size(criteria) == 0), "empty").when(F.size(weights) != F.size(criteria), "lengths differ").when(bad, "not finite or negative").when(F.aggregate(weights, F.lit(0.0), lambda s, w: s + w) <= 0, "no weight")


def division(pairs: DataFrame, required: DataFrame, group: str, item: str) -> DataFrame:
    """Groups of pairs(group, item) all of whose items are in required(item): those that can be used whole."""
    known = required.select(F.col(item).alias("_item")).distinct().withColumn("_known", F.lit(1))
    return pairs.distinct().join(known, F.col(item) == F.col("_item"), "left").groupBy(group).agg(F.count(F.lit(1)).alias("required"), F.count("_known").alias("present")).where("required = present").drop("present")


#: Rows of a digest, and levels of digests: so many rows of one group at most meet as one array.
FAN, LEVELS = 1024, 3


def fingerprint(rows: DataFrame, by: list[str], row: Column, order: Column) -> DataFrame:
    """fingerprint and number of rows of each group: digests of FAN places of the order (a whole number, one row to a place) give a digest,
    FAN of those the next, LEVELS times, and what is left the fingerprint. So a group is never one array, and any change shows."""
    level = rows.select(*by, order.cast("long").alias("o"), F.sha2(row, 256).alias("h"), F.lit(1).cast("long").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda s: s["h"]), ""), 256).alias("h")
    for _ in range(LEVELS):
        level = level.groupBy(*by, F.floor(F.col("o") / FAN).alias("up")).agg(whole, F.sum("n").alias("n")).withColumnRenamed("up", "o")
    return level.groupBy(*by).agg(whole, F.sum("n").alias("rows")).withColumnRenamed("h", "fingerprint")


def hash_sample(rows: DataFrame, strata: list[str], id: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum in the order of a seeded hash: the same on every run, and a smaller n takes a part of a larger one's."""
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(key, id))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key. A maximum is taken in each task first, so a hot key costs one row a task."""
    newest = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("s")
    return rows.groupBy(key).agg(newest).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])


def page(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """One page of a listing, from 1."""
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out
