"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys. Each source's key range is cut into buckets of about BUCKET documents, and these are taken together in
groups of GROUP. Sums are added up inside a bucket, inside a group, and over the groups of a source, by windows over each, so no
task holds a whole source, nor a row for each of its buckets. The order is that of the keys, so reruns agree, and a source is cut at its exact budget: whole repeats first,
then a prefix of the key order, the last document of it in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, spill, words_in

BUCKET, GROUP = 128, 1024
_OWN = {"doc_id", "source", "size", "source_size", "target", "taken", "mix_key", "bucket", "documents", "begin"}
WEIGHTS = (5, 2, 1)


def _keyed(docs: DataFrame, seed: int, carry: Sequence[str]) -> DataFrame:
    """The key hashes id and text, so null or repeated ids don't share one unless their texts are equal."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    return docs.select("doc_id", "source", *carry, words_in("text").alias("size"), key.alias("mix_key"))


def _bucket(documents: Column) -> Column:
    place = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long")
    return F.floor(place * F.ceil(documents / BUCKET) / F.lit(float(1 << 32))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, documents, target. Sources in the order of their bytes (for UTF-8 that of code points), null last,
    take the weights in turn. The level L at which the sum of min(cap * size, weight * L) is share * all sizes is what resharing
    the excess by weight ends at. Where all sizes are 0 the targets are 0. Windows run over one row for each source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    ordered = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_full.rowsBetween(Window.unboundedPreceding, -1), by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ordered.withColumn("level", level).withColumn("own", F.col("most") / F.col("weight"))
    chosen = F.min(F.when(F.col("level") <= F.col("own"), F.struct(F.col("own"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(chosen, F.lit(float("inf"))))
    return leveled.select("source", "source_size", "documents", target.alias("target"))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs(doc_id, source, text): doc_id, source, carried columns, size, source_size, target, taken.

    size counts words (null text: 0). A source takes floor(target) words: every document floor(target / source_size) times, then
    documents in key order until the rest is used up, the last one in part; taken is at most cap times size, rounded up to whole
    repeats. Null sources form one source. Rows of equal id and text share a key and so a bucket; they are alike, so it doesn't matter
    which comes first. Null, empty and very long texts are rows like any other. Empty tables give empty results. Other columns of
    docs are ignored unless carried; a carried column of a name that is made here is an error.
    """
    if _OWN & set(carry):
        raise ValueError(f"columns made here can't be carried: {sorted(_OWN & set(carry))}")
    sizes = spill(_keyed(docs, seed, ()))
    sources = spill(source_targets(sizes, weights, share, cap))
    with_source = lambda df: df.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source").withColumn("bucket", _bucket(F.col("documents")))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.col("bucket") / GROUP).cast("long").alias("group")
    buckets = with_source(sizes).groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", group, "words")
    groups = buckets.groupBy("source", "group").agg(F.sum("words").alias("words"))
    groups = groups.select(F.col("source").alias("_s"), F.col("group").alias("_g"), F.coalesce(F.sum("words").over(before("source").orderBy("group")), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("words").over(before("source", "group").orderBy("bucket")), F.lit(0))
    begins = buckets.withColumn("inside", inside).join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("group") == F.col("_g"))).select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.col("ahead") + F.col("inside")).alias("begin"))
    main = with_source(_keyed(docs, seed, carry) if carry else sizes)
    main = main.join(begins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - repeats * F.col("source_size")
    ahead = F.col("begin") + F.sum("size").over(in_bucket) - F.col("size")
    taken = repeats * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - ahead))
    return main.withColumn("taken", taken.cast("long")).select("doc_id", "source", *carry, "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs(doc_id, source, text, n_chars, ...) with all columns, as often as mix() takes them; where it takes a
    part, the text is its first words, one space between them, and n_chars its length. A null text or one without words is never drawn.
    Repeated rows are drawn each for itself; columns may have any names beside those three; empty in, empty out."""
    rows = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")), carry=("_row",), **how)
    whole = F.array_repeat(F.col("_row"), F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part")), " ")
    part = F.array(F.col("_row").withField("text", cut)) if "n_chars" not in docs.columns else F.array(F.col("_row").withField("text", cut).withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType)))
    rows = rows.withColumn("part", (F.col("taken") % F.greatest("size", F.lit(1))).cast("int"))
    drawn = F.concat(whole, F.when(F.col("part") > 0, part).otherwise(F.slice(whole, 1, 0)))
    return rows.where("taken > 0").select(F.explode(drawn).alias("_row")).select("_row.*")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             source_size * 2.0::DOUBLE AS most FROM t),
l AS (SELECT *, most / weight AS own,
             ((SELECT sum(source_size) FROM t) * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(most, weight * (SELECT level FROM l WHERE level <= own ORDER BY own, level LIMIT 1)) AS target FROM l),
p AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS repeats,
             CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS ahead
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, repeats * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - repeats * source_size - ahead)) AS taken FROM p
"""
