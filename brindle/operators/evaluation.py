"""Evaluation of retrieval and latency: metrics, distributions, diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks, parts: int = 128) -> DataFrame:
    """by, n, k, value: the k-th smallest (from 1) of the n values of each group, for k in ranks(n), an array column of longs. Exact, and no
    group is sorted or counted in one place: values are cut at about parts approximate quantiles, the sums of the cuts tell which one
    holds a rank, and only that one's values are counted. Rows are written once with their cuts. Nulls don't count."""
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(4 * parts))
    groups = known.groupBy(*by).agg(F.array_distinct(cuts).alias("cuts"), F.count(F.lit(1)).alias("n"))
    cut = written(known.join(groups, by).withColumn("cut", F.size(F.filter("cuts", lambda c: c < F.col("v")))).select(*by, "n", "cut", "v"))
    before = F.sum("m").over(Window.partitionBy(*by).orderBy("cut")) - F.col("m")
    sums = cut.groupBy(*by, "n", "cut").agg(F.count(F.lit(1)).alias("m")).withColumn("before", before)
    asked = sums.withColumn("k", F.explode(ranks(F.col("n")))).where((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("m"))).select(*by, "cut", "before", "k")
    values = cut.join(asked.select(*by, "cut").distinct(), [*by, "cut"], "left_semi").groupBy(*by, "n", "cut", "v").agg(F.count(F.lit(1)).alias("m"))
    upto = values.withColumn("upto", F.sum("m").over(Window.partitionBy(*by, "cut").orderBy("v")))
    met = upto.join(asked, [*by, "cut"]).where((F.col("upto") - F.col("m") < F.col("k") - F.col("before")) & (F.col("k") - F.col("before") <= F.col("upto")))
    return met.select(*by, "n", "k", F.col("v").alias(value))


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share p: the value at place ceil(n * p) of n in order."""
    at = {name: F.greatest(F.lit(1), F.ceil(F.col("n") * p)).cast("long") for name, p in shares.items()}
    found = order_statistics(rows, by, value, lambda n: F.array_distinct(F.array(*at.values())))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col(value))).alias(name) for name, k in at.items()])


def interpolated(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share p: the value at (n - 1) * p from the first, between two values in proportion."""
    place = {name: (F.col("n") - 1) * F.lit(p) for name, p in shares.items()}
    ends = lambda x: (F.floor(x).cast("long") + 1, F.ceil(x).cast("long") + 1)
    found = order_statistics(rows, by, value, lambda n: F.array_distinct(F.array(*[k for x in place.values() for k in ends(x)])))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col(value)))
    part = lambda x: F.max(x - F.floor(x))
    return found.groupBy(*by).agg(*[(at(ends(x)[0]) + (at(ends(x)[1]) - at(ends(x)[0])) * part(x)).alias(name) for name, x in place.items()])


def recall(hits: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """recall_at_5, recall_at_10, mrr_at_20, first_rank of hits(by, unit, rank) against gold(by, unit) for each question that has gold
    units; a unit hit twice counts once; a question without hits has 0."""
    best = hits.where("rank <= 20").groupBy(*by, "unit").agg(F.min("rank").alias("rank"))
    joined = gold.select(*by, "unit").distinct().join(best, [*by, "unit"], "left")
    first = F.min("rank")
    return joined.groupBy(*by).agg(
        (F.count_if(F.col("rank") <= 5) / F.count(F.lit(1))).alias("recall_at_5"),
        (F.count_if(F.col("rank") <= 10) / F.count(F.lit(1))).alias("recall_at_10"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr_at_20"),
        first.alias("first_rank"),
    )


def retrieval_category(n_hits: str = "n_hits", document_mrr: str | None = None) -> Column:
    """Why a question's evidence was missed, by the metrics of recall(); document_mrr is
    that of whole documents, where evidence is pages. The names are fixed values."""
    return (
        F.when(F.col(n_hits) == 0, "NO_HITS")
        .when(F.col("recall_at_5").isNull(), "UNSCORABLE")
        .when(F.col("recall_at_5") == 1, "HIT_AT_5")
        .when(F.col("recall_at_10") == 1, "HIT_AT_10")
        .when((F.col("mrr_at_20") > 0) & (F.col("recall_at_10") == 0), "LOW_RANK")
        .when(F.col("mrr_at_20") > 0, "PARTIAL_RECALL")
        .when(F.col(document_mrr) > 0 if document_mrr else F.lit(False), "TARGET_PAGE_MISS")
        .otherwise("TARGET_DOCUMENT_MISS")
    )


def flow_category(final: str, hybrid: str, dense: str, lexical: str, complete: Column | None = None) -> Column:
    """Where a document was lost on its way through four lists of 20, all of them complete. The names are fixed values."""
    rank = F.col(final)
    return (
        F.when(F.lit(False) if complete is None else ~complete, "INCOMPLETE_EXECUTION")
        .when(rank <= 5, "HIT_AT_5")
        .when(rank.isNotNull(), "RERANK_LOW_RANK")
        .when(F.col(hybrid).isNotNull(), "RERANK_OUTPUT_MISS")
        .when(F.col(dense).isNull() & F.col(lexical).isNull(), "BRANCH_RECALL_MISS")
        .otherwise("BRANCH_HIT_FINAL_MISS_UNRESOLVED")
    )


def aggregate(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals of results(status, scorable, recall_at_5, ..., seconds): failures count as 0 in conservative metrics, which are null while
    a question hasn't been run; executed means and latencies take the successful ones only."""
    ok = F.col("status") == "SUCCESS"
    total, open_ = F.count(F.lit(1)), F.count_if(~F.col("status").isin("SUCCESS", "FAILED"))
    scorable = F.count_if(F.col("scorable"))
    metrics = []
    for m in ("recall_at_5", "recall_at_10", "mrr_at_20"):
        measured = F.when(ok & F.col("scorable"), F.col(m))
        metrics += [F.when(open_ == 0, F.try_divide(F.coalesce(F.sum(measured), F.lit(0.0)), scorable)).alias(m), F.avg(measured).alias(f"executed_{m}")]
    return results.groupBy(*by).agg(total.alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), open_.alias("not_executed"), scorable.alias("scorable"), *metrics)


def database_error(state: Column) -> Column:
    """What kind of error a SQLSTATE is, by its class."""
    return F.when(state.startswith("08"), "connection").when(state == "57014", "timeout").when(state.startswith("53"), "resources").when(state.startswith("40"), "rollback").when(state.startswith("23"), "constraint").otherwise("other")


def gated(metrics: DataFrame, valid: Column, names: list[str]) -> DataFrame:
    """metrics with nulls for all of names where the snapshot they come from isn't verified."""
    return metrics.withColumns({n: F.when(valid, F.col(n)) for n in names})


def preferred(snapshot: DataFrame, checkpoint: DataFrame, key: str, state: str) -> DataFrame:
    """key, state, origin: an explicit snapshot's state, or an older checkpoint's where the snapshot has none."""
    a, b = snapshot.select(key, F.col(state).alias("_new")), checkpoint.select(key, F.col(state).alias("_old"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_new", "_old").alias(state), F.when(F.col("_new").isNotNull(), "snapshot").otherwise("checkpoint").alias("origin"))
