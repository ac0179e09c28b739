"""Evaluation queries. A benchmark passage asks; the documents that hold it literally are its evidence; BM25+ ranks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import evaluation as E
from ..operators import literal as I
from ..sources.scratch import written
from .registry import query
from .search import TOKENS_SQL, _index

def _count():
    return F.count(F.lit(1))

def _hits(t):
    """item_id, unit, rank: the 20 documents that BM25+ ranks first for each item, all items in one batch over the documents' index."""
    return _index(t).batch_top_k(t.benchmark, 20, query="item_id").select("item_id", F.col("doc_id").alias("unit"), "rank")

def _gold(t):
    """item_id, unit: documents that hold the item's text."""
    return I.contained(t.documents, t.benchmark, by="doc_id", item="item_id").withColumnRenamed("doc_id", "unit").distinct()

_BASE = f"""qt AS (SELECT DISTINCT item_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark),
dt AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS toks FROM documents), st AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM dt),
pt AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY doc_id, term),
ft AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
hits AS (SELECT item_id, doc_id AS unit, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY points DESC, doc_id) AS rank FROM (
 SELECT item_id, doc_id, sum(CAST(floor(1e9::DOUBLE * (ln((n + 1) / df) * (tf * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al) + tf))) + 0.5) AS BIGINT)) AS points
 FROM qt JOIN ft USING (term) JOIN pt USING (term), st GROUP BY item_id, doc_id)) WHERE rank <= 20),
gold AS (SELECT b.item_id, d.doc_id AS unit FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
m AS (SELECT item_id, count(*) FILTER (rank <= 5) / count(*) AS recall_at_5, count(*) FILTER (rank <= 10) / count(*) AS recall_at_10, coalesce(1 / min(rank), 0.0) AS mrr_at_20, min(rank) AS first_rank FROM gold LEFT JOIN hits USING (item_id, unit) GROUP BY item_id)"""

def _metrics(t, hits=None, gold=None):
    return E.recall(_hits(t) if hits is None else hits, _gold(t) if gold is None else gold, ["item_id"])

def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])

@query("target_ranks", f"WITH {_BASE} SELECT item_id, coalesce(first_rank, 0) AS first_rank FROM m")
def target_ranks(t):
    return _metrics(t).select("item_id", F.coalesce("first_rank", F.lit(0)).alias("first_rank"))

@query("metrics_recall", f"WITH {_BASE} SELECT item_id, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(mrr_at_20, 6) AS mrr_at_20 FROM m")
def metrics_recall(t):
    return _rounded(_metrics(t).drop("first_rank"), "recall_at_5", "recall_at_10", "mrr_at_20")

_RESULTS = "r AS (SELECT b.item_id, CASE WHEN b.item_id % 7 = 3 THEN 'FAILED' ELSE 'SUCCESS' END AS status, m.item_id IS NOT NULL AS scorable, CASE WHEN regexp_matches(b.text, '[éèàçñóíäöüß]') THEN 'other' ELSE 'en' END AS direction, recall_at_5, recall_at_10, mrr_at_20 FROM benchmark b LEFT JOIN m USING (item_id))"
_AGGREGATE = "count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS succeeded, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (scorable) AS scorable, " + ", ".join(f"round(coalesce(sum(CASE WHEN status = 'SUCCESS' THEN {m} END), 0.0) / nullif(count(*) FILTER (scorable), 0), 6) AS {m}, round(avg(CASE WHEN status = 'SUCCESS' THEN {m} END), 6) AS executed_{m}" for m in ("recall_at_5", "recall_at_10", "mrr_at_20"))

def _results(t):
    """Every item with its status: each seventh counts as failed, and stays in the denominators."""
    status = F.when(F.col("item_id") % 7 == 3, "FAILED").otherwise("SUCCESS")
    direction = F.when(F.col("text").rlike("[éèàçñóíäöüß]"), "other").otherwise("en")
    return t.benchmark.select("item_id", status.alias("status"), direction.alias("direction")).join(_metrics(t), "item_id", "left").withColumn("scorable", F.col("recall_at_5").isNotNull())

_METRICS = [f"{p}{m}" for p in ("", "executed_") for m in ("recall_at_5", "recall_at_10", "mrr_at_20")]

@query("metrics_aggregate", f"WITH {_BASE}, {_RESULTS} SELECT {_AGGREGATE} FROM r")
def metrics_aggregate(t):
    return _rounded(E.aggregate(_results(t), []).drop("not_executed"), *_METRICS)

@query("metrics_by_direction", f"WITH {_BASE}, {_RESULTS} SELECT coalesce(direction, 'all') AS direction, {_AGGREGATE} FROM r GROUP BY GROUPING SETS ((direction), ())")
def metrics_by_direction(t):
    """Each direction and all of them, by grouping sets of one scan."""
    rows = _results(t).withColumn("direction", F.explode(F.array("direction", F.lit("all"))))
    return _rounded(E.aggregate(rows, ["direction"]).drop("not_executed"), *_METRICS)

@query("metrics_grouped", f"WITH {_BASE}, g AS (SELECT item_id, array_to_string(list_sort(list_distinct(array_agg(d.lang))), '+') AS langs FROM gold JOIN documents d ON d.doc_id = gold.unit GROUP BY item_id) SELECT langs, count(*) AS questions, round(avg(recall_at_5), 6) AS recall_at_5 FROM m JOIN g USING (item_id) GROUP BY langs")
def metrics_grouped(t):
    gold = written(_gold(t))
    groups = gold.join(t.documents.select(F.col("doc_id").alias("unit"), "lang"), "unit").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("langs"))
    return _metrics(t, gold=gold).join(groups, "item_id").groupBy("langs").agg(_count().alias("questions"), F.round(F.avg("recall_at_5"), 6).alias("recall_at_5"))

@query("rank_delta", f"WITH {_BASE}, b AS (SELECT item_id, min(r) AS base FROM (SELECT item_id, unit, row_number() OVER (PARTITION BY item_id ORDER BY unit) AS r FROM hits) JOIN gold USING (item_id, unit) GROUP BY item_id) SELECT count(*) FILTER (coalesce(first_rank, 99) < coalesce(base, 99)) AS improved, count(*) FILTER (coalesce(first_rank, 99) > coalesce(base, 99)) AS regressed, count(*) FILTER (coalesce(first_rank, 99) = coalesce(base, 99)) AS unchanged FROM m LEFT JOIN b USING (item_id)")
def rank_delta(t):
    """Against a baseline that orders the same hits by id."""
    hits, gold = written(_hits(t)), written(_gold(t))
    base = hits.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("unit"))).join(gold, ["item_id", "unit"]).groupBy("item_id").agg(F.min("r").alias("base"))
    both = _metrics(t, hits, gold).join(base, "item_id", "left").select(F.coalesce("first_rank", F.lit(99)).alias("a"), F.coalesce("base", F.lit(99)).alias("b"))
    return both.agg(F.count_if(F.col("a") < F.col("b")).alias("improved"), F.count_if(F.col("a") > F.col("b")).alias("regressed"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"))

@query("retrieval_diagnosis", f"WITH {_BASE}, n AS (SELECT item_id, count(*) AS n_hits FROM hits GROUP BY item_id) SELECT category, count(*) AS questions FROM (SELECT CASE WHEN coalesce(n_hits, 0) = 0 THEN 'NO_HITS' WHEN recall_at_5 IS NULL THEN 'UNSCORABLE' WHEN recall_at_5 = 1 THEN 'HIT_AT_5' WHEN recall_at_10 = 1 THEN 'HIT_AT_10' WHEN mrr_at_20 > 0 AND recall_at_10 = 0 THEN 'LOW_RANK' WHEN mrr_at_20 > 0 THEN 'PARTIAL_RECALL' ELSE 'TARGET_DOCUMENT_MISS' END AS category FROM benchmark LEFT JOIN m USING (item_id) LEFT JOIN n USING (item_id)) GROUP BY category")
def retrieval_diagnosis(t):
    hits = written(_hits(t))
    n = hits.groupBy("item_id").agg(_count().alias("n_hits"))
    rows = t.benchmark.select("item_id").join(_metrics(t, hits), "item_id", "left").join(n, "item_id", "left").fillna(0, ["n_hits"])
    return rows.select(E.retrieval_category().alias("category")).groupBy("category").agg(_count().alias("questions"))

_LISTS = "l AS (SELECT b.item_id, d.doc_id AS unit, abs(b.item_id * 7919 + d.doc_id * 104729) % 1000 AS noise, length(d.text) AS size FROM gold g JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = g.unit UNION SELECT item_id, unit, abs(item_id * 7919 + unit * 104729) % 1000, (SELECT any_value(length(text)) FROM documents WHERE doc_id = unit) FROM hits), a AS (SELECT item_id, unit, rank FROM hits), d AS (SELECT item_id, unit, row_number() OVER (PARTITION BY item_id ORDER BY noise, unit) AS rank FROM l), f AS (SELECT item_id, unit, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, unit) AS rank FROM (SELECT item_id, unit, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM d WHERE rank <= 20) GROUP BY item_id, unit)), r AS (SELECT item_id, unit, row_number() OVER (PARTITION BY item_id ORDER BY size, unit) AS rank FROM l JOIN f USING (item_id, unit) WHERE f.rank <= 15)"

@query("dependency_flow", f"WITH {_BASE}, {_LISTS} SELECT category, count(*) AS dependencies FROM (SELECT CASE WHEN r.rank <= 5 THEN 'HIT_AT_5' WHEN r.rank <= 10 THEN 'RERANK_LOW_RANK' WHEN f.rank <= 15 THEN 'RERANK_OUTPUT_MISS' WHEN a.rank IS NULL AND d.rank IS NULL THEN 'BRANCH_RECALL_MISS' ELSE 'BRANCH_HIT_FINAL_MISS_UNRESOLVED' END AS category FROM gold LEFT JOIN a USING (item_id, unit) LEFT JOIN (SELECT * FROM d WHERE rank <= 20) d USING (item_id, unit) LEFT JOIN f USING (item_id, unit) LEFT JOIN r USING (item_id, unit)) GROUP BY category")
def dependency_flow(t):
    """Where evidence is lost between four lists of their own: documents by overlap, the candidates in an order that has nothing to do
    with the text, both fused, and the first 15 of those reranked by length."""
    hits, gold = written(_hits(t)), written(_gold(t))
    place = lambda *order: F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    pool = gold.unionByName(hits.select("item_id", "unit")).distinct().join(t.documents.select(F.col("doc_id").alias("unit"), F.length("text").alias("size")), "unit")
    noise = F.abs(F.col("item_id") * 7919 + F.col("unit") * 104729) % 1000
    other = pool.withColumn("noise", noise).withColumn("rank", place("noise", "unit")).where("rank <= 20").select("item_id", "unit", "rank")
    both = hits.select("item_id", "unit", "rank").unionByName(other).groupBy("item_id", "unit").agg(F.sum(F.lit(1.0) / (60 + F.col("rank"))).alias("s"))
    fused = both.withColumn("h", place(F.desc("s"), "unit")).where("h <= 15").select("item_id", "unit", "h")
    final = fused.join(pool, ["item_id", "unit"]).withColumn("f", place("size", "unit")).where("f <= 10").select("item_id", "unit", "f")
    rows = gold.join(hits.withColumnRenamed("rank", "a"), ["item_id", "unit"], "left").join(other.withColumnRenamed("rank", "b"), ["item_id", "unit"], "left").join(fused, ["item_id", "unit"], "left").join(final, ["item_id", "unit"], "left")
    return rows.select(E.flow_category("f", "h", "a", "b").alias("category")).groupBy("category").agg(_count().alias("dependencies"))

@query("literal_retention", r"SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM (SELECT b.item_id, d.doc_id FROM (SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS p FROM benchmark) b JOIN (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS p FROM documents) d ON contains(d.p, b.p)) GROUP BY item_id")
def literal_retention(t):
    """Items whose text, composed and white space apart, stands in documents."""
    found = I.contained(t.documents, t.benchmark, by="doc_id", item="item_id", flatten=True)
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))

@query("unique_quote", "SELECT conv_id, turn, strpos(text, q) - 1 AS begin FROM (SELECT *, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS q FROM conversations) WHERE length(q) > 3 AND strpos(text, q) > 0 AND strpos(substr(text, strpos(text, q) + 1), q) = 0")
def unique_quote(t):
    """Quotes (the second and third word) that occur exactly once, with where."""
    quoted = t.conversations.withColumn("q", F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3))))
    at = F.expr("locate(q, text)")
    return quoted.where((F.length("q") > 3) & (at > 0) & (F.expr("locate(q, text, locate(q, text) + 1)") == 0)).select("conv_id", "turn", (at - 1).alias("begin"))

# DuckDB compares bytes: letters beyond ASCII that the turns hold become control characters, one each, first.
_LETTERS = "äöüÄÖÜßéèêàçñíóÉÈÊÇÑÍÓáúÁÚ¿¡"
_SINGLE = "CAST(" + " || ".join(f"chr({i})" for i in [*range(1, 10), *range(11, 32)][: len(_LETTERS)]) + " AS VARCHAR)"
_WHOLE = f"length(a.k) <= {S.EDIT_CHARS} AND length(b.k) <= {S.EDIT_CHARS} AND length(a.k)::BIGINT * length(b.k) <= {S.EDIT_CELLS}"

@query("edit_distance", f"WITH k AS (SELECT conv_id, turn, translate(text, '{_LETTERS}', {_SINGLE}) AS k FROM conversations), d AS (SELECT a.conv_id, a.turn, greatest(length(a.k), length(b.k), 1) AS n, length(a.k) AS m, CASE WHEN {_WHOLE} THEN levenshtein(a.k, b.k) END AS distance FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, distance, round(distance / n, 6) AS normalized, round(distance / nullif(m, 0), 6) AS cer FROM d")
def edit_distance(t):
    """Distance of each turn and the one numbered next, whole; null beyond the bounds of the guard. normalized is its share of the longer one,
    cer (character error rate) of the first. Joined on conversation and number, so a long conversation is never gathered."""
    k = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    d = k.join(k.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    d = d.withColumn("distance", S.bounded_distance(F.col("a"), F.col("b")))
    share = lambda n: F.round(F.try_divide(F.col("distance"), n), 6)
    return d.select("conv_id", "turn", "distance", share(F.greatest(F.length("a"), F.length("b"), F.lit(1))).alias("normalized"), share(F.length("a")).alias("cer"))

@query("review_ratio", "SELECT round(sum(quality) / count(quality), 6) AS quality, round(sum(toxic) / count(toxic), 6) AS toxic, count(*) AS reviewed FROM labels")
def review_ratio(t):
    return t.labels.agg(F.round(F.sum("quality") / F.count("quality"), 6).alias("quality"), F.round(F.sum("toxic") / F.count("toxic"), 6).alias("toxic"), _count().alias("reviewed"))

@query("criterion_summary", "SELECT lang, count(quality) AS measured, round(avg(quality), 6) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def criterion_summary(t):
    """Missing measures never enter a denominator."""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count("quality").alias("measured"), F.round(F.avg("quality"), 6).alias("mean"))

_STATES = ("08006", "57014", "53300", "40001", "23505", "XX000")

@query("status_counts", "SELECT event_type, CASE WHEN s LIKE '08%' THEN 'connection' WHEN s = '57014' THEN 'timeout' WHEN s LIKE '53%' THEN 'resources' WHEN s LIKE '40%' THEN 'rollback' WHEN s LIKE '23%' THEN 'constraint' ELSE 'other' END AS category, count(*) AS n FROM (SELECT event_type, ['08006', '57014', '53300', '40001', '23505', 'XX000'][1 + event_id % 6] AS s FROM events) GROUP BY ALL")
def status_counts(t):
    """Errors by kind and class of their SQLSTATE."""
    state = F.element_at(F.array(*[F.lit(x) for x in _STATES]), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.groupBy("event_type", E.database_error(state).alias("category")).agg(_count().alias("n"))

@query("latency_nearest_rank", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(max(value), 6) AS most FROM events GROUP BY event_type")
def latency_nearest_rank(t):
    ranks = E.nearest_rank(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    means = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"))
    return _rounded(means.join(ranks, "event_type"), "p50", "p95")

@query("latency_interpolated", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_interpolated(t):
    return _rounded(E.interpolated(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "p50", "p95")

@query("throughput", "SELECT event_type, count(*) FILTER (value < 100) AS succeeded, round(count(*) FILTER (value < 100) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS per_second FROM events GROUP BY event_type")
def throughput(t):
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    rows = t.events.select("event_type", "value", seconds("ts").alias("s"))
    ok = F.count_if(F.col("value") < 100)
    return rows.groupBy("event_type").agg(ok.alias("succeeded"), F.round(F.try_divide(ok, F.max("s") - F.min("s")), 9).alias("per_second"))

@query("stage_timings", "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{e}'), 0), 4) AS {e}" for e in ("click", "view", "purchase")) + ", arg_min(event_type, event_id) AS first_event, coalesce(arg_min(event_id, event_id) FILTER (event_type = 'error'), -1) AS first_failure FROM events GROUP BY user_id")
def stage_timings(t):
    """Each request's time by stage, its first event, and its first failure, which is the one that counts."""
    parts = [F.round(F.coalesce(F.sum(F.when(F.col("event_type") == e, F.col("value"))), F.lit(0)), 4).alias(e) for e in ("click", "view", "purchase")]
    return t.events.groupBy("user_id").agg(*parts, F.min_by("event_type", "event_id").alias("first_event"), F.coalesce(F.min(F.when(F.col("event_type") == "error", F.col("event_id"))), F.lit(-1)).alias("first_failure"))

@query("distinct_submissions", "SELECT event_type, count(*) AS submissions, count(DISTINCT (user_id, CAST(ts AS DATE))) AS identities, count(*) FILTER (value > 50) AS hits FROM events GROUP BY event_type")
def distinct_submissions(t):
    return t.events.groupBy("event_type").agg(_count().alias("submissions"), F.count_distinct("user_id", F.to_date("ts")).alias("identities"), F.count_if(F.col("value") > 50).alias("hits"))

@query("suite_audit", "SELECT count(*) AS questions, count(DISTINCT text) AS expressions, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (turn = 0) AS opening FROM conversations WHERE role = 'user'")
def suite_audit(t):
    out = t.conversations.where("role = 'user'").agg(_count().alias("questions"), F.count_distinct("text").alias("expressions"), F.count_if(F.col("turn") == 0).alias("opening"))
    return out.withColumn("repeated", F.col("questions") - F.col("expressions"))

@query("format_matrix", "SELECT s.source, l.lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT lang FROM documents) l LEFT JOIN (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) c ON c.source IS NOT DISTINCT FROM s.source AND c.lang IS NOT DISTINCT FROM l.lang")
def format_matrix(t):
    """All pairs of two dimensions, empty ones too: each source with the one row of all languages, and the counts where there are any."""
    counts = t.documents.groupBy("source", "lang").agg(_count().alias("n"))
    langs = counts.agg(F.collect_set(F.struct("lang")).alias("langs"), F.lit(1).alias("one"))
    grid = counts.select("source").distinct().withColumn("one", F.lit(1)).join(langs, "one").select(F.col("source").alias("s"), F.explode("langs").alias("l")).select("s", F.col("l.lang").alias("l"))
    key = F.col("s").eqNullSafe(F.col("source")) & F.col("l").eqNullSafe(F.col("lang"))
    return grid.join(counts, key, "left").select(F.col("s").alias("source"), F.col("l").alias("lang"), F.coalesce("n", F.lit(0)).alias("n"))

@query("retry_filter", "SELECT event_id FROM events WHERE event_type = 'error' AND value < 20 OR event_type = 'click' AND value > 90 AND user_id % 2 = 0")
def retry_filter(t):
    return t.events.where("event_type = 'error' and value < 20 or event_type = 'click' and value > 90 and user_id % 2 = 0").select("event_id")

@query("reserved_budget", "SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN greatest(value, 50) ELSE value END), 4) AS reserved FROM events GROUP BY user_id")
def reserved_budget(t):
    """Interrupted cases reserve the maximum."""
    cost = F.when(F.col("event_type") == "view", F.greatest("value", F.lit(50.0))).otherwise(F.col("value"))
    return t.events.groupBy("user_id").agg(F.round(F.sum(cost), 4).alias("reserved"))

@query("cost_compose", "SELECT policy, round(sum(mean * weight), 6) AS cost FROM (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type) JOIN (VALUES ('base', 'click', 1), ('base', 'view', 1), ('double', 'click', 2), ('double', 'view', 1), ('double', 'purchase', 1)) AS p(policy, event_type, weight) USING (event_type) GROUP BY policy")
def cost_compose(t):
    policies = t.spark.createDataFrame([("base", "click", 1), ("base", "view", 1), ("double", "click", 2), ("double", "view", 1), ("double", "purchase", 1)], "policy string, event_type string, weight int")
    means = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return means.join(F.broadcast(policies), "event_type").groupBy("policy").agg(F.round(F.sum(F.col("mean") * F.col("weight")), 6).alias("cost"))

