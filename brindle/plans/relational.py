"""Eligibility, audits, de-duplication, sampling and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources import sinks as K
from .registry import query

_ONE = F.lit


def _count():
    return F.count(F.lit(1))


@query("eligible", "SELECT d.source, d.lang, count(*) AS chunks FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 AND d.text IS NOT NULL AND d.lang IN ('en', 'de') GROUP BY ALL")
def eligible(t):
    """Documents of ready status and language, joined to their labels by id; filters stand below the join."""
    ready = t.labels.where("quality = 1 and toxic = 0").select("doc_id")
    return t.documents.where(F.col("lang").isin("en", "de") & F.col("text").isNotNull()).select("doc_id", "source", "lang").join(ready, "doc_id").groupBy("source", "lang").agg(_count().alias("chunks"))


@query("semi_scope", "SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_scope(t):
    scope = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(scope, "o_custkey", "left_semi").agg(_count().alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("fk_audit", """SELECT 'lineitem_orders' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_lineitem', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'labels_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents_labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'repeated_documents', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)""")
def fk_audit(t):
    one = lambda name, rows: rows.agg(_count().alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
    parts = [
        one("lineitem_orders", A.orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey")),
        one("orders_lineitem", A.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey")),
        one("labels_documents", A.orphans(t.labels, t.documents, "doc_id", "doc_id")),
        one("documents_labels", A.orphans(t.documents, t.labels, "doc_id", "doc_id")),
        one("repeated_documents", A.repeated(t.documents, ["doc_id"])),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("unique_lookup", "SELECT text_hash, CASE WHEN n = 1 THEN low ELSE -1 END AS doc_id FROM (SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS low FROM documents GROUP BY 1)")
def unique_lookup(t):
    hashed = t.documents.select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return A.unique_lookup(hashed.select("text_hash").distinct(), hashed, "text_hash", "doc_id").fillna(-1)


@query("relational_division", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS required FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = count(DISTINCT CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) THEN l_suppkey END)")
def relational_division(t):
    """Orders all of whose suppliers have a balance over 1000."""
    good = t.supplier.where("s_acctbal > 1000").select(F.col("s_suppkey").alias("l_suppkey"))
    return A.division(t.lineitem.select("l_orderkey", "l_suppkey"), good, "l_orderkey", "l_suppkey")


@query("doc_status", "SELECT d.source, count(*) AS documents, count(l.doc_id) AS labelled, count(e.vec_id) AS vectors, count(*) FILTER (l.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS complete FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source")
def doc_status(t):
    joined = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", F.lit(1).alias("l")), "doc_id", "left").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), "doc_id", "left")
    return joined.groupBy("source").agg(_count().alias("documents"), F.count("l").alias("labelled"), F.count("v").alias("vectors"), F.count_if(F.col("l").isNotNull() & F.col("v").isNotNull()).alias("complete"))


@query("block_counts", "SELECT conv_id, count(*) AS blocks, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def block_counts(t):
    return t.conversations.groupBy("conv_id").agg(_count().alias("blocks"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("singleton_hash", "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT lang) = 1 AS singleton FROM documents GROUP BY source")
def singleton_hash(t):
    return t.documents.groupBy("source").agg(F.count_distinct("lang").alias("langs")).withColumn("singleton", F.col("langs") == 1)


@query("index_completeness", "SELECT label, count(*) AS total, count(embedding) AS vectors, count(*) FILTER (len(embedding) <> 64) AS invalid, count(*) > 0 AND count(*) = count(embedding) AND count(*) FILTER (len(embedding) <> 64) = 0 AS is_indexed FROM embeddings GROUP BY label")
def index_completeness(t):
    out = t.embeddings.groupBy("label").agg(_count().alias("total"), F.count("embedding").alias("vectors"), F.count_if(F.size("embedding") != 64).alias("invalid"))
    return out.withColumn("is_indexed", (F.col("total") > 0) & (F.col("total") == F.col("vectors")) & (F.col("invalid") == 0))


@query("doc_char_budget", "SELECT lang, count(*) AS documents, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, coalesce(sum(length(text)), 0) <= 1000000 AS within FROM documents GROUP BY lang")
def doc_char_budget(t):
    out = t.documents.groupBy("lang").agg(_count().alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    return out.withColumn("within", F.col("chars") <= 1_000_000)


@query("page_list", "SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id DESC LIMIT 20 OFFSET 40")
def page_list(t):
    """The third page of a listing with the total."""
    total = t.documents.agg(_count().alias("total"))
    page = A.page(t.documents.select("doc_id", "source", "n_chars"), [F.desc_nulls_last("n_chars"), F.desc("doc_id")], 20, 3)
    return page.join(F.broadcast(total))


@query("block_preview", "SELECT doc_id, substr(text, 1, 512) AS preview, length(text) AS chars, source || ' / ' || lang AS section FROM documents")
def block_preview(t):
    return t.documents.select("doc_id", F.substring("text", 1, 512).alias("preview"), F.length("text").alias("chars"), F.concat_ws(" / ", "source", "lang").alias("section"))


@query("nonblank", "SELECT count(*) AS total, count(*) FILTER (regexp_matches(text, '[^\\s]')) AS nonblank, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '[^\\s]')) AS blank FROM documents")
def nonblank(t):
    seen = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\s]")
    return t.documents.agg(_count().alias("total"), F.count_if(seen).alias("nonblank"), F.count_if(~seen).alias("blank"))


@query("candidate_doc", "SELECT conv_id, count(*) AS blocks, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id ORDER BY blocks DESC, conv_id LIMIT 1")
def candidate_doc(t):
    counts = t.conversations.groupBy("conv_id").agg(_count().alias("blocks"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return counts.orderBy(F.desc("blocks"), "conv_id").limit(1)


@query("first_oversized", "SELECT conv_id, min(turn) AS turn, arg_min(length(text), turn) AS chars FROM conversations WHERE length(text) > 400 GROUP BY conv_id")
def first_oversized(t):
    big = t.conversations.where(F.length("text") > 400)
    return big.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by(F.length("text"), "turn").alias("chars"))


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash")).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), _count().alias("copies"))


@query("first_occurrence", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS first_id FROM documents")
def first_occurrence(t):
    """Each document with the first of its text: a minimum for each hash, joined back, so a hot hash is pre-aggregated and its rows can be split."""
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return hashed.join(hashed.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", "first_id")


@query("norm_dedup", r"SELECT conv_id, role, min(turn) AS turn, count(*) AS copies FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS k FROM conversations) GROUP BY conv_id, role, k")
def norm_dedup(t):
    key = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.conversations.groupBy("conv_id", "role", key.alias("k")).agg(F.min("turn").alias("turn"), _count().alias("copies")).drop("k")


@query("unreferenced", "SELECT sha256(text) AS text_hash, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) = 0")
def unreferenced(t):
    """Stored hashes that no labelled document refers to: what a cleanup may delete."""
    stored = t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash"))
    used = stored.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("text_hash").distinct()
    return stored.groupBy("text_hash").agg(_count().alias("files")).join(used, "text_hash", "left_anti")


def _fingerprint_sql(by: str, order: str, row: str, table: str) -> str:
    """The digests of A.fingerprint, level by level."""
    level = f"SELECT {by}, {order} AS o, sha256({row}) AS h, 1 AS n FROM {table}"
    for _ in range(A.LEVELS):
        level = f"SELECT {by}, o // {A.FAN} AS o, sha256(string_agg(h, '' ORDER BY o)) AS h, sum(n) AS n FROM ({level}) GROUP BY {by}, o // {A.FAN}"
    return f"SELECT {by}, sha256(string_agg(h, '' ORDER BY o)) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM ({level}) GROUP BY {by}"


@query("corpus_fingerprint", _fingerprint_sql("source", "doc_id", "doc_id || '|' || strlen(text) || '|' || text", "documents"))
def corpus_fingerprint(t):
    row = F.concat_ws("|", F.col("doc_id").cast("string"), F.octet_length("text").cast("string"), "text")
    return A.fingerprint(t.documents, ["source"], row, F.col("doc_id"))


@query("source_identity", f"SELECT conv_id, blocks, in_order, fingerprint FROM (SELECT conv_id, count(*) AS blocks, bool_and(turn = rn - 1) AS in_order FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id) JOIN ({_fingerprint_sql('conv_id', 'turn', 'text', 'conversations')}) USING (conv_id)")
def source_identity(t):
    numbered = t.conversations.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    order = numbered.groupBy("conv_id").agg(_count().alias("blocks"), F.bool_and(F.col("turn") == F.col("rn") - 1).alias("in_order"))
    return order.join(A.fingerprint(t.conversations, ["conv_id"], F.col("text"), F.col("turn")).drop("rows"), "conv_id")


@query("block_ids", "SELECT conv_id, turn, substr(sha256('block|' || conv_id || '|' || turn || '|' || text), 1, 32) AS block_id FROM conversations")
def block_ids(t):
    name = F.concat_ws("|", F.lit("block"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text")
    return t.conversations.select("conv_id", "turn", F.substring(F.sha2(name, 256), 1, 32).alias("block_id"))


@query("hash_sample", "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('33|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 25")
def hash_sample(t):
    return A.hash_sample(t.documents.select("lang", "doc_id"), ["lang"], "doc_id", 25, "33")


@query("nested_scopes", "SELECT n AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, row_number() OVER (ORDER BY sha256('36|' || doc_id), doc_id) AS place FROM documents), (VALUES (10), (50), (200)) AS s(n) WHERE place <= n GROUP BY n")
def nested_scopes(t):
    """Scopes that are prefixes of one hash order, each in the next."""
    first = A.page(t.documents.select("doc_id", "n_chars"), [F.sha2(F.concat_ws("|", F.lit("36"), F.col("doc_id").cast("string")), 256), "doc_id"], 200, 1)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(F.sha2(F.concat_ws("|", F.lit("36"), F.col("doc_id").cast("string")), 256), "doc_id")))
    return placed.select("n_chars", F.explode(F.filter(F.array(F.lit(10), F.lit(50), F.lit(200)), lambda n: n >= F.col("place"))).alias("documents")).groupBy("documents").agg(F.sum("n_chars").alias("chars"))


@query("preset_coverage", "SELECT count(DISTINCT sha256(text)) AS hashes, count(DISTINCT lang) AS formats, count(DISTINCT sha256(text)) >= 10 AND count(DISTINCT lang) >= 3 AS covered FROM documents")
def preset_coverage(t):
    out = t.documents.agg(F.count_distinct(F.sha2("text", 256)).alias("hashes"), F.count_distinct("lang").alias("formats"))
    return out.withColumn("covered", (F.col("hashes") >= 10) & (F.col("formats") >= 3))


@query("contiguity", "SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def contiguity(t):
    """Whether an index runs from 0 without gaps, by aggregates alone."""
    out = t.conversations.groupBy("conv_id").agg(_count().alias("n"), F.min("turn").alias("a"), F.max("turn").alias("b"), F.count_distinct("turn").alias("d"))
    return out.select("conv_id", "n", ((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("contiguous"))


@query("insert_if_absent", "SELECT c_custkey AS key, 'new' AS origin FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'kept' FROM orders")
def insert_if_absent(t):
    there = t.orders.select(F.col("o_custkey").alias("key")).distinct()
    new = t.customer.select(F.col("c_custkey").alias("key")).join(there, "key", "left_anti")
    return new.withColumn("origin", F.lit("new")).unionByName(there.withColumn("origin", F.lit("kept")))


@query("cache_lookup", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'miss' WHEN l.quality = 0 THEN 'corrupt' ELSE 'hit' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def cache_lookup(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", F.lit(True).alias("there")), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("there").isNull(), "miss").when(F.col("quality") == 0, "corrupt").otherwise("hit").alias("status"))


@query("active_identity", "SELECT o_custkey, o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS active, CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'free' WHEN count(*) FILTER (o_orderstatus = 'O') = 1 THEN 'reuse' ELSE 'reject' END AS decision FROM orders GROUP BY ALL")
def active_identity(t):
    out = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("active"))
    return out.withColumn("decision", F.when(F.col("active") == 0, "free").when(F.col("active") == 1, "reuse").otherwise("reject"))


@query("import_status", "SELECT status, count(*) AS files FROM (SELECT CASE WHEN e.vec_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'READY' WHEN l.doc_id IS NOT NULL THEN 'INDEXING' WHEN e.vec_id IS NOT NULL THEN 'EMBEDDED' ELSE 'UPLOADED' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id) GROUP BY status")
def import_status(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("l")), "doc_id", "left").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")), "doc_id", "left")
    l, v = F.col("l").isNotNull(), F.col("v").isNotNull()
    return joined.select(F.when(l & v, "READY").when(l, "INDEXING").when(v, "EMBEDDED").otherwise("UPLOADED").alias("status")).groupBy("status").agg(_count().alias("files"))


@query("validation_rejects", "SELECT coalesce(CASE WHEN l_quantity <= 0 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'status' WHEN l_tax > 0.06 THEN 'tax' END, 'accepted') AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def validation_rejects(t):
    """Rows by the first rule that rejects them."""
    rules = [("quantity", F.col("l_quantity") <= 0), ("discount", F.col("l_discount") > 0.08), ("status", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")), ("tax", F.col("l_tax") > 0.06)]
    return t.lineitem.select(F.coalesce(A.first_reason(rules), F.lit("accepted")).alias("reason")).groupBy("reason").agg(_count().alias("n"))


@query("top_n_per_category", "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('7|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def top_n_per_category(t):
    return A.hash_sample(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], "doc_id", 3, "7").drop("place")


@query("count_rank", "SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, sha256('32|' || o_custkey), o_custkey) AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ORDER BY place LIMIT 100")
def count_rank(t):
    order = [F.desc("n"), F.sha2(F.concat_ws("|", F.lit("32"), F.col("o_custkey").cast("string")), 256), "o_custkey"]
    top = t.orders.groupBy("o_custkey").agg(_count().alias("n")).orderBy(*order).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("inverted_index", "SELECT l_suppkey, l_orderkey // 4096 AS block, count(DISTINCT l_orderkey) AS orders, min(l_orderkey) AS first_order, sha256(string_agg(DISTINCT CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR))) AS digest FROM lineitem GROUP BY ALL")
def inverted_index(t):
    """Posting lists by supplier, in blocks of 4,096 order keys, so that a list of any length is many rows."""
    keys = t.lineitem.select("l_suppkey", "l_orderkey").distinct().withColumn("block", F.floor(F.col("l_orderkey") / 4096))
    text = F.array_join(F.array_sort(F.collect_list(F.col("l_orderkey").cast("string"))), ",")
    return keys.groupBy("l_suppkey", "block").agg(_count().alias("orders"), F.min("l_orderkey").alias("first_order"), F.sha2(text, 256).alias("digest"))


@query("review_merge", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END AS review FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def review_merge(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", F.lit(True).alias("there")), "doc_id", "full_outer")
    return joined.select("doc_id", F.when(F.col("there").isNull(), "pending").when(F.col("quality") == 1, "approved").otherwise("rejected").alias("review"))


@query("question_plan", "SELECT l_orderkey, deps, place FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS deps, row_number() OVER (ORDER BY count(DISTINCT l_partkey) DESC, l_orderkey) AS place FROM lineitem GROUP BY l_orderkey) WHERE place <= 50")
def question_plan(t):
    """Questions with most dependencies first."""
    top = t.lineitem.select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(_count().alias("deps")).orderBy(F.desc("deps"), "l_orderkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("deps"), "l_orderkey")))


@query("page_partition", "SELECT o_orderkey % 400 AS doc, (o_orderkey // 400) // 180 AS part, count(*) AS pages FROM orders GROUP BY ALL")
def page_partition(t):
    """Parts of 180 pages at most."""
    page = F.floor(F.col("o_orderkey") / 400)
    return t.orders.groupBy((F.col("o_orderkey") % 400).alias("doc"), F.floor(page / 180).alias("part")).agg(_count().alias("pages"))


@query("page_remap", "WITH p AS (SELECT o_orderkey AS doc, unnest([1, 4]) AS first, unnest([3, 7]) AS last, unnest([100, 200]) + o_orderkey % 7 AS begin FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey, l_linenumber, begin + l_linenumber - first AS page FROM lineitem JOIN p ON doc = l_orderkey AND l_linenumber BETWEEN first AND last")
def page_remap(t):
    """Pages of parts as pages of the document: an interval join inside the document's key, whose parts are few."""
    span = lambda first, last, begin: F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"), (F.lit(begin) + F.col("o_orderkey") % 7).alias("begin"))
    parts = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(span(1, 3, 100), span(4, 7, 200))).alias("p")).select("doc", "p.*")
    inside = (F.col("doc") == F.col("l_orderkey")) & F.col("l_linenumber").between(F.col("first"), F.col("last"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(parts, inside).select("l_orderkey", "l_linenumber", (F.col("begin") + F.col("l_linenumber") - F.col("first")).alias("page"))


@query("interval_continuity", "SELECT l_orderkey, count(*) AS parts, count(*) FILTER (prev IS NOT NULL AND l_linenumber <> prev + 1) AS gaps FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM lineitem) GROUP BY l_orderkey")
def interval_continuity(t):
    prev = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", prev.alias("prev"))
    return rows.groupBy("l_orderkey").agg(_count().alias("parts"), F.count_if(F.col("prev").isNotNull() & (F.col("l_linenumber") != F.col("prev") + 1)).alias("gaps"))


#: Rows that a task of context_band sorts.
BAND = 1 << 18


@query("context_band", "SELECT a.l_orderkey, a.l_linenumber, count(b.l_linenumber) AS near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) BETWEEN 1 AND 2 GROUP BY ALL")
def context_band(t):
    """Neighbours within two places in the same group: a range window, which reads a group once. Rows are dealt by their number, as small
    keys would be put together into few tasks by their bytes."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    rows = rows.repartition(max(1, -(-rows.count() // BAND)), "l_orderkey")
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    near = _count().over(at.rangeBetween(-2, 2)) - _count().over(at.rangeBetween(0, 0))
    return rows.select("l_orderkey", "l_linenumber", near.alias("near")).groupBy("l_orderkey", "l_linenumber").agg(F.sum("near").alias("near")).where("near > 0")


@query("set_equality", """WITH p AS (SELECT 'orders' AS pair, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_a, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_b
UNION ALL SELECT 'labels', (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)), (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))) SELECT *, only_a = 0 AND only_b = 0 AS equal FROM p""")
def set_equality(t):
    """Whether two sides have the same keys."""
    pairs = (("orders", A.set_equality(t.lineitem, t.orders, "l_orderkey", "o_orderkey")), ("labels", A.set_equality(t.documents, t.labels, "doc_id", "doc_id")))
    (n, first), *rest = ((name, df.withColumn("pair", F.lit(name))) for name, df in pairs)
    for _, df in rest:
        first = first.unionByName(df)
    return first


@query("upload_results", "WITH h AS (SELECT doc_id AS item, source AS kb, sha256(text) AS sha256, strlen(text) AS n, CASE WHEN length(text) < 20 THEN 'too short' END AS reason FROM documents), s AS (SELECT DISTINCT kb, sha256 FROM h WHERE item % 7 = 0), r AS (SELECT *, coalesce(reason, CASE WHEN n > 20000 THEN 'too large' END) AS refused FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY kb, sha256, refused IS NULL ORDER BY item) AS place FROM r) SELECT item, p.kb, p.sha256, CASE WHEN refused IS NOT NULL THEN refused WHEN s.sha256 IS NOT NULL OR place > 1 THEN 'duplicate' ELSE 'stored' END AS state FROM p LEFT JOIN s ON s.kb = p.kb AND s.sha256 = p.sha256")
def upload_results(t):
    """All documents as uploads to the base of their source; every seventh's content was stored before."""
    rows = t.documents.select(F.col("doc_id").alias("item"), F.col("source").alias("kb"), F.col("text").alias("content"), F.when(F.length("text") < 20, "too short").alias("reason"))
    stored = rows.where("item % 7 = 0").select("kb", F.sha2("content", 256).alias("sha256"))
    return K.upload_results(rows, stored, F.col("reason"), 20_000)


@query("granted_claims", """WITH r AS (SELECT CAST(floor(value) AS BIGINT) AS key, user_id AS owner, ts AS asked FROM events), h AS (SELECT CAST(floor(value) AS BIGINT) AS key, min(user_id) AS owner FROM events WHERE event_id % 50 = 0 GROUP BY ALL), f AS (SELECT key, arg_min(owner, (asked, owner)) AS first FROM r GROUP BY key) SELECT r.key, r.owner, epoch_us(r.asked) AS "at", r.owner = coalesce(h.owner, f.first) AS granted FROM r JOIN f USING (key) LEFT JOIN h USING (key)""")
def granted_claims(t):
    """Claims of users on whole values of events; a fiftieth of the events has been granted before."""
    rows = t.events.select(F.floor("value").alias("key"), F.col("user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return K.granted_claims(rows.drop("event_id"), rows.where("event_id % 50 = 0").select("key", "owner")).select("key", "owner", "at", "granted")
