"""Search queries: vectors, BM25+, fusion, reranking. Documents and vectors of equal id count as one chunk here."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import lexical as L
from ..operators import retrieval as R
from ..sources.readers import shared_folder
from .registry import query

QUESTION = "the this that was were"
_VECTOR = 3


def _query_vector(t) -> list[float]:
    return list(t.embeddings.where(F.col("vec_id") == _VECTOR).first().embedding)


def _index(t) -> L.Index:
    """The documents' index, by the identity of their files; built by the first query that needs it, opened by those after."""
    return L.index_of_files(t.spark, f"{t.folder}/documents.parquet", f"{shared_folder(t.spark)}/brindle", id="doc_id")


def _dense(t, k: int, ids=None):
    return R.dense_top_k(t.embeddings, _query_vector(t), k, id="vec_id", ids=ids)


# The same tokens in SQL without look-ahead: four alternatives in order, then what a match took too much is cut off.
TOKENS_SQL = r"""list_transform(regexp_extract_all(replace(lower(coalesce({0}, '')), 'ß', 'ss'),
 '[+-](?:[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?|\.[0-9]+)%?(?:[^a-z0-9_./+-]|[-./+][^a-z0-9]|[-./+]$|$)|[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?%?(?:[^a-z0-9_./+-]|[-./+][^a-z0-9]|[-./+]$|$)|[a-z0-9]+(?:[-_./+][a-z0-9]+)*%?|\.[0-9]+%?(?:[^a-z0-9_./+-]|[-./+][^a-z0-9]|[-./+]$|$)'),
 lambda x: replace(regexp_replace(x, '[^a-z0-9%]+$', ''), ',', ''))"""
_COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {_VECTOR})"


def _dense_sql(k: int, where: str = "true") -> str:
    return f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, {_COSINE.format('embedding', _Q)} AS score FROM embeddings WHERE {where}) ORDER BY rank LIMIT {k}"


def _bm25_sql(k: int, where: str = "true", question: str = QUESTION) -> str:
    terms = question.split()
    tf = ", ".join(f"len([x for x in toks if x = '{w}']) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"(CASE WHEN df{i} > 0 THEN ln((n + 1) / df{i}) ELSE 0 END) * (1.0::DOUBLE + CASE WHEN tf{i} > 0 THEN tf{i} * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al) + tf{i}) ELSE 0 END)" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (
      WITH d AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS toks FROM documents WHERE {where}), c AS (SELECT doc_id, len(toks) AS dl, {tf} FROM d), s AS (SELECT count(*) AS n, avg(dl) AS al, {df} FROM c)
      SELECT doc_id, {score} AS score FROM c, s WHERE {some}) ORDER BY rank LIMIT {k}"""


@query("dense_topk", f"SELECT vec_id, round(score, 6) AS score, rank FROM ({_dense_sql(20)})")
def dense_topk(t):
    return _dense(t, 20).withColumn("score", F.round("score", 6))


@query("dense_scoped", f"SELECT vec_id, round(score, 6) AS score, rank FROM ({_dense_sql(5, 'vec_id IN (1, 2, 5, 8, 13, 21, 34, 55)')})")
def dense_scoped(t):
    return _dense(t, 5, [1, 2, 5, 8, 13, 21, 34, 55, 5]).withColumn("score", F.round("score", 6))


def _batch_sql(where: str) -> str:
    return f"SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format('c.embedding', 'q.embedding')} DESC, c.vec_id) AS rank FROM embeddings c, embeddings q WHERE {where}) WHERE rank <= 10"


def _dense_batch(t, where: str):
    queries = t.embeddings.where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.dense_batch_top_k(t.embeddings, queries, 10, id="vec_id").select("query_id", "vec_id", "rank")


@query("dense_batch_topk", _batch_sql("q.vec_id % 20 = 0"))
def dense_batch_topk(t):
    """A twentieth of the rows asks, as in op2, so the queries grow with the table."""
    return _dense_batch(t, "vec_id % 20 = 0")


@query("order_check", f"WITH h AS ({_dense_sql(20)}), d AS (SELECT 'found' AS list, rank, score, vec_id FROM h UNION ALL SELECT 'damaged', CASE rank WHEN 3 THEN 11 WHEN 11 THEN 3 ELSE rank END, score, vec_id FROM h), b AS (SELECT *, lag(score) OVER w AS s, lag(vec_id) OVER w AS v FROM d WINDOW w AS (PARTITION BY list ORDER BY rank)) SELECT list, count(*) FILTER (s < score OR (s = score AND v >= vec_id)) AS inversions, count(*) AS hits FROM b GROUP BY list")
def order_check(t):
    """Hits whose score or id is out of order against the one before, in the hits found and in a list with two of them exchanged."""
    found = _dense(t, 20).withColumn("list", F.lit("found"))
    moved = F.when(F.col("rank") == 3, 11).when(F.col("rank") == 11, 3).otherwise(F.col("rank"))
    before = Window.partitionBy("list").orderBy("rank")
    worse = (F.lag("score").over(before) < F.col("score")) | ((F.lag("score").over(before) == F.col("score")) & (F.lag("vec_id").over(before) >= F.col("vec_id")))
    both = found.unionByName(found.withColumns({"list": F.lit("damaged"), "rank": moved}))
    return both.select("list", worse.alias("worse")).groupBy("list").agg(F.count_if(F.col("worse")).alias("inversions"), F.count(F.lit(1)).alias("hits"))


@query("vector_audit", "SELECT count(*) AS total, count(embedding) AS vectors, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4) AS wrong_norm, count(*) FILTER (len(embedding) = 64 AND abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 1e-4) AS valid FROM embeddings")
def vector_audit(t):
    v = F.col("embedding")
    return t.embeddings.agg(F.count(F.lit(1)).alias("total"), F.count(v).alias("vectors"), F.count_if(F.size(v) != 64).alias("wrong_size"), F.count_if(F.abs(V.norm(v) - 1) > 1e-4).alias("wrong_norm"), F.count_if(V.valid(v, 64)).alias("valid"))


@query("vector_normalize", "SELECT vec_id, len(embedding) AS size, array_to_string([CAST(round(1000000 * CAST(x AS DOUBLE) / n) AS BIGINT) for x in embedding], ' ') AS millionths FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def vector_normalize(t):
    return t.embeddings.select("vec_id", V.normalized(F.col("embedding")).alias("v")).select("vec_id", F.size("v").alias("size"), F.array_join(F.transform("v", lambda x: F.round(1000000 * x).cast("long").cast("string")), " ").alias("millionths"))


@query("tokenize", f"SELECT doc_id, len(toks) AS n_tokens, array_to_string(toks[1:20], ' ') AS head, sha256(array_to_string(toks, ' ')) AS digest FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS toks FROM documents)")
def tokenize(t):
    return t.documents.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("toks")).select("doc_id", F.size("toks").alias("n_tokens"), F.array_join(F.slice("toks", 1, 20), " ").alias("head"), F.sha2(F.array_join("toks", " "), 256).alias("digest"))


@query("tokenize_cjk", f"SELECT src, key, len(toks) AS n_tokens, sha256(array_to_string(toks, ' ')) AS digest FROM (SELECT src, key, {TOKENS_SQL.format('text')} AS toks FROM (SELECT 'benchmark' AS src, item_id AS key, text FROM benchmark UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations))")
def tokenize_cjk(t):
    """Tokens of benchmark items and turns; the driver's texts hold no Chinese, whose characters and pairs the unit tests cover."""
    rows = t.benchmark.select(F.lit("benchmark").alias("src"), F.col("item_id").alias("key"), "text").unionByName(t.conversations.select(F.lit("conversations").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text"))
    return rows.select("src", "key", T.tokens(F.coalesce("text", F.lit(""))).alias("toks")).select("src", "key", F.size("toks").alias("n_tokens"), F.sha2(F.array_join("toks", " "), 256).alias("digest"))


@query("bm25_df", f"SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / count(*)), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS toks FROM documents)) GROUP BY term")
def bm25_df(t):
    index = _index(t)
    return index.document_frequencies().select("term", "df", F.round(F.log(F.lit(index.documents + 1.0) / F.col("df")), 6).alias("idf"))


@query("bm25_topk", f"SELECT doc_id, round(score, 6) AS score, rank FROM ({_bm25_sql(20)})")
def bm25_topk(t):
    return _index(t).top_k(QUESTION, 20).withColumn("score", F.round("score", 6))


@query("bm25_scoped", f"SELECT doc_id, round(score, 6) AS score, rank FROM ({_bm25_sql(10, 'doc_id IN (' + ', '.join(map(str, range(0, 180, 3))) + ')')})")
def bm25_scoped(t):
    return _index(t).top_k(QUESTION, 10, ids=range(0, 180, 3)).withColumn("score", F.round("score", 6))


_BOTH = f"d AS (SELECT vec_id AS chunk_id, rank AS dense_rank FROM ({_dense_sql(20)})), l AS (SELECT doc_id AS chunk_id, rank AS lexical_rank FROM ({_bm25_sql(20)}))"
_FUSED = f"WITH {_BOTH}, f AS (SELECT chunk_id, dense_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0.0) AS fusion_score FROM d FULL JOIN l USING (chunk_id))"


def _branches(t):
    return _dense(t, 20).withColumnRenamed("vec_id", "chunk_id"), _index(t).top_k(QUESTION, 20).withColumnRenamed("doc_id", "chunk_id")


@query("rrf_fusion", f"{_FUSED} SELECT chunk_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(lexical_rank, 0) AS lexical_rank, round(fusion_score, 6) AS fusion_score, row_number() OVER (ORDER BY fusion_score DESC, chunk_id) AS rank FROM f ORDER BY rank LIMIT 30")
def rrf_fusion(t):
    return R.hybrid(*_branches(t)).fillna(0, ["dense_rank", "lexical_rank"]).withColumn("fusion_score", F.round("fusion_score", 6))


@query("multi_rrf", f"WITH {_BOTH}, v AS (SELECT chunk_id, dense_rank AS r FROM d UNION ALL SELECT chunk_id, lexical_rank FROM l UNION ALL SELECT vec_id, rank FROM ({_dense_sql(10)})) SELECT chunk_id, round(s, 6) AS fusion_score, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank FROM (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + r)) / 3, 12) AS s FROM v GROUP BY chunk_id)) WHERE rank <= 30")
def multi_rrf(t):
    dense, lexical = _branches(t)
    lists = dense.select(F.lit(0).alias("branch"), "chunk_id", "rank").unionByName(lexical.select(F.lit(1).alias("branch"), "chunk_id", "rank")).unionByName(dense.where("rank <= 10").select(F.lit(2).alias("branch"), "chunk_id", "rank"))
    return R.reciprocal_fusion(lists, mean_of=3).withColumn("fusion_score", F.round("fusion_score", 6))


_TERMS = "list_distinct([" + ", ".join(f"'{w}'" for w in QUESTION.split()) + "])"
_SCORE = f"len(list_intersect({TOKENS_SQL.format('text')}, {_TERMS})) / CAST(len({_TERMS}) AS DOUBLE)"
_RERANKED = f"{_FUSED}, t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY fusion_score DESC, chunk_id) AS rank FROM f) WHERE rank <= 30), r AS (SELECT t.*, {_SCORE} AS rerank_score FROM t JOIN documents ON doc_id = chunk_id)"


def _hits(t):
    """The fused hits get their texts after the top k."""
    hits = R.hybrid(*_branches(t))
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text").join(F.broadcast(hits), "chunk_id")


@query("rerank", f"{_RERANKED} SELECT chunk_id, rank, round(rerank_score, 6) AS rerank_score, rerank_rank FROM (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM r) WHERE rerank_rank <= 10")
def rerank(t):
    return R.rerank(_hits(t), R.overlap_scorer(QUESTION), limit=10).select("chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


HYBRID_SEARCH = f"{_RERANKED} SELECT chunk_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(lexical_rank, 0) AS lexical_rank, round(fusion_score, 6) AS fusion_score, round(rerank_score, 6) AS rerank_score, rerank_rank FROM (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM r) WHERE rerank_rank <= 5"


@query("hybrid_search", HYBRID_SEARCH)
def hybrid_search(t):
    """Dense and lexical top 20, fused top 30, reranked top 5."""
    found = R.rerank(_hits(t), R.overlap_scorer(QUESTION), limit=5)
    return found.fillna(0, ["dense_rank", "lexical_rank"]).select("chunk_id", "dense_rank", "lexical_rank", F.round("fusion_score", 6).alias("fusion_score"), F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


_POLICY = f"WITH a AS (SELECT vec_id, score, rank AS r0 FROM ({_dense_sql(20)})), b AS (SELECT vec_id, row_number() OVER (ORDER BY {_COSINE.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 4)')} DESC, vec_id) AS r1 FROM embeddings WHERE vec_id IN (SELECT vec_id FROM a)), p AS (SELECT vec_id, r0, r1, 0.75::DOUBLE / (60 + r1) + 0.25::DOUBLE / (60 + r0) AS w, 0.75::DOUBLE / (60 + r0) + 0.25::DOUBLE / (60 + r1) AS o FROM a JOIN b USING (vec_id))"


@query("policy_orders", f"{_POLICY} SELECT vec_id, row_number() OVER (ORDER BY r1, vec_id) AS preferred, row_number() OVER (ORDER BY r1, r0, vec_id) AS lexicographic, row_number() OVER (ORDER BY w DESC, vec_id) AS weighted, row_number() OVER (ORDER BY o DESC, vec_id) AS original_weighted, rank() OVER (ORDER BY round(w, 3) DESC) AS fusion_ties FROM p")
def policy_orders(t):
    """Orders of one candidate pool that two expressions of a question rank; ties of the weighted score, to 3 digits, share a rank."""
    pool = _dense(t, 20).select("vec_id", F.col("rank").alias("r0"))
    other = F.array(*[F.lit(float(x)) for x in t.embeddings.where("vec_id = 4").first().embedding])
    again = t.embeddings.join(F.broadcast(pool), "vec_id").select("vec_id", "r0", V.cosine(F.col("embedding"), other).alias("s"))
    both = R.ranked(again, [], F.desc("s"), "vec_id", name="r1")
    part = lambda w, c: F.lit(w) / (F.lit(60) + F.col(c))
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    both = both.withColumn("w", part(0.75, "r1") + part(0.25, "r0")).withColumn("o", part(0.75, "r0") + part(0.25, "r1"))
    return both.select("vec_id", place("r1", "vec_id").alias("preferred"), place("r1", "r0", "vec_id").alias("lexicographic"), place(F.desc("w"), "vec_id").alias("weighted"), place(F.desc("o"), "vec_id").alias("original_weighted"), F.rank().over(Window.orderBy(F.desc(F.round("w", 3)))).alias("fusion_ties"))
