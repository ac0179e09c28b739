"""Retrieval: dense top-k, reciprocal rank fusion, reranking. BM25+ is in lexical.py."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V

#: Terms and scopes up to this many values are sent as literals; a larger scope is a table and joined.
MOST_IDS = 100
#: Rows of a shard and queries of a block in a batch search.
SHARD, BLOCK = 16_384, 2048


def scope(ids: Sequence[int] | None) -> list[int] | None:
    """Distinct ids in order; None means all, an empty list is an error, as are more than MOST_IDS."""
    if ids is None:
        return None
    chosen = sorted(set(ids))
    if not 1 <= len(chosen) <= MOST_IDS:
        raise ValueError(f"a scope has 1 to {MOST_IDS} ids")
    return chosen


def dense_top_k(chunks: DataFrame, query: Sequence[float], k: int, *, id: str = "chunk_id", vector: str = "embedding", ids: Sequence[int] | None = None) -> DataFrame:
    """id, score, rank of the k nearest rows by cosine, ties to smaller ids. The top k are found in each task before they meet."""
    q = F.array(*[F.lit(float(x)) for x in query])
    kept = scope(ids)
    rows = chunks.where(F.col(vector).isNotNull()) if kept is None else chunks.where(F.col(vector).isNotNull() & F.col(id).isin(kept))
    top = rows.select(id, V.cosine(F.col(vector), q).alias("score")).where("score is not null").orderBy(F.desc("score"), id).limit(k)
    return ranked(top, [], F.desc("score"), id)


def ranked(rows: DataFrame, by: list[str], *order, name: str = "rank") -> DataFrame:
    """rows with their place from 1 in each group of by. Without groups the rows must be few: a top k."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _cell(k: int, id: str, vector: str):
    """The k best of a shard's rows for each query of a block; all vectors are of one size, without nulls."""

    def columns(column: pa.ChunkedArray, size: int) -> np.ndarray:
        return np.ascontiguousarray(pc.list_flatten(column).to_numpy().astype(float).reshape(-1, size).T)

    def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Summed in the order of V.dot, so that equal vectors score alike wherever they stand."""
        out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
        for x, y in zip(a, b):
            out += x * y
        return out

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found, of, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(id, "ascending")], null_placement="at_start"))
        if len(rows) and len(asked):
            size = rows.column("_size")[0].as_py()
            a, b = columns(rows.column(vector), size), columns(asked.column("query"), size)
            a_norm, b_norm = np.sqrt(dots(a, a)), np.sqrt(dots(b, b))
            for first in range(0, len(asked), 16):
                length = b_norm[first : first + 16, None] * a_norm
                with np.errstate(divide="ignore", invalid="ignore"):
                    block = dots(b[:, first : first + 16, None], a[:, None, :]) / length
                for i, score in enumerate(block):
                    key = np.where(np.isnan(score), np.inf, score)  # Spark has NaN above all
                    at = np.flatnonzero(length[i] != 0)
                    if len(at) > k:
                        at = at[key[at] >= np.partition(key[at], len(at) - k)[len(at) - k]]
                    at = at[np.argsort(-key[at], kind="stable")][:k]  # rows are in the order of their ids, so ties are too
                    found.append(at)
                    of.append(np.full(len(at), first + i))
                    scores.append(score[at])
        found, of = np.concatenate(found), np.concatenate(of)
        return pa.table({"query_id": asked.column("query_id").take(pa.array(of)), id: rows.column(id).take(pa.array(found)), "score": np.concatenate(scores)})

    return run


def dense_batch_top_k(chunks: DataFrame, queries: DataFrame, k: int, *, id: str = "chunk_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank for each row of queries(query_id, query): the k nearest rows by cosine, ties to smaller ids.

    Rows fall into shards and queries into blocks. A task scores one block in one shard and keeps the best k of each query, which a window
    merges. Vectors of another size than the query's, and those with null components, aren't near to anything.
    """
    whole = lambda v: (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    rows, asked = chunks.select(id, vector).where(whole(F.col(vector))), queries.select("query_id", "query").where(whole(F.col("query")))
    shards, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, shard), (asked, block)))
    place = lambda n, seed, *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("*", F.size(vector).alias("_size"), place(shards, 1, id, vector).alias("_shard"), every(blocks).alias("_block"))
    asked = asked.select("*", F.size("query").alias("_size"), every(shards).alias("_shard"), place(blocks, 2, "query_id", "query").alias("_block"))
    cell = ["_size", "_shard", "_block"]
    kinds = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(id, rows.schema[id].dataType), StructField("score", DoubleType())])
    found = rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(_cell(k, id, vector), kinds)
    return ranked(found, ["query_id"], F.desc("score"), id).where(F.col("rank") <= k)


def reciprocal_fusion(branches: DataFrame, *, id: str = "chunk_id", k: int = 60, limit: int = 30, mean_of: int | None = None) -> DataFrame:
    """id, fusion_score and rank from branches(branch, id, rank): the sum of 1 / (k + rank), or its mean over mean_of lists."""
    total = F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank")))
    fused = branches.groupBy(id).agg((total if mean_of is None else total / mean_of).alias("fusion_score")).orderBy(F.desc("fusion_score"), id).limit(limit)
    return ranked(fused, [], F.desc("fusion_score"), id)


def hybrid(dense: DataFrame, lexical: DataFrame, *, id: str = "chunk_id", k: int = 60, limit: int = 30) -> DataFrame:
    """Both branches joined on id: dense_rank, lexical_rank, fusion_score, rank. An empty branch is legal."""
    a, b = dense.select(id, F.col("rank").alias("dense_rank")), lexical.select(id, F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = a.join(b, id, "full_outer").withColumn("fusion_score", part("dense_rank") + part("lexical_rank")).orderBy(F.desc("fusion_score"), id).limit(limit)
    return ranked(fused, [], F.desc("fusion_score"), id)


def model_identity(**parts: str | int | bool) -> str:
    """A hash of what makes vectors comparable: a model's name, fingerprint, dimension, normalisation, version, longest input and precision. The
    same for the same parts in any order."""
    needed = {"name", "fingerprint", "dimension", "normalized", "version", "max_length", "precision"}
    if set(parts) != needed:
        raise ValueError(f"an identity has {sorted(needed)}")
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def of_model(vectors: DataFrame, identity: str, column: str = "model") -> DataFrame:
    """vectors, each made by this model: one of another model, or of none, is an error where it is read, never left out."""
    other = F.when(~F.col(column).eqNullSafe(F.lit(identity)), F.raise_error(F.lit("vectors of another model")))
    return vectors.withColumn("_other", other.cast("string")).where("_other is null").drop("_other")


def branch_conflicts(dense: DataFrame, lexical: DataFrame, columns: Sequence[str], id: str = "chunk_id") -> DataFrame:
    """id, column of hits of both branches that don't agree on what they hit: any of columns differs, or an id comes twice in a branch. Fusion is
    right only where this is empty."""
    text = lambda df, n: df.groupBy(id).agg(F.count(F.lit(1)).alias(f"n{n}"), *[F.first(F.col(c)).alias(f"{c}{n}") for c in columns])
    both = text(dense, 0).join(text(lexical, 1), id, "full_outer")
    met = F.col("n0").isNotNull() & F.col("n1").isNotNull()
    found = F.array_compact(F.array(F.when((F.col("n0") > 1) | (F.col("n1") > 1), F.lit(id)), *[F.when(met & ~F.col(f"{c}0").eqNullSafe(F.col(f"{c}1")), F.lit(c)) for c in columns]))
    return both.select(id, F.explode(found).alias("column"))


def rerank(hits: DataFrame, scorer: Callable[[Column], Column], *, text: str = "text", id: str = "chunk_id", limit: int = 5, pairs: int = 100, chars: int = 2_000_000) -> DataFrame:
    """hits with rerank_score by a scorer of pairs and rerank_rank, the limit best; their earlier scores stay. More than pairs hits, or chars
    characters in all, are an error, as a model's budget is fixed; one task counts them, pairs + 1 at most."""
    all_hits = Window.partitionBy()
    size = F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(all_hits)
    over = F.when(F.count(F.lit(1)).over(all_hits) > pairs, F.raise_error(F.lit(f"over {pairs} pairs"))).when(size > chars, F.raise_error(F.lit(f"over {chars} characters")))
    checked = hits.limit(pairs + 1).withColumn("_over", over.cast("string")).where("_over is null").drop("_over")
    scored = checked.withColumn("rerank_score", scorer(F.col(text))).orderBy(F.desc("rerank_score"), id).limit(limit)
    return ranked(scored, [], F.desc("rerank_score"), id, name="rerank_rank")


def overlap_scorer(query: str) -> Callable[[Column], Column]:
    """A stand-in for a model: the share of the query's different tokens that a text holds."""
    wanted = T.tokens(F.lit(query))
    return lambda text: F.size(F.array_intersect(T.tokens(text), wanted)) / F.size(F.array_distinct(wanted))


def encoded(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], *, id: str = "chunk_id", text: str = "text", rows: int = 32, chars: int = 100_000) -> DataFrame:
    """id and embedding of texts(id, text) by a model that encodes lists: batches have rows texts and chars characters at most, but for a
    single longer text. The encoder goes with the tasks; it may load its model when first called."""
    import pandas as pd

    def run(parts):
        for part in parts:
            out, held, total = [], [], 0
            for value in [*part[text].fillna(""), None]:
                if held and (value is None or len(held) == rows or total + len(value) > chars):
                    out += encoder(held)
                    held, total = [], 0
                if value is not None:
                    held.append(value)
                    total += len(value)
            yield pd.DataFrame({id: part[id], "embedding": out})

    return texts.select(id, text).mapInPandas(run, f"{id} {texts.schema[id].dataType.simpleString()}, embedding array<float>")


def refined(texts: DataFrame, counter: Callable[[str], int], most: int, *, id: str = "chunk_id", text: str = "text", whole: str | None = None, table: str | None = None) -> DataFrame:
    """id, part, start, end, tokens: texts that a model's tokenizer finds longer than most, cut in halves at the white space nearest to their
    middle, and again, until each part fits; whole names a boolean column of texts (formulas) that are never cut, table one of tables, which are
    cut behind the row end (of HTML, or a line) nearest to their middle as long as there is one. Parts tile the text."""
    import pandas as pd

    def row_end(value: str, start: int, middle: int, end: int) -> int | None:
        ends = [at + len(mark) for mark in ("</tr>", "\n") for at in (value.rfind(mark, start, middle), value.find(mark, middle, end)) if at >= 0]
        return min((x for x in ends if start < x < end), key=lambda x: (abs(x - middle), x), default=None)

    def halves(value: str, start: int, end: int, rows: bool):
        n = counter(value[start:end])
        if n <= most or end - start < 2:
            return [(start, end, n)]
        middle = (start + end) // 2
        if rows and (at := row_end(value, start, middle, end)) is not None:
            return halves(value, start, at, rows) + halves(value, at, end, rows)
        left, right = value.rfind(" ", start + 1, middle), value.find(" ", middle, end - 1)
        at = min((x for x in (left, right) if x > 0), key=lambda x: abs(x - middle), default=middle - 1) + 1
        return halves(value, start, at, rows) + halves(value, at, end, rows)

    def run(parts):
        for part in parts:
            out = []
            for key, value, kept, rows in zip(part[id], part[text].fillna(""), part["_whole"], part["_table"]):
                cut = [(0, len(value), counter(value))] if kept else halves(value, 0, len(value), rows)
                out += [(key, i, *c) for i, c in enumerate(cut)]
            yield pd.DataFrame(out, columns=[id, "part", "start", "end", "tokens"])

    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    marked = texts.select(id, text, flag(whole).alias("_whole"), flag(table).alias("_table"))
    return marked.mapInPandas(run, f"{id} {texts.schema[id].dataType.simpleString()}, part int, start int, end int, tokens int")
