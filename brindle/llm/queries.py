"""Queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chatformat, decontaminate, divergence, editcount, mixing, packing, quality, simhash, suffixdedup, tokenbin, topk, toxicity
from .common import crc_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@_query("op3_source_mixing", mixing.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op5_token_binary")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.new_path(spark)
    tokenbin.write(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _scored(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@_query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    return _scored(toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out))), held_out)


@_query("op9_quality_mil")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    return _scored(quality.score(docs, quality.fit(docs, labels.where(~held_out))), held_out)


@_query("op6_simhash_golay")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@_query("op1_chat_perspectives", chatformat.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.perspectives(table(spark, sf_dir, "conversations"))


_TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


@_query("op2_topk_threshold", _TOP_K)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.scaled("embedding").alias("vector"))
    return topk.top_k(vectors.where("id % 20 = 0"), vectors)


@_query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"))


@_query("op8_edit_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a replacement after a third of it, an insertion at the middle of that, a deletion near its end."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda pos, n_del, ins: F.struct(pos.cast("int").alias("pos"), F.lit(n_del).alias("n_del"), F.lit(ins).alias("ins"))
    edits = F.array(edit(F.floor(n / 3), 5, "an edited passage"), edit(F.floor(n / 2), 0, "\n\n  it's new "), edit(F.floor(n * 3 / 4), 40, ""))
    docs, path = table(spark, sf_dir, "documents").withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.json")
    state = editcount.counted(docs, tokenizer=path, keep=("doc_id", "edits"))
    return editcount.edited(state, tokenizer=path).select("doc_id", "n_tokens_before", "n_tokens", F.length("text").cast("long").alias("n_chars"), "encoded_chars")


@_query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def _lloyd_sql(rounds: int = 10, k: int = 8, size: int = 64) -> str:
    """Each round is two relations: who is assigned where, and the centroids after it."""
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.e, c.e)])"
    nearest = "SELECT vec_id, e, number, d FROM (SELECT v.vec_id, v.e, v.at, c.number, {0} AS d, row_number() OVER (PARTITION BY v.at ORDER BY {0}, c.number) AS r FROM v, {1} c) WHERE r = 1"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS at, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
           WHERE len(embedding) = {size} AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS number, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))"]
    for n in range(rounds):
        whole = ", ".join(f"CAST((s[{i}] - ((s[{i}] % n) + n) % n) // n AS BIGINT)" for i in range(1, size + 1))
        sums = ", ".join(f"sum(e[{i}])" for i in range(1, size + 1))
        parts += [f"a{n} AS MATERIALIZED ({nearest.format(distance, f'c{n}')})",
                  f"m{n} AS (SELECT number, [{whole}] AS e FROM (SELECT number, count(*) AS n, [{sums}] AS s FROM a{n} GROUP BY number))",
                  f"c{n + 1} AS MATERIALIZED (SELECT c.number, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN m{n} m USING (number))"]
    parts.append(f"a AS MATERIALIZED ({nearest.format(distance, f'c{rounds}')})")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (number)"""


@_query("op11_centroid_clustering", _lloyd_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


@_query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op13_source_divergence", divergence.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
