"""Sinks that show whether they are whole: exclusive publication, manifests, a content-addressed cache, uploads with one result each.

Data is written first and what vouches for it last, so a reader never takes a part for the whole, and a job that is run again after a
lost executor or driver leaves one result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .generations import Generations


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Writes df beside path and renames it, whole; FileExistsError, and nothing is left, if path exists."""
    spark = df.sparkSession
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    system, target = _files(spark, path)
    if system.exists(target):
        raise FileExistsError(path)
    try:
        df.write.options(**options).format(kind).save(part)
        if not system.rename(_files(spark, part)[1], target) or system.exists(_files(spark, f"{path}/{part.rsplit('/', 1)[-1]}")[1]):
            raise FileExistsError(path)
    finally:
        for left in (part, f"{path}/{part.rsplit('/', 1)[-1]}"):
            system.delete(_files(spark, left)[1], True)


def markdown_table(df: DataFrame) -> DataFrame:
    """A report's rows as lines of a Markdown table, for publish(kind="text"). Reports are small: one row for each group or document."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n|]+", " ")
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "-|" * len(df.columns),)], "value string")
    return head.coalesce(1).unionByName(body.coalesce(1)).coalesce(1)


def _content(df: DataFrame) -> dict:
    """Rows, different rows' hashes added up, and the schema: the same for the same rows in any order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return {"rows": r.n, "sum": str(r.s), "xor": str(r.x), "schema": df.schema.simpleString()}


def write_artifact(df: DataFrame, path: str, *, per_file: int | None = None, **identity: str) -> dict:
    """Writes df and then a manifest of its rows, their digest and who made it; per_file rows a file at most. Returns the manifest."""
    options = {"maxRecordsPerFile": str(per_file)} if per_file else {}
    df.write.options(**options).parquet(f"{path}/rows")
    spark = df.sparkSession
    manifest = {**_content(spark.read.schema(df.schema).parquet(f"{path}/rows")), **identity}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_artifact(spark: SparkSession, path: str, **identity: str) -> DataFrame:
    """What write_artifact() wrote; ValueError if the manifest is missing, or the rows or their maker aren't those it names."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    except AnalysisException:
        raise ValueError("no manifest") from None
    rows = spark.read.parquet(f"{path}/rows")
    found = _content(rows)
    if any(manifest[k] != v for k, v in {**{k: found[k] for k in ("rows", "sum", "xor")}, **identity}.items()):
        raise ValueError("rows or identity differ from the manifest")
    return rows


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """chunks with the vectors of vectors(key, vector) in place of theirs. ValueError unless each vector is for one chunk, and no chunk
    has two."""
    new = vectors.select(key, F.col(vector).alias("_new"))
    bad = new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("m")), key, "left").where("n > 1 or m is null or m > 1")
    if not bad.isEmpty():
        raise ValueError("vectors without a chunk, or several of one")
    old = F.col(vector) if vector in chunks.columns else F.lit(None).cast(vectors.schema[vector].dataType)
    return chunks.join(new, key, "left").withColumn(vector, F.coalesce("_new", old)).drop("_new")


class ParseCache:
    """Parsed results by the hash of their file, for one recipe: all options and versions that make a difference. Results lie in
    generations, whose newest manifest says which are ready; of several writers at once one commits and the others try again on what it left."""

    def __init__(self, spark: SparkSession, folder: str, recipe: Mapping):
        text = json.dumps(recipe, sort_keys=True, separators=(",", ":"), allow_nan=False)
        self.path = f"{folder}/recipe={hashlib.sha256(text.encode()).hexdigest()}"
        self.table = Generations(spark, self.path, "file_hash string, payload string, payload_hash string", "file_hash")

    def put(self, parsed: DataFrame, attempts: int = 5) -> None:
        """Adds file_hash, payload of parsed where there is none for the file yet: each batch is one commit, the first result stays.
        FileExistsError after so many lost races."""
        new = parsed.groupBy("file_hash").agg(F.min("payload").alias("payload")).withColumn("payload_hash", F.sha2("payload", 256))
        for n in range(attempts):
            fresh = new.join(self.table.read().select("file_hash"), "file_hash", "left_anti")
            try:
                self.table.replace(fresh)
                return
            except FileExistsError:
                if n == attempts - 1:
                    raise

    def get(self, asked: DataFrame) -> DataFrame:
        """asked(file_hash) with state (hit, miss, or corrupt where a payload doesn't match its hash) and payload (of hits)."""
        good = F.sha2("payload", 256) == F.col("payload_hash")
        state = F.when(F.col("payload_hash").isNull(), "miss").when(good, "hit").otherwise("corrupt")
        found = asked.join(self.table.read(), "file_hash", "left").withColumn("state", state)
        return found.withColumn("payload", F.when(F.col("state") == "hit", F.col("payload"))).drop("payload_hash")


def receipts(raw: DataFrame) -> DataFrame:
    """key, length, sha256 of raw(key, content): what an archive is checked by."""
    return raw.select("key", F.octet_length("content").alias("length"), F.sha2("content", 256).alias("sha256"))


def damaged(raw: DataFrame, receipt: DataFrame) -> DataFrame:
    """key, reason of archived rows that are missing, differ from their receipt, or have none."""
    both = receipts(raw).alias("a").join(receipt.alias("b"), "key", "full_outer")
    reason = F.when(F.col("a.sha256").isNull(), "missing").when(F.col("b.sha256").isNull(), "no receipt").when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.length") != F.col("b.length")), "differs")
    return both.select("key", reason.alias("reason")).where("reason is not null")


def upload_results(items: DataFrame, stored: DataFrame, reason: Column, most: int) -> DataFrame:
    """Each of items(item, kb, content) with sha256 and what becomes of it: rejected for reason (null: none), too large, duplicate of a stored
    file or of an earlier item of its base, or stored. One bad item changes nothing for the others. stored has kb and sha256."""
    hashed = items.select("item", "kb", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("length"), reason.alias("reason"))
    refused = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("length") > most, "too large")
    known = stored.select("kb", "sha256").distinct().withColumn("known", F.lit(True))
    rows = hashed.withColumn("refused", refused)
    first = rows.where("refused is null").groupBy("kb", "sha256").agg(F.min("item").alias("first"))  # a row a task for a text of any number of copies
    rows = rows.join(first, ["kb", "sha256"], "left").join(known, ["kb", "sha256"], "left")
    state = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("known") | (F.col("item") > F.col("first")), "duplicate").otherwise("stored")
    return rows.select("item", "kb", "sha256", state.alias("state"))


def granted_claims(requests: DataFrame, held: DataFrame) -> DataFrame:
    """requests(key, owner, at) with granted: a key goes to its first request (ties to the smaller owner) unless another owner holds it.
    Minima are taken in each task, so a contested key costs a row a task."""
    first = requests.groupBy("key").agg(F.min(F.struct("at", "owner"))["owner"].alias("first"))
    own = held.groupBy("key").agg(F.min("owner").alias("holder"))
    winner = first.join(own, "key", "left").select("key", F.coalesce("holder", "first").alias("winner"))
    return requests.join(winner, "key").withColumn("granted", F.col("owner") == F.col("winner")).drop("winner")
