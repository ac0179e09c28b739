"""Staged ingestion: each document passes parse, chunk, embed and index to ready, a stage at a time, by reports that come as a stream.

What is known of a document is the newest generation that was reported and, of that, which stages have succeeded or failed. These are
maxima and sets, so reports may come late, twice or in any order, and stale generations fall away: the table is that of all reports
together. It is kept in immutable generations; a batch's number is committed with its rows, so one that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.generations import Generations

# The stages in order, and the state of a document that waits for each.
STAGES = ("upload", "parse", "chunk", "embed", "index")
STATES = ("NEW", "UPLOADED", "CHUNKING", "EMBEDDING", "INDEXING", "READY")
_STATE = "doc_id long, generation long, succeeded long, failed long, newest timestamp"


def table(spark: SparkSession, path: str, buckets: int = 16) -> Generations:
    return Generations(spark, path, _STATE, "doc_id", buckets)


def folded(reports: DataFrame) -> DataFrame:
    """The state of each document by reports(doc_id, generation, stage, ok, ts): sets of stages as bits. Reports of unknown stages, or
    without a document or generation, say nothing; one without ok is a failure."""
    known = reports.where(F.col("stage").isin(*STAGES) & F.col("doc_id").isNotNull() & F.col("generation").isNotNull())
    bit = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, 1 << i)]), F.col("stage")).cast("long")
    good = F.coalesce(F.col("ok"), F.lit(False))
    return _merged(known.select("doc_id", "generation", F.when(good, bit).otherwise(0).alias("succeeded"), F.when(good, 0).otherwise(bit).alias("failed"), F.col("ts").alias("newest")))


def _merged(states: DataFrame) -> DataFrame:
    one = states.groupBy("doc_id", "generation").agg(F.bit_or("succeeded").cast("long").alias("succeeded"), F.bit_or("failed").cast("long").alias("failed"), F.max("newest").alias("newest"))
    best = one.groupBy("doc_id").agg(F.max_by(F.struct("generation", "succeeded", "failed", "newest"), "generation").alias("s"))
    return best.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("s.generation").cast("long").alias("generation"), "s.succeeded", "s.failed", F.col("s.newest").cast("timestamp").alias("newest"))


def passed() -> Column:
    """How many stages have succeeded without one missing before them."""
    out = F.lit(0)
    for n in range(1, len(STAGES) + 1):
        out = F.when(F.col("succeeded").bitwiseAND(F.lit((1 << n) - 1)) == (1 << n) - 1, n).otherwise(out)
    return out


def status(state: DataFrame) -> DataFrame:
    """doc_id, generation, passed, status: the state it waits in, or FAILED if the stage it waits for has failed and not succeeded since."""
    n = passed()
    waits = F.element_at(F.array(*[F.lit(s) for s in STATES]), n + 1)
    fails = F.col("failed").bitwiseAND(F.pow(F.lit(2), n).cast("long")) != 0
    return state.select("doc_id", "generation", n.alias("passed"), F.when(fails & (n < len(STAGES)), "FAILED").otherwise(waits).alias("status"))


def waiting(state: DataFrame, stage: str) -> DataFrame:
    """doc_id, generation of the documents that wait for this stage: what its next job takes, failed ones not among them."""
    return status(state).where((F.col("passed") == STAGES.index(stage)) & (F.col("status") != "FAILED")).select("doc_id", "generation")


def staged(reports: DataFrame, path: str, checkpoint: str, late: float = 86_400, buckets: int = 16) -> StreamingQuery:
    """Folds a stream of reports into the table at path/state. Reports more than late seconds older than the newest of earlier batches
    count like any other, and are also kept under path/late, by batch."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = table(spark, f"{path}/state", buckets)
        before = state.manifest()
        note = before.note if before else {}
        if note.get("batch", -1) >= number:
            return
        rows = batch.persist()
        try:
            if (newest := note.get("newest")) is not None:
                behind = rows.where(F.unix_micros(F.col("ts").cast("timestamp")) < newest - int(late * 1_000_000))
                behind.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            new = folded(rows)
            keys = new.select("doc_id")
            old = state.read(before).join(keys, "doc_id", "left_semi")
            last = rows.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
            state.replace(_merged(old.unionByName(new)), keys, batch=number, newest=max((x for x in (newest, last) if x is not None), default=None))
        finally:
            rows.unpersist()
        state.vacuum(keep=2)

    return reports.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
