"""Stateful behaviour over event streams: latest generation, rolling rates, retries, windows, staged ingestion."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rolling_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with how many of the key fell into the seconds up to each, itself included.

    Time is cut into blocks of that length: an event's window reaches back into one earlier block only, so counts are taken in
    windows over (key, two blocks) and no task needs a key's whole history.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    rows = events.withColumn("_at", micros).withColumn("_block", F.floor(F.col("_at") / width))
    both = rows.withColumn("_own", F.lit(True)).unionByName(rows.withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_block").orderBy("_at").rangeBetween(-width + 1, 0)
    return both.withColumn("recent", F.count(F.lit(1)).over(w)).where("_own").drop("_at", "_block", "_own")


@dataclass(frozen=True)
class Quota:
    """At most so many grants in the seconds up to a request; a request beyond it waits, or is out for the time being if final."""

    seconds: int
    most: int
    final: bool = False


def admissions(requests: DataFrame, key: str, ts: str, order: str, quotas: tuple[Quota, ...], count: str | None = None) -> DataFrame:
    """requests with state (granted, wait or exhausted) and wait_seconds: whether each, in the order of ts and order, may go ahead.

    A request asks for count grants (1 if none is named) at once. Only grants count against a quota, so each answer depends on those
    before it: a key's requests pass a fold in order, which holds the times of its grants within the longest quota, no more than the
    quotas allow, so a key of any length takes bounded memory; Spark sorts them on disk. The first quota that is full answers: wait with
    the seconds until its oldest grant is out, 1 at least, or exhausted if it is final. A request for more than a quota's most is
    never granted. Null keys are a key; a null time or count is refused as exhausted and changes nothing.
    """
    kind = requests.schema
    rows = requests.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_n", F.lit(1).cast("long") if count is None else F.col(count).cast("long"))
    schema = rows.drop("_at", "_n").schema.add("state", "string").add("wait_seconds", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = object(), [deque() for _ in quotas]  # time and number of the grants of each quota, oldest first
        sums = [0] * len(quotas)

        def asked(at: int | None, n: int | None) -> tuple[str, int]:
            if at is None or n is None or n < 1:
                return "exhausted", 0
            for i, q in enumerate(quotas):
                while held[i] and held[i][0][0] <= at - q.seconds * 1_000_000:
                    sums[i] -= held[i].popleft()[1]
                if sums[i] + n > q.most:
                    if q.final or not held[i]:
                        return "exhausted", 0
                    return "wait", max(1, -((at - held[i][0][0] - q.seconds * 1_000_000) // 1_000_000))
            for i in range(len(quotas)):
                held[i].append((at, n))
                sums[i] += n
            return "granted", 0

        for batch in batches:
            out = []
            for k, at, n in zip(*(batch.column(c).to_pylist() for c in (key, "_at", "_n"))):
                if k != last:
                    last, held, sums = k, [deque() for _ in quotas], [0] * len(quotas)
                out.append(asked(at, n))
            kept = [batch.column(f.name) for f in kind]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], [*kind.names, "state", "wait_seconds"])

    return rows.repartition(key).sortWithinPartitions(key, F.col("_at").asc_nulls_first(), order).mapInArrow(run, schema)


def backoff(attempt, first: float = 5.0, most: int = 3):
    """Seconds to wait before a retry: doubled each time; null beyond the last."""
    return F.when(attempt < most, F.lit(first) * F.pow(F.lit(2.0), attempt))


def read_events(spark: SparkSession, folder: str, per_trigger: int = 8) -> DataFrame:
    """The events table as a stream of files, its time as a timestamp that watermarks accept."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of windows. A stream's rows that come later than late after newer ones aren't counted: their windows are closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each session of a user; later rows aren't counted, as in tumbling()."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def ingest(stream: DataFrame, out: str, checkpoint: str, key: str = "event_id", ts: str = "ts") -> StreamingQuery:
    """Appends a stream to a Parquet table, partitioned by batch and day of ts: each key once, however often and however late it comes.

    A batch drops the keys that are stored already, found by an anti-join with those of the days it has rows of; there is no watermark and
    no state, so nothing is forgotten and no late row is lost. It writes a folder of its own number and overwrites that on a rerun. A
    repeated key is taken to have the same day; rows without a key are all kept, those without a time have a day of their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.withColumn("day", F.to_date(ts)).persist()
        try:
            days = [r.day for r in rows.select("day").distinct().collect()]
            fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
            try:
                stored = spark.read.parquet(out).where(F.col("batch") != number)
            except AnalysisException:  # nothing yet
                stored = None
            if stored is not None:
                there = stored.where(F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() if None in days else F.lit(False)))
                fresh = fresh.join(there.select(key), key, "left_anti").select(*rows.columns)
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
