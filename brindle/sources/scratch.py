"""Tables between the steps of a query, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from .readers import shared_folder

_folders: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession, name: str = "step") -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_folder(spark)}/brindle/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: what it costs is paid once, and a lost executor costs a reread."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    for spark, path in _folders:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM may have ended before Python does
            return
