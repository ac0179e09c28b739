"""Immutable generations of a table behind one manifest that is renamed last.

Rows are dealt to buckets by a hash of their key. A replacement writes the buckets it touches anew, beside the old ones, and then a
manifest that names a folder for each bucket; the rename of it is the commit, which one of several writers wins. A reader pins a
manifest and sees one generation whole, whatever is replaced meanwhile; a replacement that fails leaves the old one as it is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Manifest:
    """A generation: the folder of each bucket that has rows, and what its writer noted."""

    number: int
    buckets: dict[int, str]
    note: dict = field(default_factory=dict)


class Generations:
    """The generations of a table of this schema below path. buckets can't change once there is a generation."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if self.key not in self.schema.names or "_bucket" in self.schema.names:
            raise ValueError("the schema has the key, and no column _bucket")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self) -> list[int]:
        system, at = self._at(f"{self.path}/manifests")
        return sorted(int(x.getPath().getName()) for x in system.listStatus(at) if x.getPath().getName().isdigit()) if system.exists(at) else []

    def manifest(self, number: int | None = None) -> Manifest | None:
        """A generation, the newest if none is named; None where there is none yet."""
        if number is None:
            number = max(self._numbers(), default=None)
            if number is None:
                return None
        found = json.loads(self.spark.read.text(f"{self.path}/manifests/{number:012d}", wholetext=True).first().value)
        return Manifest(number, {int(b): x for b, x in found["buckets"].items()}, found["note"])

    def read(self, of: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a generation, the newest if none is named; of some of its buckets only, if these are named."""
        of = of or self.manifest()
        paths = [f"{self.path}/data/{x}/_bucket={b}" for b, x in (of.buckets if of else {}).items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self, key: str | None = None):
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.buckets)).cast("int")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, **note) -> Manifest:
        """A new generation in which the rows of keys (those of rows, if none are named) are replaced by rows, and all others stay.

        rows may be computed from what read() gives. A key without rows loses those it had. Null keys are a key of their own. FileExistsError,
        and nothing is changed, if another writer has committed since; any other error leaves the old generation, too. The driver holds
        numbers of buckets only.
        """
        old = self.manifest()
        keys = (rows if keys is None else keys).select(F.col(self.key).alias("_key")).distinct()
        touched = sorted(r[0] for r in keys.select(self.bucket("_key")).distinct().collect())
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        try:
            kept = self.read(old, touched) if old else self.spark.createDataFrame([], self.schema)
            kept = kept.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
            out = kept.unionByName(rows.select(*self.schema.names)).withColumn("_bucket", self.bucket())
            out.repartition("_bucket", F.pmod(F.hash(self.key), F.lit(8))).write.partitionBy("_bucket").parquet(at)
            system, data = self._at(at)
            written = [int(x.getPath().getName().partition("=")[2]) for x in system.listStatus(data) if "=" in x.getPath().getName()]
            carried = {b: x for b, x in (old.buckets if old else {}).items() if b not in touched}
            new = Manifest((old.number if old else 0) + 1, carried | {b: folder for b in written}, {**(old.note if old else {}), **note})
            self._commit(new)
        except BaseException:
            system, data = self._at(at)
            system.delete(data, True)
            raise
        return new

    def _commit(self, new: Manifest) -> None:
        """Writes the manifest beside its place and renames it, as Spark's checkpoints are: fails where there is one."""
        jvm = self.spark._jvm
        part, target = f"{self.path}/manifests/.{uuid.uuid4().hex}", f"{self.path}/manifests/{new.number:012d}"
        system, at = self._at(part)
        stream = system.create(at, False)
        try:
            stream.write(bytearray(json.dumps({"buckets": new.buckets, "note": new.note}, sort_keys=True).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(at), context.makeQualified(self._at(target)[1]), how)
        except Exception as e:
            system.delete(at, False)
            if system.exists(self._at(target)[1]):
                raise FileExistsError(target) from e
            raise

    def vacuum(self, keep: int = 2) -> None:
        """Deletes generations but the newest, and folders that none of these names: readers that pinned older ones lose them."""
        numbers = self._numbers()
        used = {x for n in numbers[-keep:] for x in self.manifest(n).buckets.values()}
        system, data = self._at(f"{self.path}/data")
        for n in numbers[:-keep]:
            system.delete(self._at(f"{self.path}/manifests/{n:012d}")[1], False)
        for x in system.listStatus(data) if system.exists(data) else []:
            if x.getPath().getName() not in used:
                system.delete(x.getPath(), True)
