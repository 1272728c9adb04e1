"""A keyed table that streams maintain (SNK-9, STR-6, STR-7).

Rows live in hash buckets of their key. An epoch rewrites only the buckets its
keys fall in: each bucket has two slots, the epoch writes the one that is not
current (dynamic partition overwrite) and then a manifest that names every
bucket's current slot. So at most two versions of a bucket exist, the older one is
overwritten in turn, and the table does not grow with the epochs.

A retried epoch starts from the manifest of the epoch before it, whose slots
it does not touch, and writes the same buckets again. Manifests alternate between two
places for the same reason; each has a row a bucket. One query writes a table, its epochs
rise; a reader takes the newest manifest (and reads again if two epochs pass meanwhile).

``buckets`` is fixed when the table is made: choose it so that a bucket holds some
hundred megabytes. Inside a bucket Spark rebalances large partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gavel.session import written

MANIFEST = "epoch long, bucket int, slot int"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 32):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        try:
            self.buckets = len(self._slots())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets = buckets
            self._commit(-1, [None] * buckets)

    def _slots(self, before: int | None = None) -> list:
        """Each bucket's slot as of the newest manifest (of an epoch before ``before``)."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/place=0", f"{self.path}/manifest/place=1").where(
            F.lit(True) if before is None else F.col("epoch") < before).collect()  # two rows a bucket at most
        if not rows:
            raise RuntimeError(f"{self.path}: no manifest of an epoch before {before}")
        newest = max(r["epoch"] for r in rows)
        return [r["slot"] for r in sorted((r for r in rows if r["epoch"] == newest), key=lambda r: r["bucket"])]

    def _commit(self, epoch: int, slots: list) -> None:
        rows = self.spark.createDataFrame([(epoch, b, s) for b, s in enumerate(slots)], MANIFEST).coalesce(1)
        if epoch < 0:  # the other place exists, empty
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/manifest/place=0")
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/place={epoch % 2}")

    def _current(self, slots: list, buckets) -> DataFrame:
        paths = [f"{self.path}/rows/slot={slots[b]}/bucket={b}" for b in buckets if slots[b] is not None]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The table as of the newest finished epoch."""
        return self._current(self._slots(), range(self.buckets))

    def merge(self, batch: DataFrame, epoch: int, pick: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Merge an epoch's rows; ``pick`` leaves one row a key and does so in any
        order of grouping (it runs on the batch, then on batch and table). Returns
        the buckets written."""
        rows = written(pick(batch).select(*self.schema.names), "keyed-batch")
        touched = self._touched(rows)
        slots = self._slots(epoch)
        if touched:
            target = [1 - s if s is not None else 0 for s in slots]
            merged = pick(rows.unionByName(self._current(slots, touched))).select(*self.schema.names)
            placed = merged.withColumn("bucket", self._bucket()).withColumn(
                "slot", F.get(F.array(*[F.lit(t) for t in target]), F.col("bucket")))
            placed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "slot", "bucket").parquet(f"{self.path}/rows")
            for b in touched:
                slots[b] = target[b]
        self._commit(epoch, slots)
        return touched

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets

    def absent(self, batch: DataFrame, epoch: int) -> DataFrame:
        """The batch's keys that no epoch before this one has seen."""
        keys = written(batch.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "keyed-keys")
        seen = self._current(self._slots(epoch), self._touched(keys)).select(self.key)
        return keys.join(seen, self.key, "left_anti")
