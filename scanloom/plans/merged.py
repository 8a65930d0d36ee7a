"""A table that a stream keeps up to date: one current row per key.

A stream in update mode sends rows again when they change. Each batch is written as it is, and every
``every`` batches what has been written becomes a new base with one row per key, so a reader
merges one base and fewer than ``every`` small batches, however long the stream has run.

Base and batches lie in two places that take turns: while one is written, readers use the other, and a
small marker, written last, makes them change over. A batch that runs again after a failure writes the same
rows to the same place. A reader has the time of ``every`` batches to finish.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class MergedTable:
    root: str
    keys: tuple[str, ...]
    schema: StructType | str  # without ``batch_id``
    every: int = 50

    def _schema(self) -> StructType:
        given = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        return StructType([*given.fields]).add("batch_id", "long")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` sink."""
        spark, epoch = batch.sparkSession, batch_id // self.every
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        place = f"{self.root}/log/place={epoch % 2}"
        if epoch and batch_id % self.every == 0:
            self._merged(spark, epoch - 1).write.mode("overwrite").parquet(f"{self.root}/base/place={epoch % 2}")
        if batch_id % self.every == 0:
            rows.write.mode("overwrite").parquet(place)  # takes the batches of two turns ago away
            marker = spark.range(1).select(F.lit(epoch).cast("bigint").alias("epoch"))
            marker.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marker/place={epoch % 2}")
        else:
            rows.write.mode("overwrite").parquet(f"{place}/batch={batch_id % self.every}")

    def _merged(self, spark: SparkSession, epoch: int, before: int | None = None) -> DataFrame:
        """One row per key as of an epoch, ``batch_id`` included."""
        paths = [f"{self.root}/log/place={epoch % 2}"] + ([f"{self.root}/base/place={epoch % 2}"] if epoch else [])
        schema = self._schema()
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        others = [c for c in schema.fieldNames() if c not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_row"))
        return latest.select(*self.keys, "_row.*").select(*schema.fieldNames())

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The current rows, or those of the batches before a recent one. A table that nothing was written to
        is an error of the reader."""
        epoch = spark.read.schema("epoch bigint").option("recursiveFileLookup", "true").parquet(
            f"{self.root}/marker").agg(F.max("epoch")).first()[0]
        return self._merged(spark, epoch, before).drop("batch_id")
