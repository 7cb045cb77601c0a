"""A keyed table that a stream keeps: each batch writes what it changes, and changes are merged now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekspark.operators.engine import latest
from seekspark.sources import files


class Deltas:
    """Batches lie side by side under their numbers, so one that runs twice writes the same again. Every ``every``-th also writes the whole table, which bounds what a reader merges and rewrites a row once in that many batches."""

    def __init__(self, spark: SparkSession, folder: str, key: str, every: int = 16):
        self.spark, self.folder, self.key, self.every = spark, folder.rstrip("/"), key, every

    def _names(self, besides: str = "") -> list[str]:
        """The newest whole table, if any, and the batches behind it."""
        found = [n for n in files.names(self.spark, self.folder) if n != besides]
        whole = max((n for n in found if n.startswith("whole-")), default=None)
        return [n for n in (whole,) if n] + [n for n in found if n.startswith("batch-") and (whole is None or n[6:] > whole[6:])]

    def _merged(self, names: list[str], schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return latest(reader.parquet(*(f"{self.folder}/{n}" for n in names)), self.key, "__batch")

    def write(self, df: DataFrame, batch: int) -> None:
        """``df`` has one row for a key."""
        df.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch:012d}")
        if (batch + 1) % self.every:
            return
        # A batch that runs again makes its whole table again, from what it made it of before.
        names = [n for n in self._names(f"whole-{batch:012d}") if n[6:] <= f"{batch:012d}"]
        self._merged(names).write.mode("overwrite").parquet(f"{self.folder}/whole-{batch:012d}")
        # What the table before this one was made of isn't needed again: only this batch may run once more.
        before = max((n for n in names if n.startswith("whole-")), default=None)
        for n in files.names(self.spark, self.folder):
            if before and n[6:] <= before[6:] and n != before:
                files.remove(self.spark, f"{self.folder}/{n}")

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The table after the last batch; None before the first."""
        names = self._names()
        return self._merged(names, schema).drop("__batch") if names else None
