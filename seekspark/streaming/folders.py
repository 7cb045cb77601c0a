"""Where streams keep what they write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seekspark.sources.tables import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a Parquet file or folder, some files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").isEmpty():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)
