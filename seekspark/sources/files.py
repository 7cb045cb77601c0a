"""Small files in whatever file system a path names, by Spark's own connectors: local, HDFS or an object store."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, ascending; none if it is missing."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int, bool]]:
    """(name, bytes, whether it is a file) of what lies in a folder; nothing if it is missing."""
    fs, where = _at(spark, folder)
    return sorted((s.getPath().getName(), s.getLen(), s.isFile()) for s in fs.listStatus(where)) if fs.exists(where) else []


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(time of the last change, bytes) of a file; None if it is missing."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    status = fs.getFileStatus(where)
    return status.getModificationTime(), status.getLen()


def size_below(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder; 0 if it is missing."""
    fs, where = _at(spark, folder)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None if it is missing."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(fs, where, text: str) -> None:
    stream = fs.create(where, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet, whole or not at all; False if another writer came first."""
    fs, where = _at(spark, path)
    beside = where.suffix(f".{uuid.uuid4().hex}.tmp")
    if fs.exists(where):
        return False
    _write(fs, beside, text)
    done = fs.rename(beside, where)
    if not done:
        fs.delete(beside, False)
    return done


def write_over(spark: SparkSession, path: str, text: str) -> None:
    """Write a file in place of the one there, if any: beside it first, then by a rename that replaces."""
    context = spark.sparkContext
    jvm = context._jvm
    fs, where = _at(spark, path)
    beside = where.suffix(f".{uuid.uuid4().hex}.tmp")
    _write(fs, beside, text)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), context._jsc.hadoopConfiguration()) if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(context._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = context._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    files.rename(files.makeQualified(beside), files.makeQualified(where), options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A JSON file; None if it is missing, can't be read or isn't whole."""
    try:
        text = read_text(spark, path)
        return None if text is None else json.loads(text)
    except (ValueError, Py4JJavaError):
        return None
