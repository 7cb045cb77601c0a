"""WARC files as a sink: one response record a page, zstd-compressed, one file a task (more by size)."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from pathlib import Path

import xxhash
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ROLL_BYTES = 1 << 30


def date_of(seconds: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _id(url: str, seconds: int) -> str:
    a, b = (xxhash.xxh3_64_intdigest(f"{x}\x01{y}".encode()) for x, y in ((url, seconds), (seconds, url)))
    x = f"{a:016x}{b:016x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def record(kind: str, headers: dict[str, str], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def response(url: str, seconds: int, content_type: str | None, body: str) -> bytes:
    payload = body.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type or 'text/html'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record("response", {"WARC-Target-URI": url, "WARC-Date": date_of(seconds), "WARC-Record-ID": _id(url, seconds), "Content-Type": "application/http; msgtype=response"}, http)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, roll: int):
        self.folder, self.roll = folder, roll

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        context = TaskContext.get()
        stem = f"{self.folder}/pages-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, held, n = None, 0, 0
        for row in rows:
            if out is None or held > self.roll:
                if out is not None:
                    out.close()
                out, held, n = zstandard.open(f"{stem}-{n:03d}.warc.zst", "wb", cctx=zstandard.ZstdCompressor(level=6, write_checksum=True)), 0, n + 1
                out.write(record("warcinfo", {"WARC-Date": date_of(0), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            data = response(row["url"], row["fetched_at"], row["content_type"], row["body"] or "")
            out.write(data)
            held += len(data)
        if out is not None:
            out.close()
        return WriterCommitMessage()


class WarcSink(DataSource):
    """Format ``seek_warc``: columns url, fetched_at, content_type, body; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "seek_warc"

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("roll", ROLL_BYTES)))


def read_warc(path: str | Path) -> list[dict]:
    """The records of a file: headers, and the payload of responses as ``body``."""
    with open(path, "rb") as f:
        data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    out, stream = [], io.BytesIO(data)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            continue
        headers = {}
        while (line := stream.readline().strip()) != b"":
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        body = stream.read(int(headers["Content-Length"]))
        out.append(headers | {"body": body.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else body})
    return out
