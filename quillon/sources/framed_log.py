"""Framed logs: records of [length u32][crc32 u32][payload], big-endian.

A file is read by one task, files in parallel.  Offline import and export of
write-ahead logs; live ingestion is a stream with a checkpoint instead.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .otlp_binary import decode

SCHEMA = "path string, offset bigint, payload binary, error string"
_HEAD = struct.Struct(">II")
MOST = 2**31 - 1


def frame(payload: bytes) -> bytes:
    """One record; an empty payload or one of 2**31 bytes is refused."""
    if not 0 < len(payload) <= MOST:
        raise ValueError(f"a record has 1 to {MOST} bytes, not {len(payload)}")
    return _HEAD.pack(len(payload), zlib.crc32(payload)) + payload


def records(data: bytes, start: int = 0):
    """(offset, payload, error) of each record; error is null, "crc" or "truncated", which ends the file."""
    at = start
    while at < len(data):
        if at + _HEAD.size > len(data):
            yield at, None, "truncated"
            return
        size, crc = _HEAD.unpack_from(data, at)
        payload = data[at + _HEAD.size : at + _HEAD.size + size]
        if len(payload) < size:
            yield at, None, "truncated"
            return
        yield at, payload, None if zlib.crc32(payload) == crc else "crc"
        at += _HEAD.size + size


def framed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(path, content): the payloads of each partition as the content of one log, batch by batch."""
    def run(batches):
        for k, b in enumerate(batches):
            data = b"".join(frame(x) for x in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([f"{b.column(1)[0].as_py():05d}-{k:05d}.wal"], pa.string()), pa.array([data], pa.binary())], names=["path", "content"])

    return payloads.select(payload, F.spark_partition_id().alias("p")).mapInArrow(run, "path string, content binary")


def records_of(files: DataFrame, offsets: dict[str, int] | None = None) -> DataFrame:
    """path, offset, payload, error of all records of (path, content) rows; of named files from an offset on."""
    offsets = offsets or {}

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = next((v for k, v in offsets.items() if name == k or name.endswith("/" + k.lstrip("/"))), 0)
                rows = list(records(content, start))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["path", "offset", "payload", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _read(spark: SparkSession, path: str, offsets: dict[str, int]) -> DataFrame:
    return records_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path), offsets)


def strict(spark: SparkSession, path: str) -> DataFrame:
    """All records; reading fails at the first bad one."""
    bad = F.raise_error(F.concat(F.lit("bad record: "), F.col("error"), F.lit(" in "), F.col("path")))
    rows = _read(spark, path, {})
    return rows.select("path", "offset", F.when(F.col("error").isNull(), F.col("payload")).otherwise(bad.cast("binary")).alias("payload"))


def tolerant(spark: SparkSession, path: str, offsets: dict[str, int] | None = None, stop: bool = False) -> DataFrame:
    """Good records, of named files from an offset on.  Bad checksums are skipped; with ``stop`` they end their file."""
    rows = _read(spark, path, offsets or {})
    if stop:
        first = rows.where("error is not null").groupBy("path").agg(F.min("offset").alias("end"))
        rows = rows.join(first, "path", "left").where(F.col("end").isNull() | (F.col("offset") < F.col("end")))
    return rows.where("error is null").select("path", "offset", "payload")


def discover(spark: SparkSession, path: str) -> list[str]:
    """Paths of the log files of a folder, in the order of the numbers in their names."""
    names = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path").collect()]
    return sorted(names, key=lambda n: ([int(x) for x in re.findall(r"\d+", n.rsplit("/", 1)[-1])], n))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, bytes of each good record; service and spans (count) where it is a trace payload, else null."""
    def run(batches):
        for b in batches:
            services, spans = [], []
            for data in b.column(2).to_pylist():
                try:
                    got = decode(data, "ResourceSpans")
                except (ValueError, IndexError, struct.error, TypeError):
                    got = {}
                found = [a.get("value", {}).get("stringValue") for a in got.get("resource", {}).get("attributes", []) if a.get("key") == "service.name"]
                services.append(found[0] if found else None)
                spans.append(sum(len(s.get("spans", [])) for s in got["scopeSpans"]) if "scopeSpans" in got else None)
            sizes = [len(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(services, pa.string()), pa.array(spans, pa.int64())], names=["path", "offset", "bytes", "service", "spans"])

    return tolerant(spark, path).mapInArrow(run, "path string, offset bigint, bytes bigint, service string, spans bigint")


def append(path: str, payloads: list[bytes]) -> int:
    """Add a batch to a local file with one write, flushed to disk; any bad payload refuses all.  Returns its size."""
    import os

    data = b"".join(map(frame, payloads))
    with open(path, "ab") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
        return f.tell()
