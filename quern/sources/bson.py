"""Documents as BSON bytes. The codec covers what documents hold: double, string, document, array, object id, bool,
datetime, null, int32 and int64. It runs over Arrow batches; a document that can't be read is counted, not fatal.

A file is documents one after the other. Spark's text writer makes it: a document ends with a zero byte, which is the
line separator there. A file has no places to begin at but the first, so reading takes one task for each file."""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def encode(doc: dict) -> bytes:
    parts = []
    for name, v in doc.items():
        head = name.encode() + b"\0"
        if isinstance(v, bool):
            parts.append(b"\x08" + head + bytes([v]))
        elif isinstance(v, int):
            small = -(1 << 31) <= v < 1 << 31
            parts.append((b"\x10" if small else b"\x12") + head + struct.pack("<i" if small else "<q", v))
        elif isinstance(v, float):
            parts.append(b"\x01" + head + struct.pack("<d", v))
        elif isinstance(v, str):
            raw = v.encode()
            parts.append(b"\x02" + head + struct.pack("<i", len(raw) + 1) + raw + b"\0")
        elif isinstance(v, dict):
            parts.append(b"\x03" + head + encode(v))
        elif isinstance(v, (list, tuple)):
            parts.append(b"\x04" + head + encode({str(i): x for i, x in enumerate(v)}))
        elif isinstance(v, dt.datetime):
            parts.append(b"\x09" + head + struct.pack("<q", (v.replace(tzinfo=None) - EPOCH) // dt.timedelta(milliseconds=1)))
        elif v is None:
            parts.append(b"\x0a" + head)
        else:
            raise TypeError(f"no BSON type for {type(v).__name__}")
    body = b"".join(parts)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def decode(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The document at ``at``, and where it ends."""
    end, doc = at + struct.unpack_from("<i", raw, at)[0], {}
    if end > len(raw) or end < at + 5 or raw[end - 1]:
        raise ValueError("not a document")
    at += 4
    while raw[at]:
        kind, stop = raw[at], raw.index(b"\0", at + 1)
        name, at = raw[at + 1 : stop].decode(), stop + 1
        if kind in (0x10, 0x12, 0x09, 0x01):
            form = {0x10: "<i", 0x12: "<q", 0x09: "<q", 0x01: "<d"}[kind]
            doc[name] = struct.unpack_from(form, raw, at)[0]
            at += struct.calcsize(form)
        elif kind == 0x02:
            n = struct.unpack_from("<i", raw, at)[0]
            doc[name], at = raw[at + 4 : at + 3 + n].decode(), at + 4 + n
        elif kind in (0x03, 0x04):
            inner, at = decode(raw, at)
            doc[name] = inner if kind == 0x03 else list(inner.values())
        elif kind == 0x08:
            doc[name], at = bool(raw[at]), at + 1
        elif kind == 0x07:
            doc[name], at = raw[at : at + 12].hex(), at + 12
        elif kind == 0x0A:
            doc[name] = None
        else:
            raise ValueError(f"unknown type {kind}")
    return doc, end


def to_bson(df: DataFrame) -> DataFrame:
    """One column ``bson``: each row as a document, nulls left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [{k: v for k, v in r.items() if v is not None} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"bson": pa.array([encode(d) for d in docs], pa.binary())})

    return df.mapInArrow(run, "bson binary")


def from_bson(df: DataFrame) -> DataFrame:
    """(json, failed) from a column ``bson`` of concatenated documents, as of whole files; failed: one row for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at, found, failed = 0, [], []
                while raw and at < len(raw):
                    size = struct.unpack_from("<i", raw, at)[0] if at + 4 <= len(raw) else 0
                    try:
                        doc, end = decode(raw, at)
                        found.append(json.dumps(doc))
                        failed.append(False)
                        at = end
                    except (ValueError, struct.error, IndexError, UnicodeDecodeError):
                        found.append(None)
                        failed.append(True)
                        if size < 5:
                            break
                        at += size
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pydict({"json": pa.array(found[k : k + 10_000], pa.string()), "failed": pa.array(failed[k : k + 10_000], pa.bool_())})

    return df.select(F.col("bson")).mapInArrow(run, "json string, failed boolean")


def write_bson(df: DataFrame, path: str) -> None:
    """The rows as files of documents."""
    raw = to_bson(df).select(F.expr("CAST(substring(bson, 1, length(bson) - 1) AS STRING)").alias("value"))
    raw.write.option("lineSep", "\0").text(path)


def read_bson(spark: SparkSession, path: str) -> DataFrame:
    """(json, failed) of all documents in the files under ``path``."""
    return from_bson(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("content").alias("bson")))
