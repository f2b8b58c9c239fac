"""The change stream of a log: which changes are published, reads from a cursor, retention, and replicas.

A batch read returns changes beyond a cursor in lsn order; the cursor to go on from is the last lsn returned, so a
read that stops at ``max_records`` loses nothing. As a stream the log is read by Structured Streaming's file source,
whose checkpoint is the cursor, and a replica applies each micro-batch by last write wins, which repeats can't change.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.errors import CursorBehindRetention, QueryError
from quern.operators.changes import DML, latest

DEFAULT_RECORDS, DEFAULT_RETENTION = 256, 16_384


def published(masks: Mapping[str, Sequence[str]]) -> Column:
    """Changes that a store publishes; a store that isn't named publishes none."""
    found = F.lit(False)
    for store, kinds in masks.items():
        if unknown := set(kinds) - set(DML):
            raise QueryError(f"unknown change: {sorted(unknown)}")
        found = found | ((F.col("store") == store) & F.col("kind").isin(*kinds))
    return found


def watch(log: DataFrame, stores: Sequence[str] = (), since: int = 0, max_records: int = 0, retention: int | None = None) -> DataFrame:
    """Changes with lsn > since, in order, ``max_records`` at most (0: 256). No stores: all.

    With ``retention`` only that many newest changes can be read; a cursor before the oldest of them is an error, but for 0.
    """
    kept = log
    if retention is not None:
        high = log.agg(F.max("lsn")).first()[0]
        oldest = log.orderBy(F.desc("lsn")).limit(retention).agg(F.min("lsn")).first()[0] if high is not None else None
        if oldest is not None:
            if 0 < since < oldest:
                raise CursorBehindRetention(f"{since} is before {oldest}")
            kept = log.where(F.col("lsn") >= oldest)
    found = kept.where(F.col("lsn") > since)
    if stores:
        found = found.where(F.col("store").isin(*stores))
    return found.orderBy("lsn").limit(max_records or DEFAULT_RECORDS)


def cursor_after(read: DataFrame, since: int) -> int:
    """Where to go on after a read."""
    last = read.agg(F.max("lsn")).first()[0]
    return since if last is None else int(last)


def stream(spark: SparkSession, path: str, schema: StructType, masks: Mapping[str, Sequence[str]] | None = None, files_per_batch: int = 64) -> DataFrame:
    """The log under ``path`` as a stream of published changes."""
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return changes if masks is None else changes.where(published(masks))


def replicate(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's last change of each key to ``target``, whatever is there already; returns when all is read."""

    def apply(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replica(spark: SparkSession, target: str) -> DataFrame:
    """The state that a replica holds."""
    log = spark.read.parquet(target).drop("batch")
    return latest(log).where("kind <> 'delete'")
