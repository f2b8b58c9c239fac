"""Mutations as rows of a change log, and the state that a log describes.

A log has (lsn long, key string, store string, kind string, ts long) and the document: ``kind`` is insert, update or
delete. A key's state is its change of the largest lsn; a delete hides it. So a delete of an absent key, and a row that
arrives twice, change nothing. The largest change is found by ``max_by`` with partial aggregation: a key that changes
all the time sends one row a task.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.functions.fields import resolve
from quern.sources.shared import written

DML = ("insert", "update", "delete")
KEY_DIGITS = {"store": 4, "kind": 2, "log": 2, "time": 24}


def latest(log: DataFrame, key: str = "key", lsn: str = "lsn") -> DataFrame:
    """The last change of each key, deletes included."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(lsn)).alias("__last"))
    return newest.select(key, *(F.col("__last")[c].alias(c) for c in rest))


def state(log: DataFrame, key: str = "key", lsn: str = "lsn", kind: str = "kind") -> DataFrame:
    """Last write wins: the documents that are there."""
    return latest(log, key, lsn).where(F.col(kind) != "delete")


def compacted(log: DataFrame) -> DataFrame:
    """A log of the same state without dead versions."""
    return state(log)


def merged(doc: Column, values: Mapping[str, object]) -> Column:
    """A VARIANT document with ``values`` in place of its top-level fields of these names; what is no document stays."""
    old = F.try_variant_get(doc, "$", "map<string,variant>")
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.parse_json(F.lit(json.dumps(v))))))
    kept = F.map_filter(old, lambda k, _: ~k.isin(*values))
    return F.when(old.isNotNull(), F.to_variant_object(F.map_concat(kept, new))).otherwise(doc)


def updated(store: DataFrame, match: Column, values: Mapping[str, object]) -> DataFrame:
    """The store after ``values`` are set in the matching documents, as a top-level merge.

    In a store of keys and VARIANT documents the fields are those of ``doc``.
    """
    hit = F.coalesce(match, F.lit(False))
    if not values:
        return store
    if "doc" in store.columns and isinstance(store.schema["doc"].dataType, T.VariantType) and not set(values) & set(store.columns):
        if any("." in name for name in values):
            raise QueryError(f"set takes top-level fields: {sorted(values)}")
        return store.withColumn("doc", F.when(hit, merged(F.col("doc"), values)).otherwise(F.col("doc")))
    out = store
    for name, value in values.items():
        if "." in name:
            raise QueryError(f"set takes top-level fields: {name}")
        known = resolve(store, name)
        new = F.lit(value).cast(known.type) if known else F.lit(value)
        out = out.withColumn(name, F.when(hit, new).otherwise(F.col(f"`{name}`") if known else F.lit(None)))
    return out


def deleted(store: DataFrame, match: Column) -> DataFrame:
    """The store without the matching documents; a predicate that is null doesn't match."""
    return store.where(~F.coalesce(match, F.lit(False)))


def changes(rows: DataFrame, store: str, kind: str, first_lsn: int, ts: int, key: str = "key") -> DataFrame:
    """Log rows for documents that carry a key. lsn: consecutive, in key order.

    Numbers come from the row counts of a range sort's partitions, so no task sees all rows.
    """
    if kind not in DML:
        raise QueryError(f"unknown change: {kind}")
    return numbered(rows, key, first_lsn).select(F.col("__n").alias("lsn"), key, F.lit(store).alias("store"), F.lit(kind).alias("kind"), F.lit(ts).cast("long").alias("ts"), *(c for c in rows.columns if c != key))


def numbered(rows: DataFrame, by: str | None, first: int) -> DataFrame:
    """Adds __n: consecutive numbers in the order of ``by`` (None: any), equal values in any order. ``rows`` is written once."""
    low = F.lit((1 << 33) - 1)
    ordered = rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows
    placed = written(ordered.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    start, total = {}, first
    for part, n in sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect()):  # a number for each partition
        start[part] = total
        total += n
    offsets = F.create_map(*(F.lit(x) for p, s in start.items() for x in (p, s))) if start else F.create_map().cast("map<bigint,bigint>")
    return placed.withColumn("__n", (offsets[F.col("__part")] + F.col("__id").bitwiseAND(low)).cast("long")).drop("__id", "__part")


def inserted(rows: DataFrame, store: str, store_id: int, first_lsn: int, ts: int) -> DataFrame:
    """Log rows that insert ``rows``, each under a new key: the batch's time in nanoseconds and a counter."""
    made = numbered(rows, None, first_lsn)
    key = new_key(store_id, 4, 0, F.lit(ts * 1_000_000) + F.col("__n") - first_lsn)
    return made.select(F.col("__n").alias("lsn"), key.alias("key"), F.lit(store).alias("store"), F.lit("insert").alias("kind"), F.lit(ts).cast("long").alias("ts"), *rows.columns)


def next_lsn(log: DataFrame) -> int:
    return (log.agg(F.max("lsn")).first()[0] or 0) + 1


def replaced(log: DataFrame, key: str, document: DataFrame, store: str, ts: int) -> DataFrame:
    """The log row of an update by key: the one row of ``document`` in place of what the key holds; no row if the key holds nothing."""
    there = state(log.where(F.col("key") == key)).select(F.col("key").alias("__key"))
    row = document.limit(1).drop("key").withColumn("key", F.lit(key))
    kept = row.join(there, F.col("key") == F.col("__key"), "left_semi")
    return kept.select(F.lit(next_lsn(log)).cast("long").alias("lsn"), "key", F.lit(store).alias("store"), F.lit("update").alias("kind"), F.lit(ts).cast("long").alias("ts"), *(c for c in document.columns if c != "key"))


def new_key(store_id: int, doc_type: int, log_id: int, moment: Column) -> Column:
    """A key of its parts: it sorts by store, then by time. ``moment``: nanoseconds, a counter added."""
    parts = ((store_id, "store"), (doc_type, "kind"), (log_id, "log"))
    lead = "".join(f"{v:0{KEY_DIGITS[n]}x}" for v, n in parts)
    return F.concat(F.lit(lead), F.lpad(F.lower(F.hex(moment)), KEY_DIGITS["time"], "0"))
