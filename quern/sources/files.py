"""Stores as CSV, JSON and BSON files. Reading and writing are Spark's own, so any file system works and nothing is local."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ManifestError
from quern.functions.coercions import coerced, from_csv, rescued
from quern.functions.fields import resolve
from quern.operators.nest import embed_all, split
from quern.plans.query import KEY, Query
from quern.sources import bson
from quern.sources.manifest import Entity, Manifest, expand

CSV = {"header": "true", "quote": '"', "escape": '"'}
ID, PARENT_ID = "_id", "_parent_id"
# The manifest's type of a column.
KINDS = {T.BooleanType: "bool", T.FloatType: "double", T.DoubleType: "double", T.DecimalType: "double", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int"}


def read_csv(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]] = (), rescue: bool = False, multiline: bool = False) -> DataFrame:
    """RFC 4180 files with a header, by column name; undeclared columns are strings. ``rescue``: keep what doesn't parse.

    Cells that hold line feeds need ``multiline``, which makes each file one task; without it files are split.
    """
    raw = spark.read.options(**CSV, nullValue="\0", emptyValue="").option("inferSchema", "false").option("multiLine", multiline).csv(path)
    return typed(raw, fields, rescue)


def typed(raw: DataFrame, fields: Sequence[tuple[str, str]], rescue: bool = False) -> DataFrame:
    """Cells by type. An empty cell is null; a quoted empty one is an empty string, and null for any other type."""
    kinds = dict(fields)
    out = [(F.col(f"`{c}`") if kinds.get(c, "string") == "string" else from_csv(F.col(f"`{c}`"), kinds[c])).alias(c) for c in raw.columns]
    out += [F.lit(None).cast("string").alias(c) for c in kinds if c not in raw.columns]
    if rescue:
        bad = F.struct(*(rescued(F.col(f"`{c}`"), kinds.get(c, "string")).alias(c) for c in raw.columns))
        out.append(F.nullif(F.to_json(bad), F.lit("{}")).alias("_rescued"))
    return raw.select(*out)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested values as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.select(*((F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    """A null becomes an empty cell, an empty string a quoted one."""
    csv_ready(df).write.options(header="true", quote='"', escape='"', nullValue="", emptyValue='""').csv(path)


def export_csv(query: Query, path: str, key: str = KEY, store: str = "documents") -> Manifest:
    """The query's documents as CSV folders: scalars with ``_id``, and one for each nested field with ``_parent_id``.

    Returns the manifest, which is also written to ``manifest`` as JSON text; ``import_csv`` reads the folders by it.
    """
    parts = split(query.frame(), key)
    entities = []
    for name, df in parts.items():
        out = df.withColumnRenamed(key, ID) if not name else df
        write_csv(out, f"{path}/{name or store}")
        fields = tuple((f.name, KINDS.get(type(f.dataType), "string")) for f in out.schema.fields)
        entities.append(Entity(name, "child", None, store, name, PARENT_ID, fields) if name else Entity(store, fields=fields))
    manifest = Manifest(store, "csv", path, None, tuple(entities))
    spark = query.source.sparkSession
    spark.createDataFrame([(json.dumps(manifest.mapping()),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def declared(df: DataFrame, path: str) -> Column:
    """A declared field as text, or null where there is none."""
    found = resolve(df, path)
    return (found.column if found else F.lit(None).cast("string")).alias(path)


def export_by_manifest(store: DataFrame, manifest: Manifest, now_ms: int = 0) -> list[str]:
    """The store's documents as the manifest says, under its output_dir; returns the paths written.

    ``query`` filters, as JSON text whose variables are dates. CSV: the root with ``_id`` and its declared fields, and each
    of its children with ``_parent_id``, the join key and its declared fields, one row for each document that the field
    holds. JSON and BSON: whole documents, as the root.
    """
    if not manifest.output_dir:
        raise ManifestError("no output_dir")
    query = Query.of(store, expand(manifest.query, now_ms) if manifest.query else {})
    roots = [e for e in manifest.entities if e.role == "parent"]
    place = lambda e, name: f"{manifest.output_dir}/{(e and (e.file or e.name)) or name}"
    if manifest.format != "csv" or not manifest.entities:
        path = place(roots[0] if roots else None, f"export.{manifest.format}")
        if manifest.format == "csv":
            export_csv(query, path, store=manifest.store)
        elif manifest.format == "json":
            export_json(query, path)
        else:
            bson.write_bson(query.frame(), path)
        return [path]
    root, found = manifest.root(), query.frame()
    paths = [place(root, "")]
    write_csv(found.select(F.col(KEY).alias(ID), *(declared(found, n) for n, _ in root.fields)), paths[0])
    for child in manifest.children(root):
        field = resolve(found, child.parent_field or child.name)
        if field is None or field.kind not in ("array", "doc"):
            continue
        inside = F.explode(field.column) if field.kind == "array" else field.column
        rows = found.where(field.column.isNotNull()).select(F.col(KEY).alias(PARENT_ID), declared(found, child.join_key), inside.alias("__child"))
        names = [n for n, _ in child.fields if n != child.join_key]
        held = [f.name for f in rows.schema["__child"].dataType.fields]
        cells = [(F.col(f"__child.`{n}`") if n in held else F.lit(None).cast("string")).alias(n) for n in names]
        paths.append(place(child, ""))
        write_csv(rows.where("__child IS NOT NULL").select(PARENT_ID, F.col(f"`{child.join_key}`"), *cells), paths[-1])
    return paths


def import_csv(spark: SparkSession, folder: str, manifest: Manifest, multiline: bool = False) -> DataFrame:
    """Documents nested as the manifest says. A child joined by ``_parent_id`` finds its parent's ``_id``."""
    tables = {e.name: read_csv(spark, f"{folder}/{e.file or e.name}", e.fields, multiline=multiline) for e in manifest.entities}
    linked = {e.parent or manifest.root().name for e in manifest.entities if e.role == "child" and e.join_key == PARENT_ID}
    tables = {n: df.withColumn(PARENT_ID, F.col(ID)) if n in linked and ID in df.columns else df for n, df in tables.items()}
    return embed_all(tables, manifest).drop(*(PARENT_ID for n in linked if n == manifest.root().name))


def export_json(query: Query, path: str) -> None:
    """One object a line, null fields left out."""
    query.frame().write.json(path)


def json_array(query: Query) -> DataFrame:
    """One JSON array of all documents of a small result, for readers that need one: it is built in one task."""
    docs = query.frame()
    text = docs.select(F.to_json(F.struct(*(c for c in docs.columns if c != KEY))).alias("d"))
    return text.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("d")), ",\n"), F.lit("\n]")).alias("json"))


def import_json(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]] = (), array: bool = False) -> DataFrame:
    """Objects, one a line, or with ``array`` in a top-level array; declared fields are coerced at every depth, others skipped."""
    df = spark.read.json(path, multiLine=array, mode="DROPMALFORMED")
    return df.select(*(coerced(F.col(f"`{f.name}`"), f.dataType, dict(fields), f.name).alias(f.name) for f in df.schema.fields))
