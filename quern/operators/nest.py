"""Flat tables into nested documents, and back.

``embed`` groups children by their join key and puts them into their parent as an array, leaves first; a parent
without children gets no array (null). It is a left outer join after a grouping, and Spark may broadcast a side only
by its own size checks. Arrays are sorted by all their fields, so results don't depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ManifestError
from quern.sources.manifest import Entity, Manifest


def embed(parent: DataFrame, child: DataFrame, join_key: str, name: str, keep_key: bool = True) -> DataFrame:
    """``parent`` with an array column ``name`` of the children of the same ``join_key``."""
    fields = [c for c in child.columns if keep_key or c != join_key]
    grouped = child.where(F.col(join_key).isNotNull()).groupBy(F.col(join_key).alias("__of")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(grouped, parent[join_key] == F.col("__of"), "left").drop("__of")


def embed_all(tables: Mapping[str, DataFrame], manifest: Manifest) -> DataFrame:
    """The root's documents with all descendants, one embedding a child entity, leaves first."""

    def build(entity: Entity) -> DataFrame:
        out = tables[entity.name]
        for child in manifest.children(entity):
            if child.join_key not in out.columns:
                raise ManifestError(f"{entity.name} has no {child.join_key}")
            out = embed(out, build(child), child.join_key, child.embed_as)
        return out

    return build(manifest.root())


def flatten(parent: DataFrame, name: str, key: str, ids: tuple[str, ...] = ()) -> DataFrame:
    """The children under ``name``, one a row: _parent_id, the parent's ids, then their fields."""
    kind = parent.schema[name].dataType
    child = F.explode(name) if isinstance(kind, T.ArrayType) else F.col(name)
    rows = parent.where(F.col(name).isNotNull()).select(F.col(key).alias("_parent_id"), *(F.col(i).alias(i) for i in ids), child.alias("__child"))
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return rows.select("_parent_id", *ids, *(F.col(f"__child.`{f}`").alias(f) for f in inner.names if f not in ids))


def split(documents: DataFrame, key: str = "key") -> dict[str, DataFrame]:
    """A table of scalars, under "", and one for each field that holds documents or an array of them."""
    nested = [f.name for f in documents.schema.fields if isinstance(f.dataType, T.StructType) or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType))]
    scalars = [c for c in documents.columns if c not in nested]
    ids = tuple(c for c in scalars if c != key and (c == "id" or c.endswith("_id")))
    return {"": documents.select(*scalars)} | {n: flatten(documents, n, key, ids) for n in nested}
