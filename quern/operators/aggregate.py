"""Grouped aggregates: counts of documents, and sums, averages, minima and maxima of what is a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions.coercions import numeric
from quern.functions.fields import resolve

OVER = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate_of(df: DataFrame, function: str, path: str | None) -> Column:
    """``count`` counts documents whatever the field; the others give 0.0 where nothing is a number."""
    if function == "count":
        return F.count(F.lit(1))
    if function not in OVER:
        raise QueryError(f"unknown aggregate: {function}")
    if path is None:
        raise QueryError(f"{function} takes a field")
    return F.coalesce(OVER[function](numeric(resolve(df, path))), F.lit(0.0))


def group_key(df: DataFrame, path: str) -> Column:
    """The value to group by; in a VARIANT its rendering as text. A missing field, an array or a document there is the group null."""
    field = resolve(df, path)
    if field is None:
        return F.lit(None).cast("string")
    return F.when(~field.shape().rlike("^(ARRAY|OBJECT)"), F.try_variant_get(field.column, "$", "string")) if field.kind == "variant" else field.column


def aggregate(df: DataFrame, by: Sequence[str], aggregates: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """One row a group: the keys under their paths, then each (alias, function, field). No rows, no groups."""
    names = [*by, *(a for a, _, _ in aggregates)]
    if len(set(names)) < len(names):
        raise QueryError(f"a name is used twice: {names}")
    if not aggregates:
        raise QueryError("nothing to aggregate")
    columns = [aggregate_of(df, f, p).alias(a) for a, f, p in aggregates]
    if by:
        return df.groupBy(*(group_key(df, p).alias(p) for p in by)).agg(*columns)
    counted = df.agg(*columns, F.count(F.lit(1)).alias("__rows"))
    return counted.where("__rows > 0").drop("__rows")


def as_document(groups: DataFrame, by: Sequence[str], aliases: Sequence[str]) -> DataFrame:
    """Groups as (key, values) structs."""
    key = F.struct(*(F.col(f"`{p}`").alias(p) for p in by)) if by else F.lit(None)
    return groups.select(key.alias("key"), F.struct(*aliases).alias("values"))
