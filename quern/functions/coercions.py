"""Coercions of values read from files, and of strings inside aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.fields import Field

# The types a manifest may give a field.
TYPES = {"string": "string", "int": "bigint", "double": "double", "bool": "boolean", "datetime": "timestamp", "objectid": "string"}


def parsed(text: Column) -> Column:
    """A string that is a number and nothing else as a double; NaN and strings with outer white space are null."""
    number = F.when(~text.rlike(r"^\s|\s$"), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def numeric(field: Field | None) -> Column:
    """What aggregates see: numbers, and strings that are numbers; anything else null."""
    if field is None or field.kind in ("bool", "time", "doc", "array"):
        return F.lit(None).cast("double")
    if field.kind == "num":
        return field.number()
    return parsed(field.string()) if field.kind == "str" else F.coalesce(field.number(), parsed(field.string()))


def from_csv(cell: Column, kind: str) -> Column:
    """A CSV cell as a manifest's type: empty is null, as is what doesn't parse (``rescued`` keeps it)."""
    cell = F.when(cell != "", cell)
    if kind == "bool":
        return F.when(cell.isNotNull(), cell.isin("true", "1"))
    if kind == "datetime":
        return F.timestamp_millis(cell.try_cast("bigint"))
    if kind == "objectid":
        return F.when(cell.rlike("^[0-9a-fA-F]{24}$"), cell)
    return cell if kind == "string" else cell.try_cast(TYPES[kind])


def from_csv_variant(cell: Column, kind: str) -> Column:
    """A CSV cell for a VARIANT document: as the type, and as the string it is where it doesn't parse."""
    cell = F.when(cell != "", cell)
    value = from_csv(cell, kind)
    return F.coalesce(F.when(value.isNotNull(), value.cast("variant")), cell.cast("variant"))


def rescued(cell: Column, kind: str) -> Column:
    """The cell where ``from_csv`` can't keep it."""
    return F.when((cell != "") & from_csv(cell, kind).isNull(), cell)


def from_json(value: Column, kind: str) -> Column:
    """A JSON string as a manifest's type; a datetime is ISO 8601 and becomes epoch milliseconds."""
    if kind == "bool":
        return F.when(value.isNotNull(), value.isin("true", "1", "yes"))
    if kind == "datetime":
        return F.unix_millis(F.try_to_timestamp(value))
    return value if kind in ("string", "objectid") else value.try_cast(TYPES[kind])


def coerced(value: Column, kind: T.DataType, fields: Mapping[str, str], name: str | None = None) -> Column:
    """A JSON value with the declared fields coerced at every depth, by name; an array's elements have no name of their own."""
    wanted = fields.get(name)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(coerced(value[f.name], f.dataType, fields, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: coerced(x, kind.elementType, fields))
    if wanted and isinstance(kind, T.StringType):
        return from_json(value, wanted)
    return number_as(value, wanted) if wanted and isinstance(kind, T.NumericType) else value


def number_as(value: Column, kind: str) -> Column:
    """A JSON number as a manifest's type: bool is nonzero, int narrows, double widens."""
    if kind == "bool":
        return value != 0
    return value.try_cast({"int": "int", "double": "double"}[kind]) if kind in ("int", "double") else value
