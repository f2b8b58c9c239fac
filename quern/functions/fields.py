"""Dotted paths into typed rows and VARIANT documents, by class of value.

A field's class decides what may be compared with it: ``num``, ``str``, ``bool``, ``time``, ``doc``, ``array`` or, in a
VARIANT, ``variant``, where each row's own value decides. Classes of typed columns are known when the plan is made, so
a comparison across classes is a constant false and no cast can fail at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_VARIANT = "^(TINYINT|SMALLINT|INT|BIGINT)$"
NUMERIC_VARIANT = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


@dataclass(frozen=True)
class Field:
    """A path in a frame: its column, its class and its type. ``value``: of a variant, before typing."""

    path: str
    column: Column
    kind: str
    type: T.DataType

    def number(self) -> Column:
        """As a double where the value is a number, else null."""
        if self.kind == "num":
            return self.column.cast("double")
        if self.kind == "variant":
            return F.when(self.shape().rlike(NUMERIC_VARIANT), F.try_variant_get(self.column, "$", "double"))
        return F.lit(None).cast("double")

    def integer(self) -> Column:
        """Of a VARIANT: as a long where the value is an integer, else null."""
        return F.when(self.shape().rlike(INTEGER_VARIANT), F.try_variant_get(self.column, "$", "bigint"))

    def string(self) -> Column:
        """As a string where the value is a string, else null."""
        if self.kind == "str":
            return self.column
        if self.kind == "variant":
            return F.when(self.shape() == "STRING", F.try_variant_get(self.column, "$", "string"))
        return F.lit(None).cast("string")

    def boolean(self) -> Column:
        if self.kind == "bool":
            return self.column
        if self.kind == "variant":
            return F.when(self.shape() == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean"))
        return F.lit(None).cast("boolean")

    def shape(self) -> Column:
        return F.schema_of_variant(self.column)


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "str"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.VariantType):
        return "variant"
    return "array" if isinstance(t, T.ArrayType) else "doc"


def resolve(df: DataFrame, path: str) -> Field | None:
    """The field at a dotted path, or None if the schema has none. Inside a VARIANT every path may exist."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if path in fields:
        return Field(path, F.col(f"`{path}`"), kind_of(fields[path]), fields[path])
    head, *rest = path.split(".")
    if head not in fields:
        docs = [n for n, t in fields.items() if isinstance(t, T.VariantType)]
        if "doc" not in docs:
            return None
        head, rest = "doc", path.split(".")  # a store of keys and documents
    column, t = F.col(f"`{head}`"), fields[head]
    for i, part in enumerate(rest):
        if isinstance(t, T.VariantType):
            inner = "$" + "".join(f'["{p}"]' for p in rest[i:])
            return Field(path, F.try_variant_get(column, inner, "variant"), "variant", t)
        if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
            column, t = column[part], t.valueType
        elif isinstance(t, T.StructType) and part in t.names:
            column, t = column[part], t[part].dataType
        else:
            return None
    return Field(path, column, kind_of(t), t)
