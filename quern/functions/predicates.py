"""Predicates as columns: two-valued, and strict about classes.

A missing field, a null and a value of another class make every comparison false, ``ne`` too. Integers and doubles
compare as numbers; a bool never equals 0 or 1, nor a numeric string a number. ``regex`` is a literal with optional
anchors ``^`` and ``$``. Everything is built from comparisons that reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.functions.fields import NUMERIC_VARIANT, Field, resolve

COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
LONGEST_PATTERN = 256
EXACT = 1 << 53  # integers from here on are not all doubles


def false() -> Column:
    return F.lit(False)


def class_of(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "num"
    if isinstance(value, str):
        return "str"
    if isinstance(value, (dt.datetime, dt.date)):
        return "time"
    raise QueryError(f"not a literal: {value!r}")


def typed(field: Field, value: object) -> tuple[Column, Column] | None:
    """The field and the literal as columns of one class, or None if they can't compare."""
    kind = class_of(value)
    if field.kind == "time":
        if kind == "num" and isinstance(value, int):
            return field.column, F.timestamp_millis(F.lit(value)).cast(field.type)
        if kind in ("str", "time"):
            text = value if isinstance(value, str) else value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
            return field.column, F.lit(text).try_cast(field.type)
        return None
    if kind == "num" and isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        value = float(value)
    if kind == "num" and field.kind in ("num", "variant"):
        return (field.column if field.kind == "num" else field.number()), F.lit(value)
    if kind == "str" and field.kind in ("str", "variant"):
        return field.string(), F.lit(value)
    if kind == "bool" and field.kind in ("bool", "variant"):
        return field.boolean(), F.lit(value)
    return None


def compare(field: Field | None, op: str, value: object) -> Column:
    kind = class_of(value)
    pair = typed(field, value) if field else None
    if pair is None or (kind == "bool" and op not in ("eq", "ne")):
        return false()
    if field.kind == "variant":
        return of_variant(field, op, value)
    found = COMPARE[op](*pair)
    inexact = isinstance(field.type, (T.DoubleType, T.FloatType))
    if kind == "num" and inexact and op in ("gt", "gte"):
        found = found & ~F.isnan(pair[0])  # Spark puts NaN above all numbers
    return found


def of_variant(field: Field, op: str, value: object) -> Column:
    """A comparison within a VARIANT: the value first, and its class, which costs more, on what is left."""
    kind = class_of(value)
    if kind != "num":
        name = "string" if kind == "str" else "boolean"
        return COMPARE[op](F.try_variant_get(field.column, "$", name), F.lit(value)) & (field.shape() == name.upper())
    get = F.try_variant_get(field.column, "$", "double")
    if isinstance(value, int) and EXACT <= abs(value) < 1 << 63:
        return F.when(field.integer().isNotNull(), COMPARE[op](field.integer(), F.lit(value))).otherwise(COMPARE[op](field.number(), F.lit(float(value))) & ~F.isnan(get))
    found = COMPARE[op](get, F.lit(float(value))) & field.shape().rlike(NUMERIC_VARIANT)
    return found & ~F.isnan(get) if op in ("gt", "gte") else found


def matches(field: Field | None, pattern: str) -> Column:
    """A literal, anchored where it begins with ^ or ends with $."""
    if field is None or field.kind not in ("str", "variant") or len(pattern) > LONGEST_PATTERN:
        return false()
    text, start, end = field.string(), pattern.startswith("^"), pattern.endswith("$") and pattern != "^"
    literal = pattern[int(start) : len(pattern) - int(end)]
    if start and end:
        return text == literal
    if not literal:
        return text.isNotNull()
    return text.startswith(literal) if start else text.endswith(literal) if end else text.contains(literal)


def one_of(field: Field | None, values: Iterable[object]) -> Column:
    by_class: dict[str, list] = {}
    for v in values:
        by_class.setdefault(class_of(v), []).append(v)
    found = []
    for kind, own in by_class.items():
        if field and field.kind == "variant" and any(kind == "num" and abs(v) >= EXACT for v in own):
            found += [compare(field, "eq", v) for v in own]
            continue
        pairs = [p for v in own if field and (p := typed(field, v))]
        if pairs and kind != "time" and field.kind != "time":
            found.append(pairs[0][0].isin(*own))
        else:
            found += [a == b for a, b in pairs]
    return reduce(operator.or_, found) if found else false()


def predicate(df: DataFrame, path: str, op: str, value: object) -> Column:
    """One predicate on a field of ``df``."""
    field = resolve(df, path)
    if op in COMPARE:
        return compare(field, op, value)
    if op == "in":
        return one_of(field, value)
    if op == "between":
        if len(bounds := list(value)) != 2:
            raise QueryError("between takes two bounds")
        return compare(field, "gte", bounds[0]) & compare(field, "lte", bounds[1])
    if op == "exists":
        present = field.column.isNotNull() if field else false()
        return ~present if value is False else present
    if op in ("contains", "startsWith"):
        if field is None or field.kind not in ("str", "variant") or not isinstance(value, str):
            return false()
        return field.string().contains(value) if op == "contains" else field.string().startswith(value)
    if op == "regex":
        return matches(field, value)
    raise QueryError(f"unknown operator: {op}")


def conjunction(parts: Iterable[Column]) -> Column:
    return reduce(operator.and_, parts, F.lit(True))


def from_spec(df: DataFrame, spec: dict) -> Column:
    """A filter given as a dict: ``{"age": {"$gte": 18}, "$or": [{..}, {..}]}``. What it doesn't know is an error."""
    if not isinstance(spec, dict):
        raise QueryError("a filter is an object")
    parts = []
    for name, wanted in spec.items():
        if name == "$or":
            if not isinstance(wanted, list) or not wanted:
                raise QueryError("$or takes a list of filters")
            groups = [g if isinstance(g, dict) and "$or" not in g else None for g in wanted]
            if None in groups:
                raise QueryError("a group of $or is a filter without $or")
            same = {n for g in groups for n in g}
            values = [g.get(n) for g in groups for n in g]
            if len(spec) == 1 and len(same) == 1 and all(len(g) == 1 for g in groups) and not any(isinstance(v, (dict, list)) or v is None for v in values):
                parts.append(predicate(df, same.pop(), "in", values))
            else:
                parts.append(reduce(operator.or_, (from_spec(df, g) for g in groups)))
        elif name.startswith("$"):
            raise QueryError(f"unknown operator: {name}")
        elif isinstance(wanted, dict):
            if not wanted or not all(k.startswith("$") for k in wanted):
                raise QueryError(f"no operator for {name}")
            parts += [predicate(df, name, k[1:], v) for k, v in wanted.items()]
        else:
            parts.append(predicate(df, name, "eq", wanted))
    return conjunction(parts)
