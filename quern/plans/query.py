"""Queries over one store: filter, sort, offset, limit, projection, counts and aggregates as one lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.functions.fields import resolve
from quern.functions.predicates import conjunction, from_spec, predicate
from quern.operators.aggregate import aggregate

KEY, KEY_OF = "key", "key_of"
# The entries of a JSON query, the first of each line that is there counts.
ENTRIES = (("filter",), ("sort", "orderBy"), ("limit",), ("offset", "skip"), ("after",), ("select", "$select", "pluck", "$pluck", "projection"), ("aggregate",), ("group_by", "groupBy"), ("count",))


def hex_key(column: Column) -> Column:
    """A number as a key: 32 lower-case hex digits, whose order as strings is that of the numbers."""
    return F.lpad(F.lower(F.hex(column)), 32, "0")


def keyed(df: DataFrame, number: str) -> DataFrame:
    """The table as a store whose key is one of its numbers, first. Reads by key then also bound that number, which scans can skip by."""
    return df.select(hex_key(F.col(number)).alias(KEY, metadata={KEY_OF: number}), "*")


def by_key(store: DataFrame, first: str | None = None, last: str | None = None, beyond: bool = False) -> DataFrame:
    """Documents of the keys from ``first`` (or beyond it) to ``last``, both in full; the bounds of a numeric key reach the scan."""
    key = F.col(KEY)
    if first is not None:
        store = store.where(key > first if beyond else key == first if last == first else key >= first)
    if last is not None and last != first:
        store = store.where(key <= last)
    number = store.schema[KEY].metadata.get(KEY_OF)
    if number not in store.columns or int(first or "0", 16) >= 1 << 63:
        return store
    low, column = int(first or "0", 16), F.col(f"`{number}`")  # as keys, negative numbers come after all others
    if last is None:
        return store.where((column >= low) | (column < 0))
    return store.where(column.between(low, int(last, 16))) if int(last, 16) < 1 << 63 else store


def key_text(key: str) -> str:
    """A key as given, with or without 0x and leading zeros, in full."""
    digits = key.lower().removeprefix("0x")
    if not digits or len(digits) > 32 or set(digits) - set("0123456789abcdef"):
        raise QueryError(f"not a key: {key!r}")
    return digits.zfill(32)


def spec_of(spec: Mapping | str) -> dict:
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except json.JSONDecodeError as e:
            raise QueryError(f"not JSON: {e}") from None
    if not isinstance(spec, Mapping):
        raise QueryError("an object is needed")
    return dict(spec)


def names_in(value: object) -> list[str]:
    if not isinstance(value, list) or not value or not all(isinstance(v, str) for v in value):
        raise QueryError(f"not a list of fields: {value!r}")
    return value


def sort_entries(value: object, numbers: bool) -> list[tuple[str, bool]]:
    """(field, whether descending) of ``{"a": 1, "b": -1}``, or of fields with directions, of which only ``desc`` descends."""
    if value is None:
        return []
    if numbers:
        if not isinstance(value, dict):
            raise QueryError("sort is an object")
        return [(k, isinstance(v, int) and v < 0) for k, v in value.items()]
    entries = value if isinstance(value, list) else [value]
    if not all(isinstance(e, dict) and isinstance(e.get("field"), str) for e in entries):
        raise QueryError("orderBy is a field with a direction, or a list of these")
    return [(e["field"], e.get("direction") == "desc") for e in entries]


def aggregate_entries(value: object) -> tuple[tuple[str, str, str | None], ...]:
    """(alias, function, field) of ``{"total": {"$sum": "a"}, "n": {"$count": true}}``."""
    if not isinstance(value, dict) or not value:
        raise QueryError("aggregate is an object of aggregates")
    out = []
    for alias, spec in value.items():
        if not isinstance(spec, dict) or len(spec) != 1 or not next(iter(spec)).startswith("$"):
            raise QueryError(f"{alias} is one function of a field")
        (function, path), = spec.items()
        out.append((alias, function[1:], path if isinstance(path, str) else None))
    return tuple(out)


@dataclass(frozen=True)
class Query:
    """Immutable; every step returns a new query. ``frame()`` gives the plan, and nothing runs before that is read."""

    source: DataFrame
    groups: tuple[tuple[tuple[str, str, object], ...], ...] = ((),)
    extra: Column | None = None
    sorts: tuple[tuple[str, bool], ...] = ()
    n_skip: int = 0
    n_limit: int | None = None
    cursor: str | None = None
    fields: tuple[str, ...] | None = None
    by: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, str, str | None], ...] = field(default=())
    counts: bool = False
    indexed: frozenset[str] | None = None

    @staticmethod
    def of(source: DataFrame, spec: Mapping | str, indexed: frozenset[str] | None = None) -> Query:
        """A query given as one JSON document. What it doesn't know, or of another form, is an error.

        ``{"filter": {..}, "sort": {"a": -1}, "limit": 10, "offset": 5, "after": key, "select": ["a.b"],
        "aggregate": {"total": {"$sum": "a"}}, "group_by": ["b"], "count": true}``; for ``sort`` also ``"orderBy":
        {"field": "a", "direction": "desc"}`` or a list of these. ``result()`` gives what is asked for.
        """
        given = spec_of(spec)
        if unknown := set(given) - {n for names in ENTRIES for n in names}:
            raise QueryError(f"unknown entries: {sorted(unknown)}")
        filters, sorts, limit, skip, after, fields, aggregates, by, counts = (next((given[n] for n in names if n in given), None) for names in ENTRIES)
        q = Query(source, indexed=indexed)
        if filters is not None:
            q = q.matching(filters)
        for path, down in sort_entries(sorts, "sort" in given):
            q = q.order_by(path, "desc" if down else "asc")
        for n in (limit, skip):
            if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
                raise QueryError(f"not a number of documents: {n!r}")
        q = replace(q, n_limit=limit, n_skip=skip or 0)
        if after is not None:
            q = q.after(after if isinstance(after, str) else "")
        if fields is not None:
            q = q.pluck(*names_in(fields))
        if by is not None:
            q = q.group_by(*names_in(by))
        if aggregates is not None:
            q = replace(q, aggregates=aggregate_entries(aggregates))
        if counts not in (None, True, False):
            raise QueryError("count is true or false")
        return replace(q, counts=bool(counts))

    def result(self) -> DataFrame:
        """The count if one is asked for, else ``frame()``."""
        return self.count() if self.counts else self.frame()

    def where(self, path: str, op: str, value: object = True) -> Query:
        return replace(self, groups=(*self.groups[:-1], (*self.groups[-1], (path, op, value))))

    def or_(self, path: str, op: str, value: object = True) -> Query:
        """Begins a further group of predicates; and binds tighter."""
        return replace(self, groups=(*self.groups, ((path, op, value),)))

    def matching(self, spec: Mapping | str) -> Query:
        """Adds a filter given as a dict or as JSON text."""
        found = from_spec(self.source, spec_of(spec))
        return replace(self, extra=found if self.extra is None else self.extra & found)

    def order_by(self, path: str, direction: str = "asc") -> Query:
        if direction not in ("asc", "desc"):
            raise QueryError(f"no direction: {direction}")
        if self.indexed is not None and path not in self.indexed:
            raise QueryError(f"no index on {path}")
        return replace(self, sorts=(*self.sorts, (path, direction == "desc")))

    def skip(self, n: int) -> Query:
        return replace(self, n_skip=n)

    def limit(self, n: int) -> Query:
        return replace(self, n_limit=n)

    def after(self, key: str) -> Query:
        """Keys beyond ``key``, in key order unless sorted otherwise."""
        return replace(self, cursor=key_text(key))

    def pluck(self, *paths: str) -> Query:
        return replace(self, fields=paths)

    def group_by(self, *paths: str) -> Query:
        return replace(self, by=(*self.by, *paths))

    def aggregate(self, **named: str | tuple[str, str]) -> Query:
        """``total=("sum", "price"), n="count"``."""
        found = tuple((a, f, None) if isinstance(f, str) else (a, *f) for a, f in named.items())
        return replace(self, aggregates=(*self.aggregates, *found))

    def condition(self) -> Column:
        groups = [conjunction(predicate(self.source, *p) for p in g) for g in self.groups if g]
        if len(groups) > 1 and all(len(g) == 1 and g[0][1] == "eq" for g in self.groups) and len({g[0][0] for g in self.groups}) == 1:
            groups = [predicate(self.source, self.groups[0][0][0], "in", [g[0][2] for g in self.groups])]
        found = groups[0] if groups else F.lit(True)
        for g in groups[1:]:
            found = found | g
        return found if self.extra is None else found & self.extra

    def matches(self) -> DataFrame:
        df = self.source
        if any(self.groups) or self.extra is not None:
            df = df.where(self.condition())
        return df if self.cursor is None else by_key(df, self.cursor, beyond=True)

    def order(self) -> list[Column]:
        """Missing values come last in either direction; the key breaks ties, in the direction of the last sort."""
        columns = []
        for path, down in self.sorts:
            f = resolve(self.source, path)
            parts = [] if f is None else [f.number(), f.string(), f.boolean()] if f.kind == "variant" else [f.column]
            columns += [c.desc_nulls_last() if down else c.asc_nulls_last() for c in parts]
        if KEY in self.source.columns and (self.sorts or self.cursor is not None or self.n_skip or self.n_limit is not None):
            down = bool(self.sorts) and self.sorts[-1][1]
            columns.append(F.col(KEY).desc() if down else F.col(KEY).asc())
        return columns

    def frame(self) -> DataFrame:
        if self.aggregates or self.by:
            out = aggregate(self.matches(), self.by, self.aggregates)
            for path, _ in self.sorts:
                if path not in out.columns:
                    raise QueryError(f"groups have no {path}")
            return out.orderBy(*(F.col(f"`{p}`").desc_nulls_last() if d else F.col(f"`{p}`").asc_nulls_last() for p, d in self.sorts)) if self.sorts else out
        df = self.matches()
        if order := self.order():
            df = df.orderBy(*order)
        df = df.offset(self.n_skip) if self.n_skip else df
        df = df if self.n_limit is None else df.limit(self.n_limit)
        if self.fields is None:
            return df
        found = [(p, resolve(self.source, p)) for p in dict.fromkeys(self.fields)]
        lead = [F.col(KEY)] if KEY in self.source.columns and KEY not in self.fields else []
        return df.select(*lead, *((f.column if f else F.lit(None).cast("string")).alias(p) for p, f in found))

    def count(self) -> DataFrame:
        """One row: how many documents the query returns, offset and limit included."""
        n = F.greatest(F.count(F.lit(1)) - self.n_skip, F.lit(0))
        return self.matches().agg((n if self.n_limit is None else F.least(n, F.lit(self.n_limit))).cast("long").alias("count"))


def get(store: DataFrame, key: str) -> DataFrame:
    return by_key(store, key_text(key), key_text(key))


def key_range(store: DataFrame, first: str, last: str, limit: int = 100) -> DataFrame:
    """Keys from first to last, both included, in order, ``limit`` at most."""
    return by_key(store, key_text(first), key_text(last)).orderBy(KEY).limit(limit)


def scan(store: DataFrame, start: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Documents in key order from ``start`` on."""
    df = (store if start is None else by_key(store, key_text(start))).orderBy(KEY).offset(skip)
    return df if limit is None else df.limit(limit)


def as_documents(store: DataFrame) -> DataFrame:
    """(key, doc VARIANT) of a typed store, nulls left out; a store of documents as it is."""
    if set(store.columns) == {KEY, "doc"} and isinstance(store.schema["doc"].dataType, T.VariantType):
        return store.select(KEY, "doc")
    return store.select(KEY, F.parse_json(F.to_json(F.struct(*(F.col(f"`{c}`") for c in store.columns if c != KEY)))).alias("doc"))


def scan_stores(stores: Mapping[str, DataFrame], start: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(store, key, doc) of all stores in key order from ``start`` on."""
    found = [as_documents(df if start is None else by_key(df, key_text(start))).select(F.lit(name).alias("store"), KEY, "doc") for name, df in sorted(stores.items())]
    if not found:
        raise QueryError("no stores")
    df = reduce(DataFrame.unionByName, found).orderBy(KEY, "store").offset(skip)
    return df if limit is None else df.limit(limit)
