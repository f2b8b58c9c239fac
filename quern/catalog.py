"""Stores by name, index metadata and sequences: small records of the driver, kept in one JSON text, and with a path in files."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from quern.errors import QueryError
from quern.plans.query import Query, scan_stores

INDEX_TYPES = ("String", "U32", "U64", "I32", "I64", "F32", "F64", "Boolean")


@dataclass
class Catalog:
    """``loaders`` make a store's DataFrame when it is asked for. Names may hold dots; ``sys`` is reserved."""

    spark: SparkSession
    loaders: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, int] = field(default_factory=dict)
    path: str | None = None
    version: int = 0
    _lock: Lock = field(default_factory=Lock, repr=False)

    def create(self, name: str, load: Callable[[], DataFrame]) -> bool:
        """False if the store is there already, which then stays."""
        if name == "sys" or name.startswith("sys."):
            raise QueryError(f"reserved: {name}")
        if name in self.loaders:
            return False
        self.loaders[name] = load
        return True

    def drop(self, name: str) -> bool:
        """Takes its indexes along."""
        self.indexes = {k: v for k, v in self.indexes.items() if not k.startswith(f"{name}.") or any(k.startswith(f"{s}.") for s in self.loaders if s.startswith(f"{name}."))}
        found = self.loaders.pop(name, None) is not None
        self.save()
        return found

    def table(self, name: str) -> DataFrame:
        if name not in self.loaders:
            raise QueryError(f"no store {name}")
        return self.loaders[name]()

    def query(self, name: str, spec: Mapping | str | None = None, strict_index: bool = False) -> Query:
        """A query of the store, from a JSON document if one is given. ``strict_index``: sorting by a field without an index is an error."""
        return Query.of(self.table(name), spec or {}, self.indexed(name) if strict_index else None)

    def scan(self, start: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        """(store, key, doc) of all stores in key order."""
        return scan_stores({n: self.table(n) for n in self.loaders}, start, skip, limit)

    def create_index(self, name: str, kind: str) -> bool:
        """Metadata only: Parquet statistics do the work. ``store.field``."""
        if kind not in INDEX_TYPES:
            raise QueryError(f"unknown index type: {kind}")
        if not any(name.startswith(f"{s}.") for s in self.loaders):
            raise QueryError(f"no store for {name}")
        if name in self.indexes:
            return False
        self.indexes[name] = kind
        self.save()
        return True

    def drop_index(self, name: str) -> bool:
        found = self.indexes.pop(name, None) is not None
        if found:
            self.save()
        return found

    def indexed(self, store: str) -> frozenset[str]:
        """The store's fields that have an index."""
        return frozenset(n.removeprefix(f"{store}.") for n in self.indexes if n.startswith(f"{store}."))

    def stores(self, prefix: str = "") -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.loaders) if n.startswith(prefix)], "store string")

    def list_indexes(self, prefix: str = "") -> DataFrame:
        return self.spark.createDataFrame([x for x in sorted(self.indexes.items()) if x[0].startswith(prefix)], "index string, type string")

    def next_sequence(self, name: str) -> int:
        """1, 2, 3 and so on."""
        with self._lock:
            self.sequences[name] = self.sequences.get(name, 0) + 1
            self.save()
            return self.sequences[name]

    def records(self) -> str:
        return json.dumps({"indexes": self.indexes, "sequences": self.sequences, "version": self.version}, sort_keys=True)

    def restore(self, records: str) -> None:
        found = json.loads(records)
        self.indexes, self.sequences, self.version = found["indexes"], found["sequences"], found["version"]

    def save(self) -> None:
        """The records as the next version under ``path``, if there is one."""
        self.version += 1
        if self.path:
            self.spark.createDataFrame([(self.version, self.records())], "version long, records string").coalesce(1).write.mode("append").json(self.path)

    @staticmethod
    def at(spark: SparkSession, path: str) -> Catalog:
        """The catalog kept under ``path``, a folder that the driver can write; a new one if nothing is there yet."""
        catalog = Catalog(spark, path=path)
        spark.createDataFrame([], "version long, records string").write.mode("append").json(path)
        if last := spark.read.schema("version long, records string").json(path).orderBy("version", ascending=False).first():
            catalog.restore(last["records"])
        return catalog
