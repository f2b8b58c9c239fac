"""Manifests of imports and exports: a small set of entities, their files, fields and nesting."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from quern.errors import ManifestError
from quern.functions.coercions import TYPES

DAY_MS = 86_400_000
FORMATS, ROLES = ("csv", "json", "bson"), ("parent", "child")


@dataclass(frozen=True)
class Entity:
    name: str
    role: str = "parent"
    file: str | None = None
    parent: str | None = None
    parent_field: str | None = None
    join_key: str | None = None
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def embed_as(self) -> str:
        return self.parent_field or self.name


@dataclass(frozen=True)
class Manifest:
    store: str
    format: str = "csv"
    output_dir: str | None = None
    query: str | None = None
    entities: tuple[Entity, ...] = ()

    def root(self) -> Entity:
        roots = [e for e in self.entities if e.role == "parent"]
        if len(roots) != 1:
            raise ManifestError(f"{len(roots)} parents; one is needed")
        return roots[0]

    def children(self, entity: Entity) -> list[Entity]:
        """A child without a parent's name belongs to the root."""
        return [e for e in self.entities if e.role == "child" and (e.parent or self.root().name) == entity.name]

    @staticmethod
    def parse(text: str) -> Manifest:
        """A manifest from YAML text, which JSON text is too; where no YAML reader is installed, from JSON text."""
        try:
            import yaml

            read, wrong = yaml.safe_load, yaml.YAMLError
        except ImportError:
            read, wrong = json.loads, json.JSONDecodeError
        try:
            spec = read(text)
        except wrong as e:
            raise ManifestError(f"can't be read: {e}") from None
        if not isinstance(spec, Mapping):
            raise ManifestError("a manifest is a mapping")
        return Manifest.of(spec)

    @staticmethod
    def of(spec: Mapping) -> Manifest:
        """A manifest from a mapping, as a YAML or JSON reader gives it."""
        if not spec.get("store"):
            raise ManifestError("no store")
        if not (kind := spec.get("format")):
            raise ManifestError("no format")
        if kind not in FORMATS:
            raise ManifestError(f"unknown format: {kind}")
        entities = []
        for e in spec.get("entities") or ():
            if not e.get("name"):
                raise ManifestError("an entity without a name")
            if (role := e.get("role", "parent")) not in ROLES:
                raise ManifestError(f"unknown role: {role}")
            if role == "child" and not e.get("join_key"):
                raise ManifestError(f"child {e['name']} has no join_key")
            fields = tuple((f["name"], f.get("type", "string")) for f in e.get("fields") or ())
            for name, t in fields:
                if t not in TYPES:
                    raise ManifestError(f"unknown type of {name}: {t}")
            entities.append(Entity(e["name"], role, e.get("file"), e.get("parent"), e.get("parent_field"), e.get("join_key"), fields))
        names = {e.name for e in entities}
        for e in entities:
            if e.parent and e.parent not in names:
                raise ManifestError(f"{e.name} has an unknown parent: {e.parent}")
        return Manifest(spec["store"], kind, spec.get("output_dir"), spec.get("query"), tuple(entities))


    def mapping(self) -> dict:
        """As ``of`` takes it; in JSON text it is YAML, too."""
        entities = [{k: v for k, v in vars(e).items() if v is not None and k != "fields"} | {"fields": [{"name": n, "type": t} for n, t in e.fields]} for e in self.entities]
        return {k: v for k, v in vars(self).items() if v is not None and k != "entities"} | {"entities": entities}


def expand(text: str, now_ms: int) -> str:
    """Variables of dates as epoch milliseconds; days begin at midnight UTC."""
    today = now_ms - now_ms % DAY_MS
    values = {"today": today, "yesterday": today - DAY_MS, "tomorrow": today + DAY_MS, "now": now_ms, "week_ago": today - 7 * DAY_MS, "month_ago": today - 30 * DAY_MS}
    for name, value in values.items():
        text = text.replace(f"${{{name}}}", str(value))
    return text
