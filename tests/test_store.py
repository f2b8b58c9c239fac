"""Semantics of predicates, aggregates, paging, changes, nesting and files, on typed rows and on VARIANT documents."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.errors import CursorBehindRetention, ManifestError, QueryError
from quern.functions.coercions import from_csv, from_csv_variant, from_json, number_as, rescued
from quern.functions.predicates import from_spec, predicate
from quern.operators.aggregate import as_document
from quern.operators.changes import changes, compacted, deleted, inserted, new_key, next_lsn, replaced, state, updated
from quern.operators.nest import embed_all, split
from quern.plans.query import Query, get, hex_key, key_range, key_text, keyed, scan, scan_stores
from quern.sources import bson
from quern.sources.files import csv_ready, export_by_manifest, export_csv, export_json, import_csv, import_json, json_array, read_csv, write_csv
from quern.sources.manifest import Manifest, expand
from quern.sources.shared import shared_folder
from quern.streaming.watch import cursor_after, published, replica, replicate, stream, watch

PEOPLE = [
    ("0" * 31 + "1", "Alice", 30, 9500, True, 4.5, ("NYC", 10001), ["a", "b"]),
    ("0" * 31 + "2", "Bob", 41, 100, False, math.nan, ("LA", None), []),
    ("0" * 31 + "3", None, None, None, None, None, None, None),
    ("0" * 31 + "4", "Alice", 30, 7, True, -1.0, (None, 5), ["c"]),
    ("0" * 31 + "5", "a.i|x", 25, 0, False, 0.0, ("NYC", 5), ["a"]),
]
SCHEMA = "key string, name string, age int, score bigint, active boolean, rating double, addr struct<city:string,zip:int>, tags array<string>"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    """The same rows as keys and VARIANTs, and fields of mixed types."""
    more = [{"v": 1}, {"v": 2.5}, {"v": "3"}, {"v": "x"}, {"v": True}, {"v": None}, {}, {"v": {"w": 1}}, {"v": [1]}]
    rows = [(r[0], json.dumps({k: v for k, v in zip(("name", "age", "score", "active", "rating"), r[1:6]) if v is not None and v == v} | ({"addr": {"city": r[6][0], "zip": r[6][1]}} if r[6] else {}))) for r in PEOPLE]
    rows += [(f"{100 + i:032x}", json.dumps(d)) for i, d in enumerate(more)]
    return spark.createDataFrame(rows, "key string, d string").select("key", F.parse_json("d").alias("doc"))


def keys(df):
    return sorted(int(r["key"], 16) for r in df.collect())


CASES = [
    ("name", "eq", "Alice", [1, 4]), ("name", "ne", "Alice", [2, 5]), ("age", "eq", 30.0, [1, 4]), ("age", "ne", 30, [2, 5]), ("age", "gt", 25, [1, 2, 4]),
    ("age", "gte", 41.5, []), ("score", "lt", 8, [4, 5]), ("score", "lte", 100, [2, 4, 5]), ("active", "eq", True, [1, 4]), ("active", "ne", True, [2, 5]), ("active", "gt", False, []),
    ("active", "eq", 1, []), ("age", "eq", "30", []), ("name", "gt", "Al", [1, 2, 4, 5]), ("name", "contains", "lic", [1, 4]), ("name", "contains", "LIC", []), ("age", "contains", "3", []),
    ("name", "startsWith", "B", [2]), ("age", "in", [25, "41", True, 30.0], [1, 4, 5]), ("age", "in", [], []), ("name", "regex", "^Al", [1, 4]), ("name", "regex", "b$", [2]),
    ("name", "regex", "^Bob$", [2]), ("name", "regex", "a.i", [5]), ("name", "regex", "^", [1, 2, 4, 5]), ("name", "regex", "", [1, 2, 4, 5]), ("name", "regex", "A" * 257, []),
    ("age", "regex", "3", []), ("age", "between", [25, 30], [1, 4, 5]), ("addr.zip", "eq", 5, [4, 5]), ("addr.city", "eq", "NYC", [1, 5]), ("addr.none", "ne", 1, []), ("nothing", "ne", 1, []),
    ("tags", "eq", "a", []), ("rating", "gt", -5, [1, 4, 5]),
]


@pytest.mark.parametrize("path,op,value,want", CASES)
def test_predicates(people, documents, path, op, value, want):
    assert keys(people.where(predicate(people, path, op, value))) == want
    if path not in ("tags",):
        assert [k for k in keys(documents.where(predicate(documents, path, op, value))) if k < 100] == want


def test_variant_classes(documents):
    found = lambda *p: [k - 100 for k in keys(documents.where(predicate(documents, "v", *p))) if k >= 100]
    assert found("gt", 0) == [0, 1] and found("eq", "3") == [2] and found("eq", True) == [4] and found("ne", 1) == [1]
    assert found("exists", True) == [0, 1, 2, 3, 4, 5, 7, 8] and found("exists", False) == [6]
    assert found("in", [1, "x", True]) == [0, 3, 4] and found("regex", "^x$") == [3]
    row = Query(documents.where("key >= '" + f"{100:032x}" + "'")).aggregate(n="count", s=("sum", "v"), a=("avg", "v"), lo=("min", "v"), hi=("max", "v")).frame().first()
    assert tuple(row) == (9, 6.5, 6.5 / 3, 1.0, 3.0)


def test_filter_specs(people):
    run = lambda spec: keys(people.where(from_spec(people, spec)))
    assert run({}) == [1, 2, 3, 4, 5]
    assert run({"age": {"$gte": 30, "$lt": 41}, "active": True}) == [1, 4]
    assert run({"$or": [{"name": "Bob"}, {"age": 25, "active": False}]}) == [2, 5]
    assert run({"$or": [{"name": "Bob"}, {"name": "Alice"}], "score": {"$lt": 10}}) == [4]
    assert run({"age": {"$exists": False}}) == [3]
    for bad in ({"$and": []}, {"a": {"$near": 1}}, {"a": None}, {"a": [1]}, {"$or": []}, {"$or": [{"$or": []}]}, {"a": {}}, {"a": {"$between": [1]}}):
        with pytest.raises(QueryError):
            from_spec(people, bad)
    with pytest.raises(QueryError):
        Query(people).matching("{not json")


def oracle(doc, op, value):
    """The semantics over plain values."""
    cls = lambda v: "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str" if isinstance(v, str) else None
    if op == "in":
        return any(oracle(doc, "eq", v) for v in value)
    if op == "between":
        return oracle(doc, "gte", value[0]) and oracle(doc, "lte", value[1])
    if doc is None or cls(doc) != cls(value) or (cls(doc) == "bool" and op not in ("eq", "ne")):
        return False
    return {"eq": doc == value, "ne": doc != value, "gt": doc > value, "gte": doc >= value, "lt": doc < value, "lte": doc <= value}[op]


def test_random_predicates(people):
    rnd, names = random.Random(11), ("name", "age", "score", "active")
    values = [30, 25, 7.0, "Alice", "Bob", True, False, "30", 0]
    for _ in range(25):
        groups = [[(rnd.choice(names), rnd.choice(["eq", "ne", "gt", "gte", "lt", "lte"]), rnd.choice(values)) for _ in range(rnd.randrange(1, 3))] for _ in range(rnd.randrange(1, 3))]
        q = Query(people)
        for g, group in enumerate(groups):
            for k, p in enumerate(group):
                q = q.or_(*p) if g and not k else q.where(*p)
        want = [i + 1 for i, r in enumerate(PEOPLE) if any(all(oracle(dict(zip(SCHEMA_NAMES, r))[f], op, v) for f, op, v in g) for g in groups)]
        assert keys(q.frame()) == want, groups


SCHEMA_NAMES = ("key", "name", "age", "score", "active")


def test_time(spark):
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 2)), ("2", None)], "key string, t timestamp")
    for value in ("2024-01-02 00:00:00", 1704153600000, dt.datetime(2024, 1, 2)):
        assert keys(df.where(predicate(df, "t", "eq", value))) == [1]
    assert keys(df.where(predicate(df, "t", "lt", "not a time"))) == [] == keys(df.where(predicate(df, "t", "eq", True)))


def test_sort_and_pages(people, documents):
    order = lambda q: [int(r["key"], 16) for r in q.frame().collect()]
    q = Query(people)
    assert order(q.order_by("age")) == [5, 1, 4, 2, 3] and order(q.order_by("age", "desc")) == [2, 4, 1, 5, 3]
    assert order(q.order_by("name").order_by("score")) == [4, 1, 2, 5, 3]
    assert order(q.order_by("age").skip(1).limit(2)) == [1, 4] and order(q.after("0x2").limit(2)) == [3, 4]
    assert order(q.skip(4)) == [5] and order(q.limit(0)) == []
    assert q.where("age", "exists").skip(1).limit(2).count().first()[0] == 2 and q.skip(9).count().first()[0] == 0
    assert order(Query(documents).where("age", "exists").order_by("age", "desc").limit(2)) == [2, 4]
    assert keys(get(people, "0x3")) == [3] and keys(key_range(people, "2", "4")) == [2, 3, 4] and keys(scan(people, "2", 1, 2)) == [3, 4]
    plucked = q.pluck("addr.city", "missing").frame()
    assert plucked.columns == ["key", "addr.city", "missing"] and plucked.first()[1] == "NYC"
    for bad in ("", "xyz", "1" * 33):
        with pytest.raises(QueryError):
            key_text(bad)
    with pytest.raises(QueryError):
        q.order_by("age", "down")


def test_groups(people):
    q = Query(people)
    got = {tuple(r) for r in q.group_by("name", "addr.city").aggregate(n="count", s=("sum", "rating")).frame().where("name IS NULL OR name <> 'Bob'").collect()}
    assert got == {("Alice", "NYC", 1, 4.5), ("Alice", None, 1, -1.0), (None, None, 1, 0.0), ("a.i|x", "NYC", 1, 0.0)}
    assert q.where("age", "gt", 99).aggregate(n="count").frame().collect() == []
    assert tuple(q.aggregate(s=("sum", "active"), m=("max", "name"), lo=("min", "nothing")).frame().first()) == (0.0, 0.0, 0.0)
    assert [r["n"] for r in q.group_by("age").aggregate(n="count").order_by("n", "desc").frame().collect()][0] == 2
    for bad in (lambda: q.aggregate(n="count").aggregate(n=("sum", "age")), lambda: q.aggregate(n=("median", "age")), lambda: q.aggregate(n="sum"), lambda: q.group_by("age"), lambda: q.aggregate(n="count").order_by("age")):
        with pytest.raises(QueryError):
            bad().frame()


def test_strings_that_are_numbers(spark):
    df = spark.createDataFrame([("1",), ("2.5",), (" 3",), ("4 ",), ("nan",), ("1_0",), ("x",), (None,)], "v string")
    assert Query(df).aggregate(s=("sum", "v")).frame().first()[0] == 3.5


def test_changes(spark):
    log = [(1, "k1", "s", "insert", 1, "a"), (2, "k1", "s", "update", 2, "b"), (3, "k1", "s", "delete", 3, None), (4, "k1", "s", "insert", 4, "c"), (6, "k2", "s", "delete", 6, None), (5, "k2", "s", "insert", 5, "late"), (7, "k3", "s", "delete", 7, None), (8, "k4", "t", "insert", 8, "d"), (8, "k4", "t", "insert", 8, "d")]
    df = spark.createDataFrame(log, "lsn long, key string, store string, kind string, ts long, value string")
    assert sorted((r["key"], r["value"]) for r in state(df).collect()) == [("k1", "c"), ("k4", "d")]
    assert sorted(compacted(df).collect()) == sorted(state(compacted(df)).collect())
    rows = spark.range(50).select(hex_key(F.col("id")).alias("key"), "id").repartition(7)
    made = changes(rows, "s", "insert", 10, 99)
    assert sorted((r["lsn"], r["id"]) for r in made.collect()) == [(i + 10, i) for i in range(50)]
    assert changes(rows.limit(0), "s", "insert", 1, 1).count() == 0
    with pytest.raises(QueryError):
        changes(rows, "s", "upsert", 1, 1)
    key = spark.range(1).select(new_key(258, 4, 1, F.lit(255))).first()[0]
    assert key == "0102" + "04" + "01" + "0" * 22 + "ff"


def test_set_and_delete(people):
    hit = predicate(people, "age", "gt", 29)
    out = {r["key"][-1]: r for r in updated(people, hit, {"score": 1, "fresh": "x"}).collect()}
    assert out["1"]["score"] == 1 and out["1"]["fresh"] == "x" and out["5"]["score"] == 0 and out["3"]["fresh"] is None
    assert keys(deleted(people, hit)) == [3, 5]
    with pytest.raises(QueryError):
        updated(people, hit, {"addr.city": "x"})


def test_watch(spark, tmp_path):
    rows = [(i, "orders" if i % 2 else "payments", "insert" if i < 8 else "delete", f"k{i % 3}") for i in range(1, 11)]
    log = spark.createDataFrame(rows, "lsn long, store string, kind string, key string")
    lsns = lambda df: [r["lsn"] for r in df.collect()]
    assert lsns(watch(log, since=3)) == [4, 5, 6, 7, 8, 9, 10] and lsns(watch(log, ["orders"], since=3, max_records=2)) == [5, 7]
    assert cursor_after(watch(log, since=3, max_records=2), 3) == 5 and cursor_after(watch(log, since=10), 10) == 10
    assert lsns(watch(log, retention=3)) == [8, 9, 10] and lsns(watch(log, since=8, retention=3)) == [9, 10]
    for since in (5, 7):
        with pytest.raises(CursorBehindRetention):
            watch(log, since=since, retention=3)
    assert lsns(log.where(published({"orders": ["delete"]}))) == [9]
    with pytest.raises(QueryError):
        published({"orders": ["read"]})
    for part in (log.where("lsn <= 5"), log.where("lsn > 5"), log.where("lsn = 9")):
        part.write.mode("append").parquet(f"{tmp_path}/log")
        replicate(stream(spark, f"{tmp_path}/log", log.schema, {"orders": ["insert", "update", "delete"]}), f"{tmp_path}/replica", f"{tmp_path}/cursor").awaitTermination()
    assert sorted((r["key"], r["lsn"]) for r in replica(spark, f"{tmp_path}/replica").collect()) == [("k1", 7), ("k2", 5)]


def test_coercions(spark):
    df = spark.createDataFrame([("", "", "x", "5", "ab" * 12), ("7", "1.5", "true", "1700000000000", "zz"), ("7x", "q", "1", "soon", None)], "i string, d string, b string, t string, o string")
    got = df.select(from_csv(F.col("i"), "int"), from_csv(F.col("d"), "double"), from_csv(F.col("b"), "bool"), F.unix_millis(from_csv(F.col("t"), "datetime")), from_csv(F.col("o"), "objectid")).collect()
    assert [tuple(r) for r in got] == [(None, None, False, 5, "ab" * 12), (7, 1.5, True, 1700000000000, None), (None, None, True, None, None)]
    assert [r[0] for r in df.select(rescued(F.col("i"), "int")).collect()] == [None, None, "7x"]
    row = spark.sql("SELECT 'yes' AS y, '2024-01-02T00:00:00Z' AS t, '9' AS i, 2.0D AS n").select(from_json(F.col("y"), "bool"), from_json(F.col("t"), "datetime"), from_json(F.col("i"), "int"), number_as(F.col("n"), "bool"), number_as(F.col("n"), "int")).first()
    assert tuple(row) == (True, 1704153600000, 9, True, 2)


MANIFEST = {"store": "orders", "format": "csv", "entities": [
    {"name": "orders", "role": "parent", "fields": [{"name": "order_id", "type": "int"}, {"name": "total", "type": "double"}]},
    {"name": "items", "role": "child", "join_key": "order_id", "fields": [{"name": "item_id", "type": "int"}, {"name": "order_id", "type": "int"}, {"name": "price", "type": "double"}]},
    {"name": "attributes", "role": "child", "parent": "items", "parent_field": "attrs", "join_key": "item_id", "fields": [{"name": "item_id", "type": "int"}, {"name": "attr_name"}]},
]}


def test_manifest_and_nesting(spark):
    folder = shared_folder(spark)
    text = {"orders": "order_id,total\n1,10.5\n2,\n3,x\n", "items": 'item_id,order_id,price\n10,1,2\n11,1,"3"\n12,2,4\n', "attributes": 'item_id,attr_name\n10,"a, ""quoted"""\n10,"two\nlines"\n'}
    for name, body in text.items():
        spark.createDataFrame([(body.rstrip("\n"),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    manifest = Manifest.of(MANIFEST)
    got = {r["order_id"]: r for r in import_csv(spark, folder, manifest, multiline=True).collect()}
    assert [i["item_id"] for i in got[1]["items"]] == [10, 11] and got[1]["items"][1]["attrs"] is None and got[3]["items"] is None and got[3]["total"] is None
    assert sorted(a["attr_name"] for a in got[1]["items"][0]["attrs"]) == ['a, "quoted"', "two\nlines"]
    parts = split(import_csv(spark, folder, manifest).withColumn("key", hex_key(F.col("order_id"))))
    assert set(parts) == {"", "items"} and parts["items"].columns[:2] == ["_parent_id", "order_id"] and parts["items"].count() == 3
    bad = read_csv(spark, f"{folder}/orders", [("order_id", "int"), ("total", "double")], rescue=True)
    assert [r["_rescued"] for r in bad.collect()] == [None, None, '{"total":"x"}']
    wrong = [{"name": "a", "role": "child"}, {"name": "a", "role": "aunt"}, {"name": "a", "fields": [{"name": "x", "type": "decimal"}]}, {"name": "a", "parent": "b"}, {}]
    for spec in ({}, {"format": "csv"}, {"store": "s"}, {"store": "s", "format": "xml"}, *({"store": "s", "format": "csv", "entities": [e]} for e in wrong)):
        with pytest.raises(ManifestError):
            Manifest.of(spec)
    assert Manifest.of(manifest.mapping()) == manifest == Manifest.parse(json.dumps(manifest.mapping()))
    with pytest.raises(ManifestError):
        embed_all({"orders": spark.range(1), "items": spark.range(1), "attributes": spark.range(1)}, manifest)
    assert expand("${today} ${yesterday} ${now}", 90_000_000) == "86400000 0 90000000"


def test_manifest_text():
    text = """
store: stores.orders   # a comment
format: csv
output_dir: /data/orders
entities:
  - name: orders
    role: parent
    file: orders.csv
    fields:
      - name: order_id
        type: int
      - {name: total, type: double}
  - name: items
    role: child
    parent_field: items
    join_key: order_id
    fields: [{name: item_id, type: int}, {name: note}]
  - {name: attributes, role: child, parent: items, join_key: item_id, fields: [{name: attr_name}]}
"""
    manifest = Manifest.parse(text)
    root = manifest.root()
    assert (manifest.store, manifest.format, manifest.output_dir, root.fields) == ("stores.orders", "csv", "/data/orders", (("order_id", "int"), ("total", "double")))
    assert [c.name for c in manifest.children(root)] == ["items"] and [c.name for c in manifest.children(manifest.children(root)[0])] == ["attributes"]
    for bad in ("a: [", "- a", "store: s", "3"):
        with pytest.raises(ManifestError):
            Manifest.parse(bad)


def test_files(spark, people):
    folder = shared_folder(spark)
    manifest = export_csv(Query(people).where("age", "exists"), f"{folder}/csv")
    assert [e.name for e in manifest.entities] == ["documents", "addr"] and read_csv(spark, f"{folder}/csv/documents").count() == 4
    assert Manifest.of(json.loads(spark.read.text(f"{folder}/csv/manifest").first()[0])) == manifest
    again = {r["_id"]: r for r in import_csv(spark, f"{folder}/csv", manifest).collect()}
    assert {k[-1] for k in again} == {"1", "2", "4", "5"} and again["0" * 31 + "1"]["addr"][0]["zip"] == 10001 and again["0" * 31 + "1"]["score"] == 9500
    texts = spark.createDataFrame([("", 1), (None, 2), ('a,"b"', 3)], "t string, n int")
    write_csv(texts, f"{folder}/texts")
    assert sorted((r["n"], r["t"]) for r in read_csv(spark, f"{folder}/texts", [("n", "int")]).collect()) == [(1, ""), (2, None), (3, 'a,"b"')]
    assert csv_ready(people).where("name = 'Bob'").first()["tags"] == "[]"
    export_json(Query(people).pluck("name", "age"), f"{folder}/json")
    assert sorted(r["age"] for r in import_json(spark, f"{folder}/json", [("age", "double")]).where("age IS NOT NULL").collect()) == [25.0, 30.0, 30.0, 41.0]
    assert len(json.loads(json_array(Query(people).pluck("name")).first()[0])) == 5
    raw = bson.to_bson(people.select("key", "name", "age", "score", "active", "addr", "tags").withColumn("at", F.lit(1.5)))
    joined = spark.createDataFrame([(b"".join(r[0] for r in raw.collect()) + b"\x20\0\0\0bad",)], "bson binary")
    out = bson.from_bson(joined).collect()
    assert sum(r["failed"] for r in out) == 1 and json.loads(out[0]["json"])["addr"] == {"city": "NYC", "zip": 10001}
    assert bson.decode(bson.encode({"a": None, "b": 1 << 40, "c": [1, {"d": "é"}], "t": dt.datetime(1970, 1, 1, 0, 0, 1)}))[0] == {"a": None, "b": 1 << 40, "c": [1, {"d": "é"}], "t": 1000}


def test_bson_files(spark, people, tmp_path):
    """Files are documents one after the other, byte for byte."""
    df = people.select("key", "name", "age", "active", "rating").repartition(2)
    bson.write_bson(df, f"{tmp_path}/b")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "b").glob("part-*")))
    assert len(raw) == sum(len(r[0]) for r in bson.to_bson(df).collect())
    found = [json.loads(r["json"]) for r in bson.read_bson(spark, f"{tmp_path}/b").collect() if not r["failed"]]
    assert sorted(f["key"] for f in found) == sorted(r["key"] for r in df.collect()) and {f.get("name") for f in found} == {"Alice", "Bob", None, "a.i|x"}


def test_catalog(spark, people):
    c = Catalog(spark)
    assert c.create("shop.people", lambda: people) and not c.create("shop.people", lambda: people)
    assert c.query("shop.people").count().first()[0] == 5 and c.create_index("shop.people.age", "I32")
    assert not c.create_index("shop.people.age", "I32") and c.drop_index("shop.people.age") and not c.drop_index("shop.people.age") and c.create_index("shop.people.age", "I32")
    assert c.query("shop.people", {"sort": {"age": 1}, "limit": 1}, strict_index=True).frame().first()["age"] == 25
    with pytest.raises(QueryError):
        c.query("shop.people", {"sort": {"name": 1}}, strict_index=True)
    c.create("sales.x", lambda: people)
    assert [r["store"] for r in c.scan("4", limit=3).collect()] == ["sales.x", "shop.people", "sales.x"]
    assert [r[0] for r in c.stores("shop").collect()] == ["shop.people"] and c.list_indexes().count() == 1
    assert [c.next_sequence("s"), c.next_sequence("s"), c.next_sequence("t")] == [1, 2, 1]
    other = Catalog(spark)
    other.restore(c.records())
    assert other.next_sequence("s") == 3
    assert c.drop("shop.people") and c.list_indexes().count() == 0 and not c.drop("shop.people")
    for bad in (lambda: c.table("none"), lambda: c.create("sys.x", lambda: people), lambda: c.create_index("none.x", "I32"), lambda: c.create_index("sales.x.y", "Date")):
        with pytest.raises(QueryError):
            bad()


def test_catalog_is_kept(spark, people, tmp_path):
    path = f"{tmp_path}/catalog"
    one = Catalog.at(spark, path)
    one.create("s", lambda: people)
    assert [one.next_sequence("a"), one.next_sequence("a"), one.next_sequence("b")] == [1, 2, 1] and one.create_index("s.age", "I32")
    two = Catalog.at(spark, path)
    assert two.next_sequence("a") == 3 and two.indexes == {"s.age": "I32"}
    assert Catalog.at(spark, path).next_sequence("a") == 4


def test_json_queries(spark, people, documents):
    run = lambda df, spec: [int(r["key"], 16) for r in Query.of(df, spec).result().collect()]
    spec = {"filter": {"name": "Alice"}, "sort": {"score": -1}, "limit": 5}
    assert run(people, spec) == [1, 4] == run(documents, spec) and run(people, json.dumps(spec)) == [1, 4]
    assert run(people, {"orderBy": {"field": "age", "direction": "desc"}, "limit": 2}) == [2, 4] and run(people, {"orderBy": [{"field": "name"}, {"field": "score", "direction": "asc"}], "offset": 1, "limit": 2}) == [1, 2]
    assert run(people, {"after": "0x2", "limit": 2}) == [3, 4] and run(people, {"sort": {"age": 1}, "skip": 3, "offset": 1, "limit": 1}) == [1]
    assert run(people, {"filter": {"age": {"$gte": 18, "$lt": 41}}, "sort": {"age": 1}}) == [5, 1, 4] and run(documents, {"filter": {"score": {"$between": [10, 500]}}}) == [2]
    for name in ("select", "$select", "pluck", "$pluck", "projection"):
        assert Query.of(people, {name: ["addr.city", "age"]}).result().columns == ["key", "addr.city", "age"]
    assert Query.of(people, {"count": True, "filter": {"age": {"$exists": True}}, "offset": 1, "limit": 2}).result().first()[0] == 2
    groups = Query.of(people, {"aggregate": {"n": {"$count": True}, "s": {"$sum": "score"}}, "group_by": ["name"], "sort": {"n": -1}}).result()
    assert tuple(groups.first()) == ("Alice", 2, 9507.0)
    shaped = as_document(groups, ["name"], ["n", "s"]).first()
    assert shaped["key"]["name"] == "Alice" and shaped["values"]["n"] == 2
    assert {tuple(r) for r in Query.of(documents, {"filter": {"v": {"$exists": True}}, "aggregate": {"n": {"$count": True}}, "groupBy": ["v"]}).result().collect()} == {("1", 1), ("2.5", 1), ("3", 1), ("x", 1), ("true", 1), (None, 3)}
    for bad in ("[1]", "{", {"where": {}}, {"filter": []}, {"sort": []}, {"orderBy": "a"}, {"orderBy": [{"direction": "asc"}]}, {"limit": -1}, {"limit": "1"}, {"limit": True}, {"after": 5}, {"select": "a"}, {"select": []}, {"aggregate": {}}, {"aggregate": {"n": {"count": True}}}, {"aggregate": {"n": {"$median": "a"}}}, {"aggregate": {"n": {"$sum": "a", "$avg": "a"}}}, {"group_by": [1]}, {"count": 3}):
        with pytest.raises(QueryError):
            Query.of(people, bad).result()


def test_exact_integers_in_documents(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(f"{i:032x}", json.dumps({"v": v})) for i, v in enumerate([big, big - 1, big + 1, float(big), "9007199254740993", True, 1 << 62])], "key string, d string").select("key", F.parse_json("d").alias("doc"))
    found = lambda *p: keys(docs.where(predicate(docs, "v", *p)))
    # an integer meets a fraction as doubles
    assert found("eq", big) == [0, 3] and found("ne", big) == [1, 2, 6] and found("gt", big) == [2, 6] and found("lte", big) == [0, 1, 3] and found("in", [big, "9007199254740993"]) == [0, 3, 4]
    assert found("eq", big - 1) == [1, 3] and found("gt", 1 << 70) == [] and found("lt", 1 << 70) == [0, 1, 2, 3, 6] and found("eq", 1 << 62) == [6]


def test_set_in_documents(spark, documents):
    hit = predicate(documents, "age", "gte", 30)
    out = {int(r["key"], 16): json.loads(r["d"]) for r in updated(documents, hit, {"score": None, "fresh": {"a": [1]}, "name": "x"}).select("key", F.to_json("doc").alias("d")).collect()}
    assert out[1] == {"name": "x", "age": 30, "score": None, "active": True, "rating": 4.5, "addr": {"city": "NYC", "zip": 10001}, "fresh": {"a": [1]}}
    assert "fresh" not in out[5] and out[100] == {"v": 1} and updated(documents, hit, {}) is documents
    odd = spark.createDataFrame([("1", "[1]"), ("2", "3"), ("3", None)], "key string, d string").select("key", F.parse_json("d").alias("doc"))
    assert [r[0] for r in updated(odd, F.lit(True), {"a": 1}).select(F.to_json("doc")).collect()] == ["[1]", "3", None]
    with pytest.raises(QueryError):
        updated(documents, hit, {"addr.city": "x"})


def test_inserts_and_updates_by_key(spark):
    rows = spark.createDataFrame([(f"n{i}", i) for i in range(20)], "name string, n int").repartition(4)
    log = inserted(rows, "s", 7, 5, 1_700_000_000_000).cache()
    assert sorted(r["lsn"] for r in log.collect()) == list(range(5, 25)) and len({r["key"] for r in log.collect()}) == 20 and next_lsn(log) == 25
    assert all(len(r["key"]) == 32 and r["key"].startswith("000704") for r in log.collect()) and next_lsn(log.limit(0)) == 1
    key = log.where("n = 3").first()["key"]
    change = replaced(log, key, spark.createDataFrame([("new", 33)], "name string, n int"), "s", 1)
    after = state(log.unionByName(change))
    assert after.count() == 20 and tuple(after.where(F.col("key") == key).select("lsn", "name", "n").first()) == (25, "new", 33)
    assert replaced(log, "f" * 32, rows.limit(1), "s", 1).count() == 0


def test_export_by_manifest(spark, people):
    folder = shared_folder(spark)
    spec = {"store": "people", "format": "csv", "output_dir": folder, "query": '{"filter": {"score": {"$lt": "${now}"}}}'.replace('"${now}"', "${now}"), "entities": [
        {"name": "who", "file": "who.csv", "fields": [{"name": "name"}, {"name": "age", "type": "int"}, {"name": "none"}]},
        {"name": "place", "role": "child", "parent_field": "addr", "join_key": "name", "fields": [{"name": "city"}, {"name": "nothing"}]}]}
    paths = export_by_manifest(people, Manifest.of(spec), now_ms=8000)
    assert paths == [f"{folder}/who.csv", f"{folder}/place"]
    who, place = read_csv(spark, paths[0], [("age", "int")]), read_csv(spark, paths[1])
    assert who.columns == ["_id", "name", "age", "none"] and place.columns == ["_parent_id", "name", "city", "nothing"]
    assert sorted((r["_id"][-1], r["age"]) for r in who.collect()) == [("2", 41), ("4", 30), ("5", 25)] and sorted(r["city"] or "" for r in place.collect()) == ["", "LA", "NYC"]
    for kind in ("json", "bson"):
        assert export_by_manifest(people, Manifest.of({"store": "p", "format": kind, "output_dir": f"{folder}/{kind}"})) == [f"{folder}/{kind}/export.{kind}"]
    assert spark.read.json(f"{folder}/json/export.json").count() == 5
    with pytest.raises(ManifestError):
        export_by_manifest(people, Manifest.of({"store": "p", "format": "csv"}))


def test_nested_json_coercion(spark):
    folder = shared_folder(spark)
    text = '{"age":"30","score":4.5,"active":true,"name":"bob","tags":["a","b"],"addr":{"city":"NYC","age":"7"},"kids":[{"age":"1","score":"2"},{"age":"x"}]}'
    spark.createDataFrame([(text,), ("7",), ('{"age":"31"}',)], "value string").coalesce(1).write.text(folder)
    got = import_json(spark, folder, [("age", "int"), ("score", "double"), ("tags", "int")]).where("age IS NOT NULL").orderBy("age").collect()
    assert [r["age"] for r in got] == [30, 31] and got[0]["addr"]["age"] == 7 and [k["age"] for k in got[0]["kids"]] == [1, None] and got[0]["kids"][0]["score"] == 2.0 and got[0]["tags"] == ["a", "b"] and got[1]["addr"] is None
    cells = spark.createDataFrame([("7",), ("7x",), ("",), (None,)], "c string").select(F.to_json(from_csv_variant(F.col("c"), "int")).alias("v"))
    assert [r[0] for r in cells.collect()] == ["7", '"7x"', None, None]


def test_scan_of_all_stores(spark, people, documents):
    got = scan_stores({"b": people, "a": documents}, "4", limit=4).collect()
    assert [(r["store"], int(r["key"], 16)) for r in got] == [("a", 4), ("b", 4), ("a", 5), ("b", 5)]
    with pytest.raises(QueryError):
        scan_stores({})


def test_keys_of_numbers(spark):
    """Reads by key are also bounds of the number, negative ones after all others."""
    numbers = [-5, -1, 0, 1, 41, 42, 43, 1 << 40, (1 << 63) - 1]
    store = keyed(spark.createDataFrame([(n,) for n in numbers], "n long"), "n")
    found = lambda df: {r["n"] for r in df.collect()}
    assert found(get(store, "2a")) == {42} and found(key_range(store, "1", "2a")) == {1, 41, 42} and found(scan(store, "2b")) == {43, 1 << 40, (1 << 63) - 1, -5, -1}
    assert found(Query(store).after("2b").frame()) == {1 << 40, (1 << 63) - 1, -5, -1} and found(get(store, "f" * 16)) == {-1} and found(key_range(store, "2b", "f" * 16)) == {43, 1 << 40, (1 << 63) - 1, -5, -1}
    orders = keyed(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    for df in (get(orders, "2a"), key_range(orders, "1", "9"), scan(orders, "2a", limit=3), Query(orders).after("2a").limit(3).frame()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "(o_orderkey," in plan.split("PushedFilters: [")[1]


def test_plans(spark):
    """Filters reach the scan, columns are pruned, limits become a top-k, aggregates shuffle once."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(Query(orders).where("o_totalprice", "between", [1, 5]).where("o_orderstatus", "in", ["F", "P"]).pluck("o_orderkey").frame())
    assert "GreaterThanOrEqual(o_totalprice" in p and "In(o_orderstatus" in p and "o_custkey" not in p
    assert "TakeOrderedAndProject" in plan(Query(orders).order_by("o_totalprice", "desc").skip(5).limit(5).frame())
    assert plan(Query(orders).group_by("o_orderstatus").aggregate(n="count", s=("sum", "o_totalprice")).frame()).count("Exchange") == 1


def test_stands_without_the_llm_package(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quern", f"{tmp_path}/quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'scan_filter_eq' in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
