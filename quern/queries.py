"""The registered queries of the store library, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.catalog import Catalog
from quern.functions.coercions import from_csv
from quern.functions.predicates import predicate
from quern.operators.aggregate import as_document
from quern.operators.changes import changes, deleted, inserted, new_key, replaced, state, updated
from quern.operators.nest import embed, flatten
from quern.plans.query import Query, get, hex_key, key_range, keyed, scan, scan_stores
from quern.sources import bson
from quern.sources.files import export_by_manifest, import_json, read_csv, write_csv
from quern.sources.manifest import Manifest
from quern.sources.shared import shared_folder
from quern.streaming.watch import published, replica, replicate, stream, watch

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable[[Run], Run]:
    """Registers a query under its function's name."""

    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


KEY = "lpad(lower(to_hex({})), 32, '0') AS key"


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def scan_filter_eq(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderstatus", "eq", "F").frame()


@query(f"SELECT {KEY.format('o_orderkey')}, * FROM orders WHERE o_orderkey = 42")
def get_by_key(s: SparkSession, d: str) -> DataFrame:
    return get(keyed(table(s, d, "orders"), "o_orderkey"), "0x2A")


@query(f"SELECT {KEY.format('o_orderkey')}, * FROM orders WHERE o_orderkey BETWEEN 100 AND 150 ORDER BY o_orderkey LIMIT 100")
def range_by_key(s: SparkSession, d: str) -> DataFrame:
    return key_range(keyed(table(s, d, "orders"), "o_orderkey"), f"{100:x}", f"{150:x}")


@query(f"SELECT {KEY.format('o_orderkey')}, * FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def scan_skip_limit(s: SparkSession, d: str) -> DataFrame:
    return scan(keyed(table(s, d, "orders"), "o_orderkey"), f"{1000:x}", skip=10, limit=20)


@query(f"SELECT {KEY.format('o_orderkey')}, * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def cursor_after(s: SparkSession, d: str) -> DataFrame:
    return Query(keyed(table(s, d, "orders"), "o_orderkey")).after(f"{500:x}").limit(25).frame()


@query("SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'")
def filter_ne(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderpriority", "ne", "1-URGENT").frame()


@query("SELECT * FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def filter_range_open(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "lineitem")).matching({"l_quantity": {"$gt": 10, "$lt": 20}}).frame()


@query("SELECT * FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 50000")
def filter_range_closed(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_totalprice", "gte", 1000).where("o_totalprice", "lte", 50000).frame()


@query("SELECT * FROM part WHERE contains(p_name, 'ring')")
def filter_contains(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "part")).where("p_name", "contains", "ring").frame()


@query("SELECT * FROM orders WHERE starts_with(o_orderpriority, '1-')")
def filter_starts_with(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderpriority", "startsWith", "1-").frame()


@query("SELECT * FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "nation")).where("n_regionkey", "in", [1, 3]).frame()


@query("SELECT * FROM nation WHERE n_regionkey IN (1)")
def filter_in_mixed_types(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "nation")).where("n_regionkey", "in", [1, "3", True]).frame()


def events(s: SparkSession, d: str) -> DataFrame:
    """Events with their JSON properties as a VARIANT."""
    return table(s, d, "events").withColumn("props", F.try_parse_json("props"))


EVENT = ("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def filter_exists(s: SparkSession, d: str) -> DataFrame:
    return Query(events(s, d)).where("props.k", "exists").pluck(*EVENT).frame()


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE json_extract(props, '$.zz') IS NULL")
def filter_exists_false(s: SparkSession, d: str) -> DataFrame:
    return Query(events(s, d)).where("props.zz", "exists", False).pluck(*EVENT).frame()


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50")
def filter_variant_range(s: SparkSession, d: str) -> DataFrame:
    return Query(events(s, d)).where("props.k", "gte", 50).pluck(*EVENT).frame()


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'")
def filter_time(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "events")).matching('{"ts": {"$gte": "2024-01-15 00:00:00", "$lt": 1705363200000}}').pluck(*EVENT).frame()


@query("SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1')")
def filter_regex_prefix(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "part")).where("p_brand", "regex", "^Brand#1").frame()


@query("SELECT * FROM part WHERE ends_with(p_brand, '7')")
def filter_regex_suffix(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "part")).where("p_brand", "regex", "7$").frame()


@query("SELECT * FROM part WHERE p_type = 'PROMO'")
def filter_regex_exact(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "part")).where("p_type", "regex", "^PROMO$").frame()


@query("SELECT * FROM documents WHERE contains(text, '. ') AND contains(lang, 'e')")
def filter_regex_literal(s: SparkSession, d: str) -> DataFrame:
    """A dot is a dot."""
    return Query(table(s, d, "documents")).where("text", "regex", ". ").where("lang", "regex", "e").frame()


@query("SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def filter_between(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).matching({"o_totalprice": {"$between": [1000, 50000]}}).frame()


@query("SELECT * FROM orders WHERE o_orderstatus = 'P'")
def filter_type_mismatch(s: SparkSession, d: str) -> DataFrame:
    """A number is neither equal nor unequal to a string."""
    return Query(table(s, d, "orders")).where("o_orderkey", "ne", "abc").or_("o_orderstatus", "eq", "P").frame()


@query("SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'")
def filter_and_or(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderstatus", "eq", "F").where("o_totalprice", "gt", 200000).or_("o_orderpriority", "eq", "1-URGENT").frame()


@query("SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P')")
def or_to_in(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderstatus", "eq", "F").or_("o_orderstatus", "eq", "P").frame()


@query("""SELECT o.o_orderkey, c.c_mktsegment AS "customer.segment" FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'""")
def nested_field(s: SparkSession, d: str) -> DataFrame:
    customer = table(s, d, "customer").select(F.col("c_custkey"), F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    nested = table(s, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return Query(nested).where("customer.segment", "eq", "BUILDING").pluck("o_orderkey", "customer.segment").frame()


@query("SELECT c_custkey, c_name FROM customer")
def pluck(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "customer")).pluck("c_custkey", "c_name").frame()


@query("SELECT count(*) AS count FROM orders")
def count_all(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).count()


@query("SELECT greatest(0, least(count(*) - 100, 50)) AS count FROM orders WHERE o_orderstatus = 'F'")
def count_filtered_offset_limit(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderstatus", "eq", "F").skip(100).limit(50).count()


@query(f"SELECT {KEY.format('o_orderkey')}, * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 10")
def sort_single_desc_limit(s: SparkSession, d: str) -> DataFrame:
    return Query(keyed(table(s, d, "orders"), "o_orderkey")).order_by("o_totalprice", "desc").limit(10).frame()


@query(f"SELECT {KEY.format('c_custkey')}, * FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey DESC LIMIT 20")
def sort_multi(s: SparkSession, d: str) -> DataFrame:
    return Query(keyed(table(s, d, "customer"), "c_custkey")).order_by("c_mktsegment").order_by("c_acctbal", "desc").limit(20).frame()


@query(f"SELECT {KEY.format('o_orderkey')}, * FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5")
def sort_offset_limit(s: SparkSession, d: str) -> DataFrame:
    return Query(keyed(table(s, d, "orders"), "o_orderkey")).order_by("o_totalprice").skip(5).limit(10).frame()


@query("SELECT count(*) AS n, sum(l_quantity) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem HAVING count(*) > 0")
def agg_global(s: SparkSession, d: str) -> DataFrame:
    found = Query(table(s, d, "lineitem")).aggregate(n="count", s=("sum", "l_quantity"), a=("avg", "l_quantity"), lo=("min", "l_quantity"), hi=("max", "l_quantity"))
    return found.frame().withColumn("a", F.round("a", 6))


@query("SELECT count(*) AS n, coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0) AS s FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0 UNION ALL SELECT count(*), 0 FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")
def agg_empty(s: SparkSession, d: str) -> DataFrame:
    """No documents give no row; documents without a number give 0."""
    none = Query(table(s, d, "orders")).where("o_totalprice", "lt", 0).aggregate(n="count", s=("sum", "o_totalprice")).frame()
    return none.unionAll(Query(table(s, d, "orders")).where("o_orderstatus", "eq", "P").aggregate(n="count", s=("sum", "o_orderstatus")).frame())


@query("SELECT coalesce(sum(try_cast(c_name AS DOUBLE)), 0.0::DOUBLE) AS s, coalesce(min(try_cast(c_name AS DOUBLE)), 0.0::DOUBLE) AS m FROM customer")
def agg_non_numeric_zero(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "customer")).aggregate(s=("sum", "c_name"), m=("min", "c_name")).frame()


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_by_one(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).group_by("o_orderstatus").aggregate(n="count", total=("sum", "o_totalprice")).frame().withColumn("total", F.round("total", 2))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY 1, 2")
def group_by_two(s: SparkSession, d: str) -> DataFrame:
    found = Query(table(s, d, "lineitem")).group_by("l_returnflag", "l_linestatus").aggregate(n="count", avg_qty=("avg", "l_quantity"))
    return found.frame().withColumn("avg_qty", F.round("avg_qty", 6))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC")
def group_sorted(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).group_by("o_orderpriority").aggregate(n="count").order_by("n", "desc").frame()


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' OR value > 100 GROUP BY 1")
def group_filtered_or(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "events")).matching({"$or": [{"event_type": "click"}, {"value": {"$gt": 100}}]}).group_by("user_id").aggregate(n="count").frame()


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS k FROM events GROUP BY 1")
def agg_json_path(s: SparkSession, d: str) -> DataFrame:
    return Query(events(s, d)).group_by("event_type").aggregate(k=("sum", "props.k")).frame()


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc "
    "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
)
def flagship_pricing_summary(s: SparkSession, d: str) -> DataFrame:
    found = Query(table(s, d, "lineitem")).where("l_shipdate", "lte", "1998-09-02").group_by("l_returnflag", "l_linestatus")
    out = found.aggregate(n="count", sum_qty=("sum", "l_quantity"), sum_price=("sum", "l_extendedprice"), avg_disc=("avg", "l_discount")).frame()
    return out.withColumn("sum_price", F.round("sum_price", 2)).withColumn("avg_disc", F.round("avg_disc", 6))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN '9-NONE' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_set(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    return updated(orders, predicate(orders, "o_orderstatus", "eq", "P"), {"o_orderpriority": "9-NONE"})


@query("SELECT count(*) AS updated FROM orders WHERE o_orderstatus = 'P'")
def update_count(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "orders")).where("o_orderstatus", "eq", "P").count().withColumnRenamed("count", "updated")


@query("SELECT * FROM orders WHERE NOT coalesce(o_orderstatus = 'P', false)")
def delete_by_filter(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    return deleted(orders, predicate(orders, "o_orderstatus", "eq", "P"))


def event_log(s: SparkSession, d: str) -> DataFrame:
    """Events as changes of users: an error deletes one."""
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(s, d, "events").select(F.col("event_id").alias("lsn"), "user_id", hex_key(F.col("user_id")).alias("key"), F.lit("users").alias("store"), kind.alias("kind"), "event_type", "value")


@query(
    "SELECT user_id, event_id AS lsn, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"
)
def lww_state(s: SparkSession, d: str) -> DataFrame:
    return state(event_log(s, d)).select("user_id", "lsn", "event_type", "value")


@query("SELECT event_id AS lsn, event_type, value FROM events WHERE event_id > 500 AND event_type IN ('click', 'view') ORDER BY event_id LIMIT 100")
def watch_since(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events").select(F.col("event_id").alias("lsn"), F.col("event_type").alias("store"), F.lit("insert").alias("kind"), "event_type", "value")
    return watch(log.where(published({"click": ["insert"], "view": ["insert"]})), since=500, max_records=100).select("lsn", "event_type", "value")


@query("SELECT o.o_orderkey, count(l.l_orderkey) AS n_items, coalesce(sum(l.l_quantity), 0) AS qty FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def import_embed_children(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    nested = embed(table(s, d, "orders"), items, "o_orderkey", "items", keep_key=False)
    qty = F.aggregate(F.coalesce("items", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double>>")), F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return nested.select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), qty.alias("qty")).withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long")))


@query("SELECT l_orderkey AS _parent_id, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def export_flatten_children(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    nested = embed(table(s, d, "orders"), items, "o_orderkey", "items", keep_key=False)
    return flatten(nested, "items", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def export_filtered(s: SparkSession, d: str) -> DataFrame:
    return Query(table(s, d, "customer")).where("c_acctbal", "gt", 5000).pluck("c_custkey", "c_name").frame()


@query("SELECT CAST(try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS BIGINT) AS n FROM customer")
def coerce_csv(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(from_csv(F.regexp_extract("c_name", "[0-9]+", 0), "int").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def export_csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s)
    write_csv(Query(table(s, d, "customer")).pluck("c_custkey", "c_name", "c_acctbal").frame(), path)
    return read_csv(s, path, [("c_custkey", "int"), ("c_name", "string"), ("c_acctbal", "double")])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def bson_roundtrip(s: SparkSession, d: str) -> DataFrame:
    nation = table(s, d, "nation")
    read = bson.from_bson(bson.to_bson(nation)).where("NOT failed")
    return read.select(F.from_json("json", nation.schema).alias("d")).select("d.*")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def bson_file_roundtrip(s: SparkSession, d: str) -> DataFrame:
    orders, path = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), shared_folder(s)
    bson.write_bson(orders, path)
    return bson.read_bson(s, path).where("NOT failed").select(F.from_json("json", orders.schema).alias("d")).select("d.*")


@query("SELECT count(*) AS n, count(*) AS n_keys, count(*) + 99 AS last_lsn, sum(o_totalprice) AS total FROM orders")
def insert_batch(s: SparkSession, d: str) -> DataFrame:
    """Documents without keys into a log, under new keys."""
    log = inserted(table(s, d, "orders"), "orders", 7, first_lsn=100, ts=1_700_000_000_000)
    return state(log).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.max("lsn").alias("last_lsn"), F.sum("o_totalprice").alias("total"))


@query("SELECT user_id, CASE WHEN user_id = 7 THEN 'view' ELSE event_type END AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def update_by_key(s: SparkSession, d: str) -> DataFrame:
    """A user's document replaced by its key, if it is there."""
    log = event_log(s, d)
    key = f"{7:032x}"
    change = replaced(log, key, s.createDataFrame([(7, "view", 0.0)], "user_id long, event_type string, value double"), "users", ts=0)
    return state(log.unionByName(change, allowMissingColumns=True)).select("user_id", "event_type")


@query("SELECT event_type AS type, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def group_as_document(s: SparkSession, d: str) -> DataFrame:
    """Groups as documents of key and values."""
    groups = Query(table(s, d, "events")).group_by("event_type").aggregate(n="count", top=("max", "value")).frame()
    return as_document(groups, ["event_type"], ["n", "top"]).select(F.col("key.event_type").alias("type"), "values.n", "values.top")


@query("""SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY kind, num, str, event_id) AS rank FROM
          (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind, CASE WHEN event_id % 4 = 0 THEN value END AS num, CASE WHEN event_id % 4 = 1 THEN event_type END AS str FROM events)) WHERE rank > 2400 AND rank <= 2600""")
def sort_across_classes(s: SparkSession, d: str) -> DataFrame:
    """A field of numbers, strings, nulls and nothing: numbers come first, what is missing last."""
    v = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.col("value").alias("v")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.col("event_type").alias("v")))).when(F.col("event_id") % 4 == 2, '{"v": null}').otherwise("{}")
    docs = table(s, d, "events").select(hex_key(F.col("event_id")).alias("key"), "event_id", F.parse_json(v).alias("doc"))
    page = Query(docs).order_by("v").skip(2400).limit(200).frame()
    return page.select("event_id", (F.row_number().over(Window.orderBy(*Query(docs).order_by("v").order())) + 2400).alias("rank"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 99 AS lsn, 'insert' AS kind FROM orders")
def append_changes(s: SparkSession, d: str) -> DataFrame:
    rows = keyed(table(s, d, "orders"), "o_orderkey")
    return changes(rows, "orders", "insert", first_lsn=100, ts=0).select("o_orderkey", "lsn", "kind")


@query("SELECT o_orderkey, '000704' || '00' || lpad(lower(to_hex(o_orderkey)), 24, '0') AS key FROM orders")
def generated_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", new_key(7, 4, 0, F.col("o_orderkey")).alias("key"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS value FROM nation WHERE n_regionkey = 1")
def sequence_next(s: SparkSession, d: str) -> DataFrame:
    """Numbers for a few documents from a sequence that is kept in files."""
    names, path = Query(table(s, d, "nation")).where("n_regionkey", "eq", 1).order_by("n_nationkey").pluck("n_name").frame().collect(), shared_folder(s)
    rows = [(r[0], Catalog.at(s, path).next_sequence("nations")) for r in names[:2]]
    catalog = Catalog.at(s, path)
    return s.createDataFrame(rows + [(r[0], catalog.next_sequence("nations")) for r in names[2:]], "n_name string, value long")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET 5")
def json_query_sort_page(s: SparkSession, d: str) -> DataFrame:
    spec = """{"filter": {"o_totalprice": {"$gte": 1000}, "$or": [{"o_orderstatus": "F"}, {"o_orderstatus": "O"}]},
               "orderBy": [{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey", "direction": "desc"}], "limit": 20, "skip": 5,
               "pluck": ["o_orderkey", "o_orderstatus", "o_totalprice"]}"""
    return Query.of(table(s, d, "orders"), spec).result()


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events WHERE value BETWEEN 1 AND 100 GROUP BY 1")
def json_query_group(s: SparkSession, d: str) -> DataFrame:
    spec = {"filter": {"value": {"$between": [1, 100]}}, "aggregate": {"n": {"$count": True}, "total": {"$sum": "props.k"}}, "group_by": ["event_type"], "sort": {"n": -1}}
    return Query.of(events(s, d), spec).result()


@query("SELECT greatest(0, least(count(*) - 3, 40)) AS count FROM orders WHERE starts_with(o_orderpriority, '1-')")
def json_query_count(s: SparkSession, d: str) -> DataFrame:
    return Query.of(table(s, d, "orders"), '{"filter": {"o_orderpriority": {"$startsWith": "1-"}}, "count": true, "limit": 40, "offset": 3}').result()


@query("SELECT event_id FROM events WHERE 9007199254740992 + event_id IN (9007199254740993, 9007199254740995) OR 9007199254740992 + event_id > 9007199254740999")
def variant_big_int(s: SparkSession, d: str) -> DataFrame:
    """Integers that are no doubles, in documents."""
    docs = table(s, d, "events").select("event_id", F.parse_json(F.format_string('{"v": %d}', F.col("event_id") + 9007199254740992)).alias("doc"))
    return Query(docs).where("v", "in", [9007199254740993, 9007199254740995]).or_("v", "gt", 9007199254740999).pluck("event_id").frame()


@query("""SELECT event_id, CASE WHEN k >= 50 THEN 'high' END AS level, CASE WHEN k >= 50 THEN 0 ELSE k END AS k
          FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def update_set_document(s: SparkSession, d: str) -> DataFrame:
    """Fields set in documents: one anew, one in place of what is there."""
    docs = table(s, d, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    out = updated(docs, predicate(docs, "k", "gte", 50), {"level": "high", "k": 0})
    return out.select("event_id", F.try_variant_get("doc", "$.level", "string").alias("level"), F.try_variant_get("doc", "$.k", "bigint").alias("k"))


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def export_by_manifest_children(s: SparkSession, d: str) -> DataFrame:
    """Orders and their items written as a manifest says; the items read again."""
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus")
    store, path = keyed(embed(orders, items, "order_id", "items", keep_key=False), "order_id"), shared_folder(s)
    entities = [{"name": "orders", "fields": [{"name": "order_id", "type": "int"}]}, {"name": "items", "role": "child", "parent_field": "items", "join_key": "order_id", "fields": [{"name": "line", "type": "int"}, {"name": "quantity", "type": "double"}]}]
    export_by_manifest(store, Manifest.of({"store": "orders", "format": "csv", "output_dir": path, "query": '{"filter": {"o_orderstatus": "P"}}', "entities": entities}))
    return read_csv(s, f"{path}/items", [("order_id", "int"), ("line", "int"), ("quantity", "double")]).select("order_id", "line", "quantity")


@query("SELECT o_orderkey AS id, o_totalprice AS total, o_custkey AS customer, o_custkey % 2 = 1 AS odd FROM orders")
def import_json_nested(s: SparkSession, d: str) -> DataFrame:
    """JSON whose fields are strings or numbers, coerced at every depth."""
    path, o = shared_folder(s), table(s, d, "orders")
    text = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.col("o_totalprice").cast("string").alias("total"), F.array(F.struct(F.col("o_custkey").cast("string").alias("customer"), (F.col("o_custkey") % 2).alias("odd"))).alias("by")).alias("inner")))
    o.select(text.alias("value")).write.text(path)
    read = import_json(s, path, [("id", "int"), ("total", "double"), ("customer", "int"), ("odd", "bool")])
    return read.select("id", "inner.total", F.col("inner.by")[0]["customer"].alias("customer"), F.col("inner.by")[0]["odd"].alias("odd"))


@query(
    "SELECT * FROM (SELECT 'nation' AS store, lpad(lower(to_hex(n_nationkey)), 32, '0') AS key, n_name AS name FROM nation UNION ALL SELECT 'region', lpad(lower(to_hex(r_regionkey)), 32, '0'), r_name FROM region) WHERE key >= lpad('1', 32, '0') ORDER BY key, store LIMIT 12 OFFSET 2"
)
def scan_all_stores(s: SparkSession, d: str) -> DataFrame:
    stores = {"nation": keyed(table(s, d, "nation").withColumnRenamed("n_name", "name"), "n_nationkey"), "region": keyed(table(s, d, "region").withColumnRenamed("r_name", "name"), "r_regionkey")}
    return scan_stores(stores, "1", skip=2, limit=12).select("store", "key", F.try_variant_get("doc", "$.name", "string").alias("name"))


@query("SELECT 'shop.nation' AS store UNION ALL SELECT 'shop.region'")
def list_stores(s: SparkSession, d: str) -> DataFrame:
    catalog = Catalog(s)
    for name in ("nation", "region", "orders"):
        catalog.create(f"{'shop' if name != 'orders' else 'sales'}.{name}", lambda n=name: table(s, d, n))
    return catalog.stores("shop.")


@query(
    "SELECT user_id, event_id AS lsn, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"
)
def stream_watch_resume(s: SparkSession, d: str) -> DataFrame:
    """The log in two parts through a replica that stops and goes on."""
    log, folder = event_log(s, d), shared_folder(s)
    for part in (log.where("lsn % 2 = 0"), log.where("lsn % 2 = 1")):
        part.write.mode("append").parquet(f"{folder}/log")
        replicate(stream(s, f"{folder}/log", log.schema, {"users": ["update", "delete"]}), f"{folder}/replica", f"{folder}/cursor").awaitTermination()
    return replica(s, f"{folder}/replica").select("user_id", "lsn", "event_type", "value")
