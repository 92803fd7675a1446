"""Registered queries over the test tables, each with its SQL, one or more for each operator."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import (
    IdGenerationConfig,
    NodeMapping,
    PropertyMapping,
    RelationshipMapping,
    SchemaConstraint,
    SchemaHook,
    SourceConfig,
    TransformConfig,
    ValidationRuleConfig,
)
from weftgraph.functions.ids import generate_id
from weftgraph.functions.transforms import apply_chain
from weftgraph.operators import graph as g
from weftgraph.operators.hooks import run_hook
from weftgraph.operators.schema import violations
from weftgraph.operators.validation import Validated, apply_rules
from weftgraph.sources import read_source
from weftgraph.sources.paths import file_system, removed_at_exit, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_source(spark, SourceConfig(name=name, type="spark_parquet", path=_path(sf_dir, name)))


# Sources


@query("src_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "nation")


@query("src_parquet_sql", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    return read_source(spark, SourceConfig(name="orders_f", type="spark_parquet", path=_path(sf_dir, "orders"), query="SELECT o_orderkey, o_custkey, o_totalprice FROM __orders_f WHERE o_orderstatus = 'F'"))


@query("src_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, sf_dir):
    _table(spark, sf_dir, "customer").createOrReplaceTempView("weft_customer")
    return read_source(spark, SourceConfig(name="t", type="spark_table", query="WITH c AS (SELECT * FROM weft_customer) SELECT c_mktsegment, count(*) AS n FROM c GROUP BY c_mktsegment"))


def _scratch(spark: SparkSession) -> str:
    """A new folder for files of these round trips, where all executors see it; it goes with the application."""
    return removed_at_exit(spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}")


@query("src_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _(spark, sf_dir):
    path = f"{_scratch(spark)}/nation_csv"
    _table(spark, sf_dir, "nation").write.mode("overwrite").csv(path, header=True)
    return read_source(spark, SourceConfig(name="n", type="csv", path=path))


@query("src_spark_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf_dir):
    path = f"{_scratch(spark)}/nation_scsv"
    _table(spark, sf_dir, "nation").write.mode("overwrite").csv(path, header=True, sep="|")
    return read_source(spark, SourceConfig(name="n", type="spark_csv", path=path, delimiter="|"))


@query("src_json_root", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    path = f"{_scratch(spark)}/nation_json"
    rows = _table(spark, sf_dir, "nation").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))
    rows.select(F.to_json(F.struct(F.struct(F.array(F.struct("rows")).alias("pages")).alias("data"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return read_source(spark, SourceConfig(name="n", type="json", path=path, json_root="data.pages.0.rows"))


@query("src_jsonl", "SELECT r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
def _(spark, sf_dir):
    path = f"{_scratch(spark)}/region_jsonl"
    _table(spark, sf_dir, "region").write.mode("overwrite").json(path)
    return read_source(spark, SourceConfig(name="r", type="spark_json", path=path))


def derby_archive(spark: SparkSession, table: str, df: DataFrame) -> str:
    """The url of a read-only embedded database with one small table, which driver and executors open alike.

    A database in memory or in a folder belongs to one process, so it is made in the driver and
    shipped as an archive on the class path. Its rows pass one at a time.
    """
    jvm, kinds = spark._jvm, {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR(32672)", "double": "DOUBLE"}
    name = f"weft_{uuid.uuid4().hex}"
    jvm.org.apache.spark.util.Utils.classForName("org.apache.derby.iapi.jdbc.AutoloadedDriver", True, False)
    with tempfile.TemporaryDirectory(prefix="weft-") as top:
        db = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:memory:{name};create=true")
        columns = ", ".join(f'"{c}" {kinds[t]}' for c, t in df.dtypes)
        db.createStatement().executeUpdate(f"CREATE TABLE {table} ({columns})")
        insert = db.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(df.columns))})")
        for row in df.toLocalIterator():
            for k, v in enumerate(row, 1):
                insert.setObject(k, v)
            insert.executeUpdate()
        backup = db.prepareCall("CALL SYSCS_UTIL.SYSCS_BACKUP_DATABASE(?)")
        backup.setString(1, top)
        backup.execute()
        db.close()
        try:
            jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:memory:{name};drop=true")
        except Exception as e:  # the database says by an error that it is gone
            if "08006" not in str(e):
                raise
        path = shutil.make_archive(f"{tempfile.mkdtemp(prefix='weft-')}/{name}", "zip", top, name)
    jar = f"{path.removesuffix('.zip')}.jar"
    os.rename(path, jar)
    atexit.register(shutil.rmtree, os.path.dirname(jar), ignore_errors=True)
    spark.sql(f"ADD JAR '{jar}'")
    return f"jdbc:derby:classpath:{name}"


def _derby(spark: SparkSession, sf_dir: str, kind: str, text: str) -> DataFrame:
    """A round trip through an embedded database, read by the executors."""
    url = derby_archive(spark, "nation", _table(spark, sf_dir, "nation"))
    return read_source(spark, SourceConfig(name="n", type=kind, connection_string=url, query=text, headers={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, chunk_size=10))


@query("src_sql", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(spark, sf_dir):
    return _derby(spark, sf_dir, "sql", 'SELECT "n_nationkey", "n_name" FROM nation WHERE "n_regionkey" = 1')


@query("src_jdbc", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(spark, sf_dir):
    return _derby(spark, sf_dir, "spark_jdbc", 'SELECT "n_nationkey", "n_name" FROM nation WHERE "n_regionkey" = 2')


def served(spark: SparkSession, sf_dir: str, pagination: dict, rate_limit: dict | None = None) -> DataFrame:
    """The nations by pages of a server in this process; they are read while it runs."""
    rows = [r.asDict() for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlsplit(self.path).query)
            size = int(q["per_page"][0])
            at = int(q["cursor"][0]) if "cursor" in q else (int(q.get("page", ["1"])[0]) - 1) * size
            body = json.dumps({"data": rows[at : at + size], "meta": {"next": at + size if at + size < len(rows) else None}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        cfg = SourceConfig(name="n", type="rest", url=f"http://127.0.0.1:{server.server_port}/nations", json_root="data", pagination=pagination, rate_limit=rate_limit)
        got = [tuple(r) for r in read_source(spark, cfg).select("n_nationkey", "n_name").collect()]
    finally:
        server.shutdown()
    return spark.createDataFrame(got, "n_nationkey long, n_name string")


@query("src_rest", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    return served(spark, sf_dir, {"page_size": 10})


# Transforms


def _transform(name: str, table: str, key: str, field: str, sql: str, chain: list[dict], pre: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        df = pre(df) if pre else df
        return df.select(key, apply_chain(df, F.col(field), [TransformConfig(**t) for t in chain]).alias("v"))

    query(name, f"SELECT {key}, {sql} AS v FROM {table}")(run)


_transform("xf_to_string", "lineitem", "l_orderkey", "l_quantity", "CAST(l_quantity AS VARCHAR)", [{"type": "to_string"}])
_transform("xf_to_int", "lineitem", "l_orderkey", "l_extendedprice", "CAST(trunc(l_extendedprice) AS BIGINT)", [{"type": "to_int"}])
_transform("xf_to_float", "orders", "o_orderkey", "t", "CAST(o_orderkey AS DOUBLE)", [{"type": "to_float"}], lambda d: d.withColumn("t", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 "))))
_transform("xf_to_bool", "orders", "o_orderkey", "t", "o_orderstatus = 'F'", [{"type": "to_bool"}], lambda d: d.withColumn("t", F.when(F.col("o_orderstatus") == "F", "YES").otherwise("t")))
_transform("xf_to_datetime", "orders", "o_orderkey", "t", "strftime(o_orderdate, '%Y-%m-%dT00:00:00')", [{"type": "to_datetime", "params": {"format": "%Y-%m-%d"}}], lambda d: d.withColumn("t", F.col("o_orderdate").cast("date").cast("string")))
_transform("xf_uppercase", "part", "p_partkey", "p_name", "upper(p_name)", [{"type": "uppercase"}])
_transform("xf_lowercase", "customer", "c_custkey", "c_mktsegment", "lower(c_mktsegment)", [{"type": "lowercase"}])
_transform("xf_strip", "part", "p_partkey", "t", "p_name", [{"type": "strip"}], lambda d: d.withColumn("t", F.concat(F.lit("\t   "), "p_name", F.lit("\u001c\n "))))
_transform("xf_replace", "part", "p_partkey", "p_brand", "replace(p_brand, 'Brand', 'B')", [{"type": "replace", "params": {"old": "Brand", "new": "B"}}])
_transform("xf_default", "orders", "o_orderkey", "t", "CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END", [{"type": "default", "params": {"default": "none"}}], lambda d: d.withColumn("t", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))))
_transform("xf_template", "customer", "c_custkey", "c_custkey", "'customer:' || CAST(c_custkey AS VARCHAR) || '{}'", [{"type": "template", "params": {"template": "customer:{value}{{}}"}}])
_transform("xf_sha256", "customer", "c_custkey", "c_name", "substr(sha256(c_name), 1, 24)", [{"type": "sha256", "params": {"length": 24}}])
_transform("xf_concat", "customer", "c_custkey", "c_custkey", "CAST(c_custkey AS VARCHAR)", [{"type": "concat", "params": {"separator": "-"}}])
_transform("xf_chain", "customer", "c_custkey", "t", "upper(c_name) || '!'", [{"type": "strip"}, {"type": "uppercase"}, {"type": "template", "params": {"template": "{value}!"}}], lambda d: d.withColumn("t", F.concat(F.lit("  "), "c_name", F.lit(" "))))


# Validation


def _rule(name: str, table: str, cols: list[str], where: str, **rule) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        return apply_rules(df, [ValidationRuleConfig(**rule)]).valid.select(*cols)

    query(name, f"SELECT {', '.join(cols)} FROM {table} WHERE {where}")(run)


_rule("vr_required", "events", ["event_id"], "props IS NOT NULL AND props <> ''", field="props", rule="required")
_rule("vr_type_int", "part", ["p_partkey"], "regexp_matches(p_brand, '^[0-9]+$')", field="p_brand", rule="type", params={"expected": "int"})
_rule("vr_type_float", "events", ["event_id"], "true", field="value", rule="type", params={"expected": "float"})
_rule("vr_regex", "customer", ["c_custkey", "c_mktsegment"], "regexp_matches(c_mktsegment, '^(A|BU)')", field="c_mktsegment", rule="regex", params={"pattern": "A|BU"})
_rule("vr_min", "orders", ["o_orderkey"], "NOT (o_totalprice < 100000)", field="o_totalprice", rule="min", params={"value": 100000})
_rule("vr_max", "lineitem", ["l_orderkey", "l_linenumber"], "NOT (l_discount > 0.05)", field="l_discount", rule="max", params={"value": "0.05"})
_rule("vr_one_of", "orders", ["o_orderkey"], "o_orderstatus IN ('F', 'O')", field="o_orderstatus", rule="one_of", params={"values": ["F", "O", 1]})

_RULES = [
    {"field": "o_totalprice", "rule": "max", "params": {"value": 200000}, "message": "too dear"},
    {"field": "o_orderstatus", "rule": "one_of", "params": {"values": ["F", "O"]}},
    {"field": "no_such_column", "rule": "min", "params": {"value": 1}},
]


def _checked(spark: SparkSession, sf_dir: str) -> Validated:
    return apply_rules(_table(spark, sf_dir, "orders"), [ValidationRuleConfig(**r) for r in _RULES])


_ERRORS_SQL = """concat_ws('; ', CASE WHEN o_totalprice > 200000 THEN 'too dear' END,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'Field ''o_orderstatus'' must be one of [''F'', ''O''], got ''' || o_orderstatus || '''' END)"""


@query("vr_all_errors", f"SELECT o_orderkey, {_ERRORS_SQL} AS errors FROM orders")
def _(spark, sf_dir):
    return _checked(spark, sf_dir).checked.select("o_orderkey", F.array_join("_errors", "; ").alias("errors"))


@query("vr_dead_letter", f"SELECT o_orderkey, o_custkey, {_ERRORS_SQL} AS errors FROM orders WHERE o_totalprice > 200000 OR o_orderstatus NOT IN ('F', 'O')")
def _(spark, sf_dir):
    return _checked(spark, sf_dir).rejects().select("record.o_orderkey", "record.o_custkey", F.array_join("errors", "; ").alias("errors"))


# Ids


def _ids(name: str, table: str, key: str, sql: str, **cfg) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        return df.select(key, generate_id(df, IdGenerationConfig(**cfg)).alias("id"))

    query(name, f"SELECT {key}, {sql} AS id FROM {table}")(run)


_ids("id_sha256", "orders", "o_orderkey", "'o-' || substr(sha256(concat_ws(':', CAST(o_orderkey AS VARCHAR), o_orderstatus, '')), 1, 16)", fields=["o_orderkey", "o_orderstatus", "absent"], prefix="o-")
_ids("id_composite", "nation", "n_nationkey", "concat_ws('/', CAST(n_regionkey AS VARCHAR), n_name)", strategy="composite", fields=["n_regionkey", "n_name"], separator="/")
_ids("id_passthrough", "customer", "c_custkey", "'c' || CAST(c_custkey AS VARCHAR)", strategy="passthrough", fields=["c_custkey"], prefix="c")


# Nodes and relationships


def _prop(field: str, target: str | None = None, *chain: str) -> PropertyMapping:
    return PropertyMapping(source_field=field, target=target, transform=[TransformConfig(type=t) for t in chain] or None)


CUSTOMER = NodeMapping(source="customer", label="Customer", key="custkey", properties=[_prop("c_custkey", "custkey"), _prop("c_name", "name", "strip"), _prop("c_mktsegment", "segment", "lowercase")])
ORDER = NodeMapping(source="orders", label="Order", key="orderkey", properties=[_prop("o_orderkey", "orderkey"), _prop("o_orderstatus", "status")])
BUYER = NodeMapping(source="orders", label="Customer", key="custkey", properties=[_prop("o_custkey", "custkey")])
PLACED = RelationshipMapping(source="orders", rel_type="PLACED", from_label="Customer", from_key="custkey", from_field="o_custkey", to_label="Order", to_key="orderkey", to_field="o_orderkey", properties=[_prop("o_totalprice", "price"), _prop("o_totalprice", "whole", "to_int")])


@query("node_project", "SELECT c_custkey AS custkey, c_name AS name, lower(c_mktsegment) AS segment FROM customer")
def _(spark, sf_dir):
    return g.project_nodes(_table(spark, sf_dir, "customer"), CUSTOMER)


@query("rel_project", "SELECT o_custkey AS from_val, o_orderkey AS to_val, o_totalprice AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def _(spark, sf_dir):
    return g.project_rels(_table(spark, sf_dir, "orders"), PLACED)


_LAST = NodeMapping(source="events", label="User", key="user_id", properties=[_prop("event_type", "last_type"), _prop("value", "last_value")])


@query("node_merge_last", "SELECT user_id, event_type AS last_type, value AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf_dir):
    df = _table(spark, sf_dir, "events").withColumn(g.SEQ, F.struct(F.lit("").alias("f"), F.lit(0).cast("long").alias("b"), F.col("event_id").alias("r")))
    return g.merge([g.project_nodes(df, _LAST)], ["user_id"])


@query("node_merge_multi", "SELECT coalesce(c.c_custkey, o.k) AS custkey, c.c_name AS name, lower(c.c_mktsegment) AS segment FROM customer c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.c_custkey = o.k")
def _(spark, sf_dir):
    rows = [g.project_nodes(_table(spark, sf_dir, m.source), m) for m in (CUSTOMER, BUYER)]
    return g.merge(rows, ["custkey"])


def _shop(spark: SparkSession, sf_dir: str, few: bool = False) -> g.PropertyGraph:
    """Customers (all, or those of one segment) and orders as nodes, orders placed as relationships."""
    out = g.PropertyGraph()
    customers = _table(spark, sf_dir, "customer")
    if few:
        customers = customers.where("c_mktsegment = 'BUILDING'")
    orders = _table(spark, sf_dir, "orders")
    g.merge_nodes(out, "Customer", "custkey", [g.project_nodes(customers, CUSTOMER)])
    g.merge_nodes(out, "Order", "orderkey", [g.project_nodes(orders, ORDER)])
    g.merge_rels(out, PLACED, [g.project_rels(orders, PLACED)])
    return out


@query("rel_merge", "SELECT o_custkey AS from_val, o_orderkey AS to_val, o_totalprice AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    return _shop(spark, sf_dir).rel("PLACED")


@query("rel_merge_dedup", "SELECT DISTINCT l_orderkey AS from_val, l_partkey AS to_val FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def _(spark, sf_dir):
    out = g.PropertyGraph()
    part = NodeMapping(source="part", label="Part", key="partkey", properties=[_prop("p_partkey", "partkey")])
    has = RelationshipMapping(source="lineitem", rel_type="HAS", from_label="Order", from_key="orderkey", from_field="l_orderkey", to_label="Part", to_key="partkey", to_field="l_partkey")
    for m, t in ((ORDER, "orders"), (part, "part")):
        g.merge_nodes(out, m.label, m.key, [g.project_nodes(_table(spark, sf_dir, t), m)])
    g.merge_rels(out, has, [g.project_rels(_table(spark, sf_dir, "lineitem"), has)])
    return out.rel("HAS")


@query("rel_dangling", "SELECT o_custkey AS from_val, o_orderkey AS to_val, o_totalprice AS price, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf_dir):
    return g.dangling_rels(_shop(spark, sf_dir, few=True), PLACED, g.project_rels(_table(spark, sf_dir, "orders"), PLACED))


# Schema and hooks


@query("schema_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    return violations(_table(spark, sf_dir, "lineitem"), SchemaConstraint(label="Item", property=["l_orderkey", "l_linenumber"]))


@query("schema_exists", "SELECT doc_id FROM labels WHERE quality IS NULL")
def _(spark, sf_dir):
    return violations(_table(spark, sf_dir, "labels"), SchemaConstraint(label="Doc", property="quality", type="exists")).select("doc_id")


@query("schema_node_key", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1 OR c_nationkey IS NULL")
def _(spark, sf_dir):
    return violations(_table(spark, sf_dir, "customer"), SchemaConstraint(label="Customer", property="c_nationkey", type="node_key"))


@query("hook_degree", "SELECT c_custkey AS custkey, c_name AS name, lower(c_mktsegment) AS segment, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    out = run_hook(_shop(spark, sf_dir), SchemaHook(cypher="MATCH (c:Customer) SET c.orders = size([(c)-[:PLACED]->(o) | o])"))
    return out.nodes["Customer"].df


@query("hook_count", "SELECT o_orderkey AS orderkey, o_orderstatus AS status, n AS buyers FROM orders LEFT JOIN (SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey) ON o_orderkey = k")
def _(spark, sf_dir):
    out = run_hook(_shop(spark, sf_dir, few=True), SchemaHook(cypher="MATCH (o:Order)<-[r:PLACED]-() WITH o, count(r) AS n SET o.buyers = n"))
    return out.nodes["Order"].df


@query("hook_avg", "SELECT c_custkey AS custkey, m AS mean_price FROM customer LEFT JOIN (SELECT o_custkey, avg(trunc(o_totalprice)) AS m FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    out = run_hook(_shop(spark, sf_dir), SchemaHook(cypher="MATCH (c:Customer)-[r:PLACED]->() WITH c, avg(r.whole) AS m SET c.mean_price = m"))
    return out.nodes["Customer"].df.select("custkey", "mean_price")


@query("hook_sql", "SELECT c_custkey AS custkey, c_name AS name, lower(c_mktsegment) AS segment, n AS orders, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    hook = SchemaHook(sql="SELECT from_val AS custkey, count(*) AS orders, round(sum(price), 2) AS total FROM rel_PLACED JOIN node_Order ON to_val = orderkey GROUP BY from_val", label="Customer")
    return run_hook(_shop(spark, sf_dir), hook, spark).nodes["Customer"].df


# A whole job


def job_config(sf_dir: str, **settings) -> dict:
    """Customers, orders and who placed them, with rules on both mappings of orders."""
    rules = {"rules": [{"field": "o_totalprice", "rule": "max", "params": {"value": 200000}}], "on_error": "dead_letter"}
    return {
        "settings": settings,
        "sources": [{"name": n, "type": "spark_parquet", "path": _path(sf_dir, n)} for n in ("customer", "orders")],
        "nodes": [CUSTOMER.model_dump(), ORDER.model_dump() | {"validation": rules}],
        "relationships": [PLACED.model_dump() | {"validation": rules}],
        "schema": {"constraints": [{"label": "Customer", "property": "custkey"}, {"label": "Order", "property": ["orderkey", "status"], "type": "node_key"}]},
        "post_hooks": [{"cypher": "MATCH (c:Customer)-[r:PLACED]->() WITH c, count(r) AS n SET c.orders = n"}],
    }


_GOOD = "(SELECT count(*) FROM orders WHERE NOT o_totalprice > 200000)"
_BAD = "(SELECT count(*) FROM orders WHERE o_totalprice > 200000)"


@query("job_metrics_counts", f"SELECT 'nodes:Customer' AS step, (SELECT count(*) FROM customer) AS processed, 0::BIGINT AS failed UNION ALL SELECT 'nodes:Order', {_GOOD}, {_BAD} UNION ALL SELECT 'rels:PLACED', {_GOOD}, {_BAD}")
def _(spark, sf_dir):
    from weftgraph.config import IngestConfig
    from weftgraph.plans.engine import run

    out = run(IngestConfig.model_validate(job_config(sf_dir)), spark=spark)
    rows = [(s.name, s.records_processed, s.records_failed) for s in out.metrics.steps if ":" in s.name and not s.name.startswith("source:")]
    return spark.createDataFrame(rows, "step string, processed long, failed long")


@query("job_graph", "SELECT c_custkey AS custkey, n AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE NOT o_totalprice > 200000 GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    from weftgraph.config import IngestConfig
    from weftgraph.plans.engine import run

    return run(IngestConfig.model_validate(job_config(sf_dir)), spark=spark).graph.nodes["Customer"].df.select("custkey", "orders")


# Mapping front-ends, runs on top of a former output, and streams

_SHEET = """source_entity,field_cardinality,source_column,data_type,is_key,transform,target_entity,target_column,relationship_type,rel_source_key,rel_target_key
customer,1:1,c_custkey,int,true,,customer,custkey,,,
customer,1:1,c_name,string,false,"strip,uppercase",customer,name,,,
customer,1:M,c_nationkey,int,false,,nation,n_nationkey,LIVES_IN,nationkey,
customer,1:1,c_nationkey,int,false,,customer,nationkey,,,
nation,1:1,n_nationkey,int,true,,nation,,,,
nation,1:1,n_name,string,false,lowercase,nation,name,,,
"""


def _sheet_graph(spark: SparkSession, sf_dir: str) -> g.PropertyGraph:
    from weftgraph.plans.csv_mapping import load_csv_mapping
    from weftgraph.plans.engine import run

    with tempfile.NamedTemporaryFile("w", suffix=".csv") as f:  # read by the driver only
        f.write(_SHEET)
        f.flush()
        sources = [{"name": n, "type": "spark_parquet", "path": _path(sf_dir, n)} for n in ("customer", "nation")]
        cfg = load_csv_mapping(f.name, sources=sources)
    return run(cfg, spark=spark).graph


@query("map_sheet_nodes", "SELECT c_custkey AS custkey, upper(c_name) AS name, CAST(c_nationkey AS BIGINT) AS nationkey FROM customer")
def _(spark, sf_dir):
    return _sheet_graph(spark, sf_dir).nodes["customer"].df


@query("map_sheet_rels", "SELECT DISTINCT c_nationkey AS from_val, c_nationkey AS to_val FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    return _sheet_graph(spark, sf_dir).rel("LIVES_IN")


@query("map_kg_nodes", "SELECT substr(sha256(concat_ws('|', CAST(n_regionkey AS VARCHAR), n_name)), 1, 12) AS _id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def _(spark, sf_dir):
    from weftgraph.plans.engine import run
    from weftgraph.plans.kg_schema import from_dict

    raw = {
        "idGeneration": {"strategy": "sha256-hash", "hashLength": 12, "separator": "|"},
        "nodes": [{"label": "Nation", "source": "nation", "naturalKey": ["n_regionkey", "n_name"], "properties": {"name": "n_name", "region": {"sourceField": "n_regionkey", "type": "number"}}}],
    }
    cfg = from_dict(raw, sources=[{"name": "nation", "type": "spark_parquet", "path": _path(sf_dir, "nation")}])
    return run(cfg, spark=spark).graph.nodes["Nation"].df


@query("job_rerun", "SELECT c_custkey AS custkey, c_name AS name, lower(c_mktsegment) AS segment, CASE WHEN n > 0 THEN n END AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE NOT o_totalprice > 200000 GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(spark, sf_dir):
    """The same job twice over one output: the graph is the same as after one run."""
    from weftgraph.config import IngestConfig
    from weftgraph.plans.engine import run

    cfg = IngestConfig.model_validate(job_config(sf_dir, output_path=f"{_scratch(spark)}/graph"))
    run(cfg, spark=spark)
    return run(cfg, spark=spark).graph.nodes["Customer"].df


@query("stream_merge", "SELECT event_id, event_type AS last_type, value AS last_value FROM events WHERE event_type <> 'error'")
def _(spark, sf_dir):
    from weftgraph.config import ValidationConfig
    from weftgraph.streaming.merge import merge_stream

    rules = ValidationConfig(rules=[ValidationRuleConfig(field="event_type", rule="one_of", params={"values": ["purchase", "view", "signup", "click"]})])
    path = _path(sf_dir, "events")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_folder(spark, path))
    out = _scratch(spark)
    merge_stream(stream, _LAST.model_copy(update={"key": "event_id", "validation": rules}), f"{out}/t", f"{out}/c", buckets=8).awaitTermination()
    return spark.read.parquet(f"{out}/t").drop("bucket")


def _folder(spark: SparkSession, path: str) -> str:
    """A folder with a table's files, as streams read folders; a single file is copied to one."""
    fs, p = file_system(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return path
    copy = f"{_scratch(spark)}/in"
    spark.read.parquet(path).write.parquet(copy)
    return copy


@query("stream_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    from weftgraph.streaming.merge import windowed_counts

    path = _path(sf_dir, "events")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_folder(spark, path))
    out = f"{_scratch(spark)}/windows"
    counts = windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(out)  # noqa: E731  each batch has all windows
    counts.writeStream.outputMode("complete").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("string").alias("day"), "event_type", "n")
