"""Further registered queries: what a job reads, states, reports and refuses, each with its SQL.

Results that are not tables (statements, messages, metrics, settings) are given as rows of
(name, value) and stand as literals in the SQL.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Connection, IngestConfig, NodeMapping, SchemaConstraint, SchemaDefinition, SchemaHook, SchemaIndex, SourceConfig, TransformConfig, ValidationConfig, ValidationRuleConfig, load_config
from weftgraph.env import resolve
from weftgraph.functions.transforms import apply_chain
from weftgraph.operators import graph as g
from weftgraph.operators import schema
from weftgraph.operators.hooks import run_hook
from weftgraph.operators.statements import batched, connector_options, node_statement, rel_statement
from weftgraph.operators.validation import apply_rules, validate
from weftgraph.plans.catalogue import BUYER, CUSTOMER, ORDER, PLACED, _path, _prop, _rule, _scratch, _shop, _table, job_config, query, served
from weftgraph.plans.csv_mapping import load_csv_mapping
from weftgraph.plans.engine import run
from weftgraph.plans.kg_schema import from_dict
from weftgraph.registry import source_registry, transform_registry
from weftgraph.resilience import CircuitBreaker, CircuitBreakerOpen, MaxRetriesExceeded, TransientError, healthy, retry
from weftgraph.sources import read_source


def rows(spark: SparkSession, found: Iterable[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in found], "name string, value string")


def literal(found: Iterable[tuple[str, object]]) -> str:
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in found)}) AS t(name, value)"


# Validation

_rule("vr_regex_classes", "customer", ["c_custkey"], r"regexp_matches(c_name, '^\w+#0+\d{2}[5-9]\b')", field="c_name", rule="regex", params={"pattern": r"\w+#0+\d{2}[5-9]\b"})
_rule("vr_regex_flags", "customer", ["c_custkey"], "regexp_matches(c_mktsegment, '^(build|auto)', 'i')", field="c_mktsegment", rule="regex", params={"pattern": "(?i)(?:build|auto)"})
_rule("vr_regex_space", "orders", ["o_orderkey"], r"regexp_matches(o_orderpriority, '^\d-\S+\s\S+$')", field="o_orderpriority", rule="regex", params={"pattern": r"\d-\S+\s\S+$"})
_rule("vr_one_of_long", "orders", ["o_orderkey"], "o_orderkey IN (7, 11)", field="o_orderkey", rule="one_of", params={"values": [7, 11.0, 12.5, 2**63, "13"]})
_rule("vr_type_bool", "orders", ["o_orderkey"], "true", field="o_orderkey", rule="type", params={"expected": "bool"})


def _dear(on_error: str) -> ValidationConfig:
    return ValidationConfig(rules=[ValidationRuleConfig(field="o_totalprice", rule="max", params={"value": 200000})], on_error=on_error)


@query("vr_fail", "SELECT 'Validation failed at record ' || CAST(min(o_orderkey) AS VARCHAR) || ': Field ''o_totalprice'' above maximum 200000' AS message FROM orders WHERE o_totalprice > 200000")
def _(spark, sf_dir):
    """Keys of `orders` count its rows from 0, so the SQL knows each record's place."""
    try:
        validate(_table(spark, sf_dir, "orders"), _dear("fail"))
        text = ""
    except ValueError as e:
        text = str(e)
    return spark.createDataFrame([(text,)], "message string")


@query("vr_dead_letter_index", "SELECT CAST(o_orderkey AS BIGINT) AS record_index, o_orderkey, 'Field ''o_totalprice'' above maximum 200000' AS errors FROM orders WHERE o_totalprice > 200000")
def _(spark, sf_dir):
    found = validate(_table(spark, sf_dir, "orders"), _dear("dead_letter")).rejects()
    return found.select("record_index", "record.o_orderkey", F.array_join("errors", "; ").alias("errors"))


# Sources


@query("src_limit", "SELECT least(count(*), 7) AS n FROM orders")
def _(spark, sf_dir):
    return read_source(spark, SourceConfig(name="o", type="spark_parquet", path=_path(sf_dir, "orders"), limit=7)).agg(F.count(F.lit(1)).alias("n"))


@query("src_plugin", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_regionkey = 3")
def _(spark, sf_dir):
    @source_registry.register("nations_of_region")
    def nations(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
        return spark.read.parquet(cfg.path).where(F.col("n_regionkey") == int(cfg.params["region"])).select("n_nationkey", F.upper("n_name").alias("n_name"))

    return read_source(spark, SourceConfig(name="n", type="nations_of_region", path=_path(sf_dir, "nation"), params={"region": 3}))


@query("src_rest_cursor", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    """Pages by cursor, within a rate limit."""
    return served(spark, sf_dir, {"type": "cursor", "page_size": 4, "next_cursor_path": "meta.next"}, {"requests_per_second": 200, "burst": 2})


@query("src_csv_quoted", "SELECT n_nationkey || '' AS k, 'a \"' || n_name || '\",' || chr(10) || 'b' AS t, '' AS e FROM nation")
def _(spark, sf_dir):
    """Cells with quotes, separators and line breaks, and empty ones."""
    path = f"{_scratch(spark)}/quoted"
    df = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.concat(F.lit('a "'), "n_name", F.lit('",\nb')).alias("t"), F.lit(None).cast("string").alias("e"))
    df.write.csv(path, header=True, escape='"', quoteAll=True)
    return read_source(spark, SourceConfig(name="n", type="csv", path=path))


@query("src_csv_split", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def _(spark, sf_dir):
    """A file larger than a split whose lines are whole records, read in splits."""
    path, size = f"{_scratch(spark)}/split", "spark.sql.files.maxPartitionBytes"
    _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").coalesce(1).write.csv(path, header=True)
    before = spark.conf.get(size)
    spark.conf.set(size, "20000")
    try:
        df = read_source(spark, SourceConfig(name="n", type="csv", path=path))
        assert df.rdd.getNumPartitions() > 1 or df.count() < 1000
    finally:
        spark.conf.set(size, before)
    return df


# Plug-in transforms


@query("xf_plugin", "SELECT c_custkey, reverse(c_name) || '!!' AS v FROM customer")
def _(spark, sf_dir):
    transform_registry.register("backwards")(lambda col, **_: F.reverse(col))
    transform_registry.register_python("shout", "string")(lambda v, times=1: None if v is None else v + "!" * times)
    df = _table(spark, sf_dir, "customer")
    return df.select("c_custkey", apply_chain(df, F.col("c_name"), [TransformConfig(type="backwards"), TransformConfig(type="shout", params={"times": 2})]).alias("v"))


# Nodes, relationships and hooks

_BY_NAME = NodeMapping(source="customer", label="Customer", key="name", properties=[_prop("c_name", "name"), _prop("c_acctbal", "balance")])


@query(
    "node_merge_two_keys",
    """WITH a AS (SELECT c_custkey AS custkey, c_name AS name, lower(c_mktsegment) AS segment FROM customer WHERE c_nationkey < 10),
    b AS (SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_nationkey >= 5)
    SELECT a.custkey, coalesce(a.name, b.name) AS name, a.segment, b.balance FROM a FULL JOIN b ON a.name = b.name""",
)
def _(spark, sf_dir):
    """A label merged by its key, and by a property of it: nodes that have the value are updated, others made."""
    out, df = g.PropertyGraph(), _table(spark, sf_dir, "customer")
    g.merge_nodes(out, "Customer", "custkey", [g.project_nodes(df.where("c_nationkey < 10"), CUSTOMER)], mixed=True)
    g.merge_nodes(out, "Customer", "name", [g.project_nodes(df.where("c_nationkey >= 5"), _BY_NAME)], mixed=True)
    return out.nodes["Customer"].df


@query("job_two_keys", "SELECT c_custkey AS custkey, c_name AS name, lower(c_mktsegment) AS segment, c_acctbal AS balance FROM customer")
def _(spark, sf_dir):
    cfg = {"sources": [{"name": "customer", "type": "spark_parquet", "path": _path(sf_dir, "customer")}], "nodes": [CUSTOMER.model_dump(), _BY_NAME.model_dump()], "settings": {"output_path": f"{_scratch(spark)}/graph"}}
    run(IngestConfig.model_validate(cfg), spark=spark)
    return run(IngestConfig.model_validate(cfg), spark=spark).graph.nodes["Customer"].df


@query("job_absent_label", "SELECT 'rels:RATED' AS step, count(*) AS processed, 0::BIGINT AS written FROM orders")
def _(spark, sf_dir):
    """A relationship to a label without nodes, with an output: its records are counted, none is written."""
    rated = PLACED.model_copy(update={"rel_type": "RATED", "to_label": "Nobody"})
    cfg = job_config(sf_dir, output_path=f"{_scratch(spark)}/graph") | {"relationships": [rated.model_dump()], "post_hooks": []}
    out = run(IngestConfig.model_validate(cfg), spark=spark)
    (step,) = [s for s in out.metrics.steps if s.name == "rels:RATED"]
    return out.graph.rel("RATED").agg(F.count(F.lit(1)).alias("written")).select(F.lit(step.name).alias("step"), F.lit(step.records_processed).cast("long").alias("processed"), "written")


@query("hook_sql_keeps", "SELECT o_orderkey AS orderkey, CASE WHEN o_totalprice > 100000 THEN 'dear' ELSE o_orderstatus END AS status FROM orders")
def _(spark, sf_dir):
    """Nodes that a hook's SQL does not return keep what they have."""
    hook = SchemaHook(sql="SELECT to_val AS orderkey, 'dear' AS status FROM rel_PLACED WHERE price > 100000", label="Order")
    return run_hook(_shop(spark, sf_dir), hook, spark).nodes["Order"].df


@query("hook_absent", "SELECT o_orderkey AS orderkey, o_orderstatus AS status, NULL::BIGINT AS n FROM orders")
def _(spark, sf_dir):
    """Hooks on an empty graph, and on a relationship type that nothing has."""
    run_hook(g.PropertyGraph(), SchemaHook(sql="SELECT 1 AS one"), spark)
    out = run_hook(_shop(spark, sf_dir), SchemaHook(cypher="MATCH (o:Order)<-[r:NONE]-() WITH o, count(r) AS n SET o.n = n"), spark)
    return out.nodes["Order"].df


@query("hook_callable", "SELECT c_custkey AS custkey, 'x' AS mark FROM customer")
def _(spark, sf_dir):
    def mark(graph: g.PropertyGraph) -> None:
        nodes = graph.nodes["Customer"]
        graph.nodes["Customer"] = g.Nodes(nodes.df.withColumn("mark", F.lit("x")), nodes.key)

    return run_hook(_shop(spark, sf_dir), mark).nodes["Customer"].df.select("custkey", "mark")


# Statements for outside stores, schemas and settings

_STATED = [
    ("node", "MERGE (n:Customer {custkey: row.custkey}) SET n.name = row.name, n.segment = row.segment"),
    ("node without properties", "MERGE (n:Customer {custkey: row.custkey})"),
    ("batched", "UNWIND $rows AS row MERGE (n:Order {orderkey: row.orderkey}) SET n.status = row.status"),
    ("rel", "MATCH (a:Customer {custkey: row.from_val}) MATCH (b:Order {orderkey: row.to_val}) MERGE (a)-[r:PLACED]->(b) SET r.price = row.price, r.whole = row.whole"),
    ("event", "MERGE (n:Order {orderkey: event.orderkey}) SET n.status = event.status"),
    ("options", "authentication.basic.password=p,authentication.basic.username=u,authentication.type=basic,batch.size=7,url=bolt://localhost:7687"),
]


@query("stmt_outside", literal(_STATED))
def _(spark, sf_dir):
    options = connector_options(Connection(username="u", password="p"), 7)
    made = [node_statement(CUSTOMER), node_statement(BUYER), batched(node_statement(ORDER)), rel_statement(PLACED), node_statement(ORDER, "event"), ",".join(f"{k}={v}" for k, v in sorted(options.items()))]
    return rows(spark, zip([n for n, _ in _STATED], made, strict=True))


_SCHEMA_TEXT = [
    ("customer_custkey_unique", "CREATE CONSTRAINT customer_custkey_unique IF NOT EXISTS FOR (n:Customer) REQUIRE (n.custkey) IS UNIQUE"),
    ("customer_name_exists", "CREATE CONSTRAINT customer_name_exists IF NOT EXISTS FOR (n:Customer) REQUIRE n.name IS NOT NULL"),
    ("mine", "CREATE CONSTRAINT mine IF NOT EXISTS FOR (n:Order) REQUIRE (n.orderkey, n.status) IS NODE KEY"),
    ("idx_customer_name", "CREATE RANGE INDEX idx_customer_name IF NOT EXISTS FOR (n:Customer) ON (n.name)"),
    ("idx_order_status", "CREATE INDEX idx_order_status IF NOT EXISTS FOR (n:Order) ON (n.status)"),
    ("words", "CREATE FULLTEXT INDEX words IF NOT EXISTS FOR (n:Order) ON EACH [n.status, n.note]"),
    ("text", "CREATE TEXT INDEX text IF NOT EXISTS FOR (n:Order) ON (n.note)"),
    ("point", "CREATE POINT INDEX point IF NOT EXISTS FOR (n:Order) ON (n.place)"),
]


@query("schema_statements", literal([*_SCHEMA_TEXT, *[(f"{n} read back", t) for n, t in _SCHEMA_TEXT]]))
def _(spark, sf_dir):
    """The statements of constraints and indexes, and of what reading those statements gives."""
    constraints = [SchemaConstraint(label="Customer", property="custkey"), SchemaConstraint(label="Customer", property="name", type="exists"), SchemaConstraint(label="Order", property=["orderkey", "status"], type="node_key", name="mine")]
    indexes = [("Customer", ["name"], "range", None), ("Order", ["status"], "btree", None), ("Order", ["status", "note"], "fulltext", "words"), ("Order", ["note"], "text", "text"), ("Order", ["place"], "point", "point")]
    stated = SchemaDefinition(constraints=constraints, indexes=[SchemaIndex(label=a, properties=p, type=t, name=n) for a, p, t, n in indexes])
    made = [h.cypher for h in stated.to_hooks()]
    names = [c.constraint_name for c in stated.constraints] + [i.index_name for i in stated.indexes]
    again = [schema.parse_ddl(t).to_cypher() for t in made]
    return rows(spark, [*zip(names, made, strict=True), *zip([f"{n} read back" for n in names], again, strict=True)])


@query("schema_enforced", literal([("holds", "True"), ("broken", "customer_nationkey_unique")]))
def _(spark, sf_dir):
    graph = _shop(spark, sf_dir)
    df = graph.nodes["Customer"].df.withColumn("nationkey", F.lit(1))
    graph.nodes["Customer"] = g.Nodes(df, "custkey")
    schema.enforce(graph, SchemaDefinition(constraints=[SchemaConstraint(label="Customer", property=["custkey", "name"], type="node_key")]))
    try:
        schema.enforce(graph, SchemaDefinition(constraints=[SchemaConstraint(label="Customer", property="nationkey")]))
        text = ""
    except schema.ConstraintViolation as e:
        text = str(e).split(":")[0]
    return rows(spark, [("holds", True), ("broken", text)])


@query("cfg_environment", literal([("set", "a-b"), ("default", "x/none"), ("empty", ""), ("nested", "[{'k': 'a'}]"), ("missing", "Environment variable 'WEFT_ABSENT' is not set and has no default")]))
def _(spark, sf_dir):
    os.environ["WEFT_SET"], os.environ["WEFT_EMPTY"] = "a", ""
    try:
        resolve("${WEFT_ABSENT}")
        missing = ""
    except Exception as e:  # any error is the result
        missing = str(e)
    return rows(spark, [("set", resolve("${WEFT_SET}-b")), ("default", resolve("x/${WEFT_ABSENT:-none}")), ("empty", resolve("${WEFT_EMPTY:-full}")), ("nested", resolve([{"k": "${WEFT_SET}"}])), ("missing", missing)])


_YAML = """
unknown: {uri: "x", other: 1}
store: {uri: "bolt://h:1", username: u}
settings: {batch_size: 10, spark: {partitions: 3, some_connector_batch_size: 9}}
sources: [{name: c, type: csv, path: "${WEFT_DIR:-/data}/c.csv", delimiter: ";"}]
nodes: [{source: c, label: P, key: id, properties: [{source_field: a, target: b, transform: [{type: strip}, {type: to_int}]}]}]
schema: {constraints: [{label: P, property: id}]}
"""


@query("cfg_yaml", literal([("uri", "bolt://h:1"), ("path", "/data/c.csv"), ("chain", "strip,to_int"), ("batch", "9"), ("partitions", "3"), ("constraint", "p_id_unique"), ("unknown source", "Node mapping references unknown source 'd'"), ("no path", "CSV source requires 'path'")]))
def _(spark, sf_dir):
    def refused(**changes) -> str:
        good = {"sources": [{"name": "c", "type": "csv", "path": "p"}], "nodes": [{"source": "c", "label": "P", "key": "id"}]}
        try:
            IngestConfig.model_validate(good | changes)
        except ValueError as e:
            return next(line for line in str(e).splitlines() if "Value error" in line).split("Value error, ")[1].split(" [type")[0]
        return ""

    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # read by the driver only
        f.write(_YAML)
        f.flush()
        cfg = load_config(f.name)
    node = cfg.nodes[0]
    found = [cfg.connection.uri, cfg.sources[0].path, ",".join(t.type for t in node.properties[0].chain), cfg.settings.spark.connector_batch_size, cfg.settings.spark.partitions, cfg.graph_schema.constraints[0].constraint_name]
    names = ["uri", "path", "chain", "batch", "partitions", "constraint", "unknown source", "no path"]
    return rows(spark, zip(names, [*found, refused(nodes=[{"source": "d", "label": "P", "key": "id"}]), refused(sources=[{"name": "c", "type": "csv"}])], strict=True))


_SHEET = """source_entity,field_cardinality,source_column,data_type,is_key,transform,target_entity,target_column,relationship_type,rel_source_key,rel_target_key
emp,1:1,id,int,yes,,Person,,,,
emp,1:1,full,string,no,"strip,uppercase",Person,name,,,
emp,M:1,boss,,,,Person,,,id,id
emp,1:M,dept,,,,Dept,code,IN,id,
dept,1:1,code,,,,Dept,,,,
dept,N:M,x,,,,Other,,,,
"""


@query(
    "map_sheet_config",
    literal([("sources", "dept:dept.csv,emp:emp.csv"), ("nodes", "Person.id(id:to_int,name:strip+uppercase) Dept.code(code:)"), ("rels", "BELONGS_TO_EMP emp.id->Person.id by boss; IN emp.id->Dept.code by dept"), ("schema", "person_id_unique")]),
)
def _(spark, sf_dir):
    with tempfile.NamedTemporaryFile("w", suffix=".csv") as f:
        f.write(_SHEET)
        f.flush()
        cfg = load_csv_mapping(f.name)
    props = lambda n: ",".join(f"{p.target_name}:{'+'.join(t.type for t in p.chain)}" for p in n.properties)
    nodes = " ".join(f"{n.label}.{n.key}({props(n)})" for n in cfg.nodes)
    rels = "; ".join(f"{r.rel_type} {r.from_label}.{r.from_key}->{r.to_label}.{r.to_key} by {r.from_field}" for r in cfg.relationships)
    return rows(spark, [("sources", ",".join(f"{s.name}:{s.path}" for s in cfg.sources)), ("nodes", nodes), ("rels", rels), ("schema", ",".join(c.constraint_name for c in cfg.graph_schema.constraints))])


@query("map_kg_graph", "SELECT 'IN' AS rel, substr(sha256(concat_ws(':', n_name)), 1, 16) AS from_val, CAST(r_regionkey AS VARCHAR) AS to_val FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    """Generated ids as endpoints, a key named by its property, and a relationship between the two."""
    raw = {
        "idGeneration": {},
        "nodes": [
            {"label": "Nation", "source": "nations", "naturalKey": ["n_name"], "properties": {"name": "n_name"}},
            {"label": "Region", "source": "region", "properties": {"regionkey": {"sourceField": "r_regionkey", "required": True, "type": "string", "transforms": ["to_string"]}, "name": "r_name"}},
        ],
        "relationships": [{"type": "IN", "source": "nations", "fromNode": "Nation", "fromField": "id", "toNode": "Region", "toKey": "regionkey", "toField": "region"}],
    }
    names = F.substring(F.sha2(F.col("n_name"), 256), 1, 16)
    _table(spark, sf_dir, "nation").select("n_name", names.alias("id"), F.col("n_regionkey").cast("string").alias("region")).createOrReplaceTempView("weft_nations")
    sources = [{"name": "nations", "type": "spark_table", "query": "SELECT * FROM weft_nations"}, {"name": "region", "type": "spark_parquet", "path": _path(sf_dir, "region")}]
    cfg = from_dict(raw, sources=sources)
    return run(cfg, spark=spark).graph.rel("IN").select(F.lit("IN").alias("rel"), "from_val", "to_val")


# Running


def _attempts(fails: int, **options) -> str:
    made = []

    def act() -> str:
        made.append(1)
        if len(made) <= fails:
            raise TransientError("not yet")
        return "done"

    try:
        return f"{retry(act, base_delay=0.0, **options)} after {len(made)}"
    except MaxRetriesExceeded as e:
        return str(e)
    except TransientError:
        return f"passed on after {len(made)}"


@query("run_retries", literal([("third", "done after 3"), ("never", "Failed after 3 attempts: not yet"), ("other error", "passed on after 1"), ("breaker", "closed open refused closed"), ("health", "True False")]))
def _(spark, sf_dir):
    breaker, states = CircuitBreaker(failure_threshold=2, recovery_timeout=0.05), []

    def attempt(fails: bool) -> None:
        try:
            breaker.call(lambda: 1 / 0 if fails else 1)
        except (ZeroDivisionError, CircuitBreakerOpen) as e:
            states.append("refused" if isinstance(e, CircuitBreakerOpen) else breaker.state.value)
        else:
            states.append(breaker.state.value)

    import time

    for fails in (True, True, False):
        attempt(fails)
    time.sleep(0.06)
    attempt(False)
    checks = f"{healthy(lambda: 1)} {healthy(lambda: 1 / 0)}"
    return rows(spark, [("third", _attempts(2)), ("never", _attempts(9)), ("other error", _attempts(9, retryable_exceptions=(OSError,))), ("breaker", " ".join(states)), ("health", checks)])


@query("job_metrics_file", literal([("keys", "config_path,duration_seconds,errors,job_id,status,steps,total_records_failed,total_records_processed"), ("step keys", "duration_seconds,error,name,records_failed,records_per_second,records_processed,status"), ("status", "completed"), ("steps", "source:customer,source:orders,schema,nodes:Customer,nodes:Order,constraints,rels:PLACED,post_hooks"), ("failed", "failed: None,failed")]))
def _(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file
        path = f"{folder}/m.json"
        run(IngestConfig.model_validate(job_config(sf_dir, metrics_output=path)), spark=spark)
        with open(path) as f:
            good = json.load(f)
        bad = job_config(sf_dir, metrics_output=path, continue_on_source_error=False)
        bad["sources"][1] = {"name": "orders", "type": "no_such_type"}
        try:
            run(IngestConfig.model_validate(bad), spark=spark)
        except ValueError:
            pass
        with open(path) as f:
            lost = json.load(f)
    step = good["steps"][0]
    return rows(spark, [("keys", ",".join(sorted(good))), ("step keys", ",".join(sorted(step))), ("status", good["status"]), ("steps", ",".join(s["name"] for s in good["steps"])), ("failed", f"{lost['status']}: {lost['steps'][0]['error']},{lost['steps'][1]['status']}")])


@query("job_dry_run", "SELECT 'source:customer' AS step, (SELECT count(*) FROM customer) AS processed, 0::BIGINT AS failed UNION ALL SELECT 'source:orders', (SELECT count(*) FROM orders), 0 UNION ALL SELECT unnest(['validate:orders', 'validate:orders']), (SELECT count(*) FROM orders WHERE NOT o_totalprice > 200000), (SELECT count(*) FROM orders WHERE o_totalprice > 200000)")
def _(spark, sf_dir):
    out = run(IngestConfig.model_validate(job_config(sf_dir)), dry_run=True, spark=spark)
    return spark.createDataFrame([(s.name, s.records_processed, s.records_failed) for s in out.metrics.steps], "step string, processed long, failed long")


@query("job_result", "SELECT * FROM (VALUES ('skipped', 2 * (SELECT count(*) FROM orders WHERE o_totalprice > 200000)), ('nodes', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders WHERE NOT o_totalprice > 200000)), ('rels', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 200000)), ('dead letters', (SELECT count(*) FROM orders WHERE o_totalprice > 200000)), ('dangling', 0)) AS t(name, n)")
def _(spark, sf_dir):
    out = run(IngestConfig.model_validate(job_config(sf_dir, parallel_sources=True)), spark=spark)
    found = [("skipped", out.records_skipped), ("nodes", out.total_nodes), ("rels", out.total_relationships), ("dead letters", out.dead_letters["nodes:Order"].count()), ("dangling", out.dangling["rels:PLACED"].count())]
    return spark.createDataFrame(found, "name string, n long")


@query("vr_builder", "SELECT o_orderkey FROM orders WHERE o_totalprice <= 200000 AND o_orderstatus IN ('F', 'O')")
def _(spark, sf_dir):
    """Rules as a configuration holds them; an unknown rule passes."""
    cfg = ValidationConfig.model_validate({"rules": [{"field": "o_totalprice", "rule": "max", "params": {"value": 200000}}, {"field": "o_orderstatus", "rule": "one_of", "params": {"values": ["F", "O"]}}, {"field": "o_orderstatus", "rule": "no_such_rule"}]})
    return apply_rules(_table(spark, sf_dir, "orders"), cfg.rules).valid.select("o_orderkey")
