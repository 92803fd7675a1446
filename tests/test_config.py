"""Configuration, its front-ends, and the control plane."""

import json

import pytest

from weftgraph.cli import main
from weftgraph.config import IngestConfig, NodeMapping, PropertyMapping, SchemaConstraint, SchemaDefinition, SchemaIndex, SourceConfig, load_config
from weftgraph.env import MissingEnvironmentVariable, resolve
from weftgraph.metrics import JobMetrics
from weftgraph.plans.csv_mapping import load_csv_mapping
from weftgraph.plans.kg_schema import from_dict, is_kg_schema
from weftgraph.resilience import CircuitBreaker, CircuitBreakerOpen, CircuitState, MaxRetriesExceeded, healthy, retry

SHEET = """source_entity,field cardinality,source_column,data_type,is_key,transform,target_entity,target_column,relationship_type,rel_source_key,rel_target_key
people,1:1,id,int,true,,Person,,,,
people,1:1,full_name,string,no,"strip,uppercase",Person,name,,,
people,1:m,dept,,,,Department,code,,id,code
people,M:1,boss,,,,Person,,,,
people,2:2,odd,,,,X,,,,
depts,1:1,code,,,,,,,,
,1:1,lost,,,,,,,,
"""


def minimal(**more):
    return {"sources": [{"name": "s", "type": "csv", "path": "s.csv"}], "nodes": [{"source": "s", "label": "A", "key": "id", "properties": [{"source_field": "id"}]}]} | more


def test_defaults_and_references():
    cfg = IngestConfig.model_validate(minimal())
    assert cfg.settings.batch_size == 500 and cfg.settings.execution_mode == "standard" and cfg.connection.uri == "bolt://localhost:7687"
    with pytest.raises(ValueError, match="unknown source 'x'"):
        IngestConfig.model_validate(minimal(nodes=[{"source": "x", "label": "A", "key": "id"}]))
    two = IngestConfig.model_validate(minimal(nodes=[{"source": "s", "label": "A", "key": "a"}, {"source": "s", "label": "A", "key": "b"}]))
    assert [n.key for n in two.nodes] == ["a", "b"]
    assert PropertyMapping(source_field="a", target="").target_name == "a"
    store = IngestConfig.model_validate(minimal(somestore={"uri": "bolt://db", "username": "me"}, settings={"spark": {"somestore_connector_batch_size": 9}}))
    assert store.connection.uri == "bolt://db" and store.settings.spark.connector_batch_size == 9
    other = IngestConfig.model_validate(minimal(warehouse={"uri": "x://y", "schema": "z"}, note={"username": "me"}, settings={"spark": {"my_own_connector_batch_size": 9, "other": 1}}))
    assert other.connection.uri == "bolt://localhost:7687" and other.settings.spark.connector_batch_size == 5000  # unknown keys are ignored


@pytest.mark.parametrize("kind", ["csv", "json", "sql", "rest"])
def test_required_fields(kind):
    with pytest.raises(ValueError, match=f"{kind.upper()} source requires"):
        SourceConfig(name="s", type=kind)


def test_env(monkeypatch, tmp_path):
    monkeypatch.setenv("WEFT_A", "x")
    monkeypatch.setenv("WEFT_E", "")
    assert resolve({"a": ["${WEFT_A}-${WEFT_B:-d}", 3], "e": "${WEFT_E:-no}"}) == {"a": ["x-d", 3], "e": ""}
    with pytest.raises(MissingEnvironmentVariable):
        resolve("${WEFT_NONE}")
    for name, text in (("a.yaml", "sources: [{name: '${WEFT_A}', type: csv, path: p}]\nnodes: []"), ("a.json", json.dumps(minimal())), ("a.conf", json.dumps(minimal()))):
        (tmp_path / name).write_text(text)
        assert load_config(tmp_path / name).sources[0].name in ("x", "s")


def test_ddl():
    c = SchemaConstraint(label="Person", property=["a", "b"])
    assert c.to_cypher() == "CREATE CONSTRAINT person_a_b_unique IF NOT EXISTS FOR (n:Person) REQUIRE (n.a, n.b) IS UNIQUE"
    assert SchemaConstraint(label="P", property="a", type="exists", name="k").to_cypher() == "CREATE CONSTRAINT k IF NOT EXISTS FOR (n:P) REQUIRE n.a IS NOT NULL"
    assert SchemaConstraint(label="P", property="a", type="node_key").to_cypher().endswith("REQUIRE (n.a) IS NODE KEY")
    assert SchemaIndex(label="P", properties=["a"]).to_cypher() == "CREATE RANGE INDEX idx_p_a IF NOT EXISTS FOR (n:P) ON (n.a)"
    assert SchemaIndex(label="P", properties=["a"], type="btree").to_cypher().startswith("CREATE INDEX idx_p_a ")
    assert SchemaIndex(label="P", properties=["a", "b"], type="fulltext").to_cypher().endswith("ON EACH [n.a, n.b]")
    hooks = SchemaDefinition(indexes=[SchemaIndex(label="P", properties=["a"])], constraints=[c]).to_hooks()
    assert [h.description.split()[0] for h in hooks] == ["unique", "range"]


def test_ddl_is_read_back():
    from weftgraph.operators.schema import parse_ddl

    for c in (SchemaConstraint(label="P", property=["a", "b"]), SchemaConstraint(label="P", property=["a"], type="exists"), SchemaConstraint(label="P", property=["a"], type="node_key", name="k")):
        got = parse_ddl(c.to_cypher())
        assert (got.label, got.properties, got.type, got.constraint_name) == (c.label, c.properties, c.type, c.constraint_name)
    for i in (SchemaIndex(label="P", properties=["a", "b"]), SchemaIndex(label="P", properties=["a"], type="btree"), SchemaIndex(label="P", properties=["a"], type="fulltext")):
        got = parse_ddl(i.to_cypher())
        assert (got.label, got.properties, got.type, got.index_name) == (i.label, i.properties, i.type, i.index_name)
    assert parse_ddl("CREATE CONSTRAINT IF NOT EXISTS FOR (p:P) REQUIRE p.a IS UNIQUE").constraint_name == "p_a_unique"
    assert parse_ddl("MATCH (n) RETURN n") is None


def test_sheet(tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(SHEET)
    cfg = load_csv_mapping(path)
    assert [(n.source, n.label, n.key) for n in cfg.nodes] == [("people", "Person", "id"), ("depts", "depts", "code")]
    name = cfg.nodes[0].properties[1]
    assert name.target_name == "name" and [t.type for t in name.chain] == ["strip", "uppercase"]
    assert [t.type for t in cfg.nodes[0].properties[0].chain] == ["to_int"]
    has, belongs = cfg.relationships
    assert (has.rel_type, has.from_label, has.from_key, has.from_field, has.to_label, has.to_key, has.to_field) == ("HAS_DEPARTMENT", "people", "id", "dept", "Department", "code", "dept")
    assert belongs.rel_type == "BELONGS_TO_PEOPLE"
    assert [s.path for s in cfg.sources] == ["depts.csv", "people.csv"]
    assert [c.properties for c in cfg.graph_schema.constraints] == [["id"]]
    assert load_csv_mapping(path, auto_schema=False).graph_schema is None
    assert len(load_config(path).nodes) == 2


KG = {
    "$id": "x",
    "idGeneration": {"strategy": "sha256-hash", "hashLength": 12, "separator": "|"},
    "sourceDefinitions": {"main": {"dataFormat": "CSV files", "examples": ["m.csv"]}, "other": {}},
    "nodes": [
        {"label": "Person", "naturalKey": ["full_name"], "properties": {"name": "full_name", "age": {"type": "integer", "transforms": ["to_string"]}}},
        {"label": "City", "source": "other", "properties": {"a": {}, "code": {"required": True, "sourceField": "c"}}},
    ],
    "relationships": [{"type": "LIVES", "fromNode": "Person", "to_label": "City", "toKey": "code", "properties": {"since": "s"}}],
}


def test_kg_schema(tmp_path):
    assert is_kg_schema(KG) and not is_kg_schema(minimal()) and is_kg_schema({"nodes": [{"label": "A", "properties": {}}]})
    cfg = from_dict(KG)
    person, city = cfg.nodes
    assert (person.key, person.source, person.id_generation.fields, person.id_generation.hash_length) == ("_id", "main", ["full_name"], 12)
    assert [t.type for t in person.properties[1].chain] == ["to_int", "to_string"]
    assert (city.key, city.source, city.id_generation) == ("code", "other", None)
    r = cfg.relationships[0]
    assert (r.from_key, r.from_field, r.to_label, r.to_key, r.to_field, r.properties[0].source_field) == ("_id", "_id", "City", "code", "code", "s")
    assert [(s.name, s.type, s.path) for s in cfg.sources] == [("main", "csv", "m.csv"), ("other", "json", "other_data.json")]
    assert len(cfg.graph_schema.constraints) == len(cfg.graph_schema.indexes) == 2
    (tmp_path / "k.json").write_text(json.dumps(KG))
    assert load_config(tmp_path / "k.json").nodes[0].label == "Person"


def test_retry_and_breaker():
    tried = []

    def fails(until):
        tried.append(1)
        if len(tried) < until:
            raise OSError("no")
        return "ok"

    assert retry(fails, 3, base_delay=0) == "ok" and len(tried) == 3
    with pytest.raises(MaxRetriesExceeded) as e:
        retry(fails, 99, max_attempts=2, base_delay=0)
    assert e.value.attempts == 2
    with pytest.raises(ZeroDivisionError):
        retry(lambda: 1 / 0, retryable_exceptions=(OSError,))
    b = CircuitBreaker(failure_threshold=2, recovery_timeout=0.0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    assert b.state is CircuitState.OPEN
    assert b.call(lambda: 5) == 5 and b.state is CircuitState.CLOSED
    b = CircuitBreaker(1, 60)
    with pytest.raises(ZeroDivisionError):
        b.call(lambda: 1 / 0)
    with pytest.raises(CircuitBreakerOpen):
        b.call(lambda: 5)
    assert healthy(lambda: 1) and not healthy(lambda: 1 / 0)


def test_metrics():
    m = JobMetrics()
    with m.step("a") as s:
        s.records_processed, s.records_failed = 5, 1
    with pytest.raises(ValueError), m.step("b"):
        raise ValueError("boom")
    d = json.loads(m.to_json())
    assert [x["status"] for x in d["steps"]] == ["completed", "failed"] and d["steps"][1]["error"] == "boom"
    assert d["total_records_processed"] == 5 and d["total_records_failed"] == 1 and len(d["job_id"]) == 12


def test_cli_validate(tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps(minimal()))
    assert main(["validate", str(tmp_path / "a.json")]) == 0
    assert "Node mappings: 1" in capsys.readouterr().out
    (tmp_path / "b.json").write_text("{}")
    assert main(["validate", str(tmp_path / "b.json")]) == 1
    assert NodeMapping(source="s", label="A", key="k").properties == []
