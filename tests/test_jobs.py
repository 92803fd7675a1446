"""Sources, merges, hooks, whole jobs and streams on a real session."""

import json

import pytest
from weftgraph.cli import main
from weftgraph.config import IngestConfig, NodeMapping, PropertyMapping, RelationshipMapping, SchemaConstraint, SchemaHook, SourceConfig
from weftgraph.operators import graph as g
from weftgraph.operators.hooks import run_hook
from weftgraph.operators.schema import violations
from weftgraph.plans.engine import run
from weftgraph.registry import source_registry
from weftgraph.sources import read_source
from weftgraph.sources.jdbc import jdbc_url
from weftgraph.sources.rest import RateLimiter, at_root
from weftgraph.streaming.merge import merge_stream, windowed_counts

EMPLOYEES = 'emp_id,name,email,title,dept_id\n1, Ann ,ANN@X.ORG,Dev,10\n2,Bob,bob@x.org,"Senior ""Dev""",20\n3,Cy,broken,Ops,10\n\n4,Di,di@x.org,,99\n'
DEPARTMENTS = "dept_id,dept_name\n10,Engineering\n20,Product\n"


def job(tmp_path, **more):
    (tmp_path / "e.csv").write_text(EMPLOYEES)
    (tmp_path / "d.csv").write_text(DEPARTMENTS)
    to_int = {"type": "to_int"}
    return {
        "sources": [{"name": "e", "type": "csv", "path": str(tmp_path / "e.csv")}, {"name": "d", "type": "csv", "path": str(tmp_path / "d.csv")}],
        "nodes": [
            {
                "source": "e",
                "label": "Person",
                "key": "emp_id",
                "properties": [{"source_field": "emp_id", "transform": to_int}, {"source_field": "name", "transform": {"type": "strip"}}, {"source_field": "email", "transform": {"type": "lowercase"}}, {"source_field": "phone"}],
                "validation": {"rules": [{"field": "email", "rule": "regex", "params": {"pattern": "^[^@]+@[^@]+$"}}], "on_error": "dead_letter"},
            },
            {"source": "d", "label": "Department", "key": "dept_id", "properties": [{"source_field": "dept_id", "transform": to_int}, {"source_field": "dept_name", "target": "name"}]},
        ],
        "relationships": [{"source": "e", "rel_type": "WORKS_IN", "from_label": "Person", "from_key": "emp_id", "from_field": "emp_id", "to_label": "Department", "to_key": "dept_id", "to_field": "dept_id", "properties": [{"source_field": "title"}]}],
        "post_hooks": [{"cypher": "MATCH (d:Department) SET d.employees = size([(p)-[:WORKS_IN]->(d) | p])"}, {"cypher": "MATCH (n) DETACH DELETE n"}],
    } | more


def test_employees(spark, tmp_path):
    cfg = job(tmp_path, settings={"coerce_endpoints": True, "metrics_output": str(tmp_path / "m.json"), "parallel_sources": True})
    out = run(IngestConfig.model_validate(cfg), spark=spark)
    people = {r.emp_id: r for r in out.graph.nodes["Person"].df.collect()}
    assert set(people) == {1, 2, 4} and people[1].name == "Ann" and people[1].email == "ann@x.org" and people[1].phone is None
    assert out.nodes_created == {"Person": 3, "Department": 2} and out.records_skipped == 1 and out.relationships_created == {"WORKS_IN": 4}
    assert {(r.from_val, r.to_val, r.title) for r in out.graph.rel("WORKS_IN").collect()} == {("1", "10", "Dev"), ("2", "20", 'Senior "Dev"')}
    assert {(r.from_val, r.to_val) for r in out.dangling["rels:WORKS_IN"].collect()} == {("3", "10"), ("4", "99")}
    assert [r.record.emp_id for r in out.dead_letters["nodes:Person"].collect()] == ["3"]
    metrics = json.loads((tmp_path / "m.json").read_text())
    assert metrics["status"] == "completed" and {s["name"] for s in metrics["steps"]} >= {"source:e", "nodes:Person", "rels:WORKS_IN", "post_hooks"}


def test_strict_endpoints_and_degree(spark, tmp_path):
    out = run(IngestConfig.model_validate(job(tmp_path)), spark=spark)  # text endpoints never match integer keys
    assert out.graph.rel("WORKS_IN").count() == 0
    assert {r.name: r.employees for r in out.graph.nodes["Department"].df.collect()} == {"Engineering": 0, "Product": 0}


def test_output_is_merged_again(spark, tmp_path):
    cfg = job(tmp_path, settings={"output_path": str(tmp_path / "out"), "coerce_endpoints": True}, schema={"constraints": [{"label": "Person", "property": "emp_id"}], "indexes": [{"label": "Person", "properties": ["name"]}]})
    cfg = IngestConfig.model_validate(cfg)
    first = run(cfg, spark=spark)
    assert first.nodes_merged["Person"] == 3 and first.nodes_created == {"Person": 3, "Department": 2} and first.relationships_created == {"WORKS_IN": 4} and first.records_skipped == 1
    assert {r.from_val for r in first.dangling["rels:WORKS_IN"].collect()} == {"3", "4"}
    assert {r.name: r.employees for r in first.graph.nodes["Department"].df.collect()} == {"Engineering": 1, "Product": 1}
    (tmp_path / "e.csv").write_text("emp_id,name,email,title,dept_id\n1,Anna,a@x.org,CTO,10\n7,New,n@x.org,Dev,20\n")
    again = run(cfg, spark=spark)
    assert {(r.emp_id, r.name) for r in again.graph.nodes["Person"].df.collect()} == {(1, "Anna"), (2, "Bob"), (4, "Di"), (7, "New")}
    assert {(r.from_val, r.title) for r in again.graph.rel("WORKS_IN").collect()} == {("1", "CTO"), ("2", 'Senior "Dev"'), ("7", "Dev")}


def test_failures(spark, tmp_path):
    bad = job(tmp_path)
    bad["nodes"][0]["validation"]["on_error"] = "fail"
    bad["settings"] = {"metrics_output": str(tmp_path / "m.json")}
    with pytest.raises(ValueError, match="Validation failed at record"):
        run(IngestConfig.model_validate(bad), spark=spark)
    assert json.loads((tmp_path / "m.json").read_text())["status"] == "failed"
    lost = job(tmp_path)
    lost["sources"][1]["path"] = str(tmp_path / "none.csv")
    lost["settings"] = {"continue_on_source_error": True}
    out = run(IngestConfig.model_validate(lost), spark=spark)
    assert out.nodes_created == {"Person": 3, "Department": 0} and out.metrics.errors
    broken = job(tmp_path, schema={"constraints": [{"label": "Person", "property": "phone", "type": "exists"}]})
    with pytest.raises(ValueError, match="person_phone_exists"):
        run(IngestConfig.model_validate(broken), spark=spark)


def test_schema_statements_in_hooks_are_checked(spark, tmp_path):
    hook = {"cypher": "CREATE CONSTRAINT IF NOT EXISTS FOR (p:Person) REQUIRE p.phone IS NOT NULL"}
    with pytest.raises(ValueError, match="person_phone_exists"):
        run(IngestConfig.model_validate(job(tmp_path, pre_hooks=[hook])), spark=spark)


def test_external_sink(spark, tmp_path, monkeypatch):
    from weftgraph.plans import engine

    sent = []
    monkeypatch.setattr(engine, "write_external", lambda df, statement, fmt, *_: sent.append((sorted(df.columns), statement[:14], fmt)))
    run(IngestConfig.model_validate(job(tmp_path, settings={"external_format": "some.Connector"})), spark=spark)
    assert sent == [(["email", "emp_id", "name", "phone"], "MERGE (n:Perso", "some.Connector"), (["dept_id", "name"], "MERGE (n:Depar", "some.Connector"), (["from_val", "title", "to_val"], "MATCH (a:Perso", "some.Connector")]


def test_dry_run_and_cli(spark, tmp_path, capsys):
    (tmp_path / "j.json").write_text(json.dumps(job(tmp_path)))
    out = run(IngestConfig.model_validate(job(tmp_path)), dry_run=True, spark=spark)
    assert [(s.name, s.records_processed, s.records_failed) for s in out.metrics.steps] == [("source:e", 4, 0), ("source:d", 2, 0), ("validate:e", 3, 1)]
    assert main(["run", str(tmp_path / "j.json"), "--metrics-output", str(tmp_path / "x.json")]) == 0
    assert "Nodes [Person]: 3" in capsys.readouterr().out and (tmp_path / "x.json").exists()
    assert main(["dry-run", str(tmp_path / "j.json")]) == 0
    assert "source:e: 4 records" in capsys.readouterr().out


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl).coalesce(1)


def test_merge_is_last_assignment_of_owners(spark):
    a = rows(spark, [(1, "x", 1.0), (1, None, 2.0), (2, "y", 3.0), (None, "z", 4.0)], "k int, p string, q double")
    b = rows(spark, [(1, 9), (3, 8)], "k int, r int")
    got = {r.k: (r.p, r.q, r.r) for r in g.merge([a, b], ["k"]).collect()}
    assert got == {1: (None, 2.0, 9), 2: ("y", 3.0, None), 3: (None, None, 8)}
    over = {r.k: r.p for r in g.merge([a.select("k", "p"), rows(spark, [(2, None)], "k int, p string")], ["k"]).collect()}
    assert over == {1: None, 2: None}
    assert g.merge([a.select("k")], ["k"]).count() == 2
    mixed = {r.k: r.p for r in g.merge([rows(spark, [(1, 5)], "k int, p int"), rows(spark, [(2, "t")], "k int, p string")], ["k"]).collect()}
    assert mixed == {1: "5", 2: "t"}


def test_relationships_match_every_node_of_a_property(spark):
    out = g.PropertyGraph()
    person = NodeMapping(source="s", label="P", key="id", properties=[PropertyMapping(source_field="id"), PropertyMapping(source_field="team")])
    df = rows(spark, [(1, "a"), (2, "a"), (3, "b")], "id int, team string")
    g.merge_nodes(out, "P", "id", [g.project_nodes(g.with_sequence(df), person)])
    m = RelationshipMapping(source="s", rel_type="IN", from_label="P", from_key="id", from_field="id", to_label="P", to_key="team", to_field="team")
    matched = g.matched(g.project_rels(df, m), out, m)
    assert matched.count() == 5  # a is the team of two nodes
    nobody = m.model_copy(update={"to_label": "Nobody"})
    assert g.matched(g.project_rels(df, nobody), out, nobody).count() == 0
    assert g.dangling_rels(out, nobody, g.project_rels(df, nobody)).count() == 3


def test_constraints(spark):
    df = rows(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, v string")
    v = lambda **c: violations(df, SchemaConstraint(label="L", **c)).count()
    assert (v(property="k"), v(property=["k", "v"]), v(property="k", type="exists"), v(property="v", type="node_key"), v(property=["k", "v"], type="node_key"), v(property="w", type="exists")) == (1, 0, 2, 1, 1, 4)


def test_hooks(spark):
    out = g.PropertyGraph(nodes={"P": g.Nodes(rows(spark, [(1, 0), (2, 7)], "id int, old int"), "id")}, rels={("B", "P", "P"): rows(spark, [(1, 2, 4.0), (2, 2, None)], "from_val int, to_val int, w double")})
    get = lambda c: {r.id: r[c] for r in out.nodes["P"].df.collect()}
    run_hook(out, SchemaHook(cypher="MATCH (p:P)<-[r:B]-() WITH p, count(r) AS n SET p.n = n"))
    assert get("n") == {1: None, 2: 2}
    run_hook(out, SchemaHook(cypher="MATCH (p:P)<-[x:B]-() WITH p, avg(x.w) AS m SET p.m = m"))
    assert get("m") == {1: None, 2: 4.0}
    run_hook(out, SchemaHook(cypher="MATCH (p:P) SET p.d = size([(p)-[:B]->(q) | q])"))
    assert get("d") == {1: 1, 2: 1}
    run_hook(out, SchemaHook(cypher="MATCH (p:P) SET p.i = size([(q)-[:B]->(p) | q])"))
    assert get("i") == {1: 0, 2: 2}
    run_hook(out, SchemaHook(sql="SELECT id, old + 1 AS old FROM node_P", label="P"))
    assert get("old") == {1: 1, 2: 8}
    run_hook(out, lambda gr: None)


def test_sql_hooks_keep_what_they_do_not_return(spark):
    def graph():
        nodes = rows(spark, [(1, "a"), (2, "b"), (3, "c")], "id int, tag string")
        return g.PropertyGraph(nodes={"P": g.Nodes(nodes, "id")}, rels={("B", "P", "P"): rows(spark, [(1, 2)], "from_val int, to_val int")})

    tags = lambda out: {r.id: r.tag for r in out.nodes["P"].df.collect()}
    assert tags(run_hook(graph(), SchemaHook(sql="SELECT from_val AS id, 'x' AS tag FROM rel_B", label="P"), spark)) == {1: "x", 2: "b", 3: "c"}
    assert tags(run_hook(graph(), SchemaHook(sql="SELECT id, CAST(NULL AS STRING) AS tag FROM node_P WHERE id = 2", label="P"), spark)) == {1: "a", 2: None, 3: "c"}
    assert tags(run_hook(graph(), SchemaHook(sql="SELECT id, id * 10 AS tag FROM node_P WHERE id = 3", label="P"), spark)) == {1: "a", 2: "b", 3: "30"}
    with pytest.raises(Exception, match="several rows for 1"):
        tags(run_hook(graph(), SchemaHook(sql="SELECT 1 AS id, 'x' AS tag UNION ALL SELECT 1, 'y'", label="P"), spark))
    with pytest.raises(ValueError, match="must return its key"):
        run_hook(graph(), SchemaHook(sql="SELECT 'x' AS tag", label="P"), spark)
    empty = g.PropertyGraph()
    run_hook(empty, SchemaHook(sql="SELECT 1 AS id", label="P"), spark)
    assert empty.nodes == {}
    for text in ("WITH p, count(r) AS n SET p.n = n", "WITH p, avg(r.w) AS n SET p.n = n"):
        out = run_hook(graph(), SchemaHook(cypher=f"MATCH (p:P)<-[r:NONE]-() {text}"), spark)
        assert {r.n for r in out.nodes["P"].df.collect()} == {None}


def test_relationship_to_an_absent_label(spark, tmp_path):
    cfg = job(tmp_path, settings={"output_path": str(tmp_path / "out"), "coerce_endpoints": True})
    cfg["relationships"].append(cfg["relationships"][0] | {"rel_type": "LIKES", "to_label": "Nobody"})
    cfg["relationships"].append(cfg["relationships"][0] | {"rel_type": "KNOWS", "validation": {"rules": [{"field": "title", "rule": "required"}]}, "from_label": "Nobody"})
    for _ in range(2):
        out = run(IngestConfig.model_validate(cfg), spark=spark)
        assert out.relationships_created == {"WORKS_IN": 4, "LIKES": 4, "KNOWS": 3} and out.records_skipped == 2
        assert (out.graph.rel("LIKES").count(), out.graph.rel("KNOWS").count(), out.graph.rel("WORKS_IN").count()) == (0, 0, 2)
        assert out.dangling["rels:LIKES"].count() == 4


def test_label_merged_by_two_keys(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,mail\n1,a@x\n2,b@x\n,z@x\n")
    (tmp_path / "b.csv").write_text("mail,team\nb@x,red\nc@x,blue\nb@x,green\n")
    props = lambda *names: [{"source_field": n} for n in names]
    cfg = {
        "sources": [{"name": n, "type": "csv", "path": str(tmp_path / f"{n}.csv")} for n in "ab"],
        "nodes": [{"source": "a", "label": "P", "key": "id", "properties": props("id", "mail")}, {"source": "b", "label": "P", "key": "mail", "properties": props("mail", "team")}],
        "relationships": [{"source": "b", "rel_type": "SAME", "from_label": "P", "from_key": "mail", "from_field": "mail", "to_label": "P", "to_key": "id", "to_field": "team"}],
    }
    want = {("1", "a@x", None), ("2", "b@x", "green"), ("", "z@x", None), (None, "c@x", "blue")}
    got = lambda out: {(r.id, r.mail, r.team) for r in out.graph.nodes["P"].df.collect()}
    assert got(run(IngestConfig.model_validate(cfg), spark=spark)) == want
    cfg["settings"] = {"output_path": str(tmp_path / "out")}
    for _ in range(2):  # a second run finds its own nodes
        out = run(IngestConfig.model_validate(cfg), spark=spark)
        assert got(out) == want and out.graph.nodes["P"].df.count() == 4


def test_record_index_is_the_place_in_the_source(spark, tmp_path):
    from weftgraph.config import ValidationConfig
    from weftgraph.operators.validation import validate

    n = 0
    for name, size in (("c", 40), ("a", 500), ("b", 3)):
        spark.range(size).selectExpr("cast(id as int) as k", f"'{name}' as file").coalesce(1).write.parquet(str(tmp_path / "tmp" / name))
        next((tmp_path / "tmp" / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    df = spark.read.parquet(str(tmp_path / "*.parquet"))
    before = {"a": 0, "b": 500, "c": 503}  # by file name, whatever the order in which splits are dealt
    rules = lambda e: ValidationConfig(rules=[{"field": "k", "rule": "max", "params": {"value": 1}}], on_error=e)
    for source in (df, df.select("k", "file")):
        found = validate(source, rules("dead_letter")).rejects().collect()
        assert len(found) == 498 + 1 + 38
        assert all(r.record_index == before[r.record.file] + r.record.k for r in found)
    with pytest.raises(ValueError, match="failed at record 2:"):
        validate(df, rules("fail"))
    made = spark.range(100).repartition(7, "id").selectExpr("cast(id as int) as k")  # no files: in the order of partitions
    order = [r.k for r in made.collect()]
    found = validate(made, rules("dead_letter")).rejects().collect()
    assert {r.record_index: r.record.k for r in found} == {i: k for i, k in enumerate(order) if k > 1}
    assert n == 0


def test_csv_files_are_split_where_lines_are_records(spark, tmp_path):
    from weftgraph.sources.files import splittable

    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    plain = "a,b\n" + "".join(f'{i},"x ""{i}"", y"\n' for i in range(3000))
    texts = {"plain": plain, "broken": plain + '7,"line\nbreak"\n', "blank": plain + "  \n", "short": "a,b\n1,2\n"}
    try:
        spark.conf.set(size, "10000")
        for name, text in texts.items():
            (tmp_path / f"{name}.csv").write_text(text)
            cfg = SourceConfig(name="s", type="csv", path=str(tmp_path / f"{name}.csv"))
            assert splittable(spark, cfg) == (name == "plain")
            df = read_source(spark, cfg)
            assert (df.rdd.getNumPartitions() > 1) == (name == "plain")
            if name == "plain":
                assert sorted((r.a, r.b) for r in df.collect()) == sorted((str(i), f'x "{i}", y') for i in range(3000))
            if name == "broken":
                assert df.where("a = '7'").collect()[-1].b == "line\nbreak"
    finally:
        spark.conf.set(size, before)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b;c\n1;"x;""y""\nz";\n\n2;;""\n')
    read = lambda **c: [tuple(r) for r in read_source(spark, SourceConfig(name="s", **c)).collect()]
    assert read(type="csv", path=str(tmp_path / "a.csv"), delimiter=";") == [("1", 'x;"y"\nz', ""), ("2", "", "")]
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "n.json").write_text('{"data": {"rows": [{"id": 1}], "one": {"id": 3}}}')
    assert read(type="json", path=str(tmp_path / "a.json")) == [(1,), (2,)]
    assert read(type="json", path=str(tmp_path / "n.json"), json_root="data.rows") == [(1,)]
    assert read(type="csv", path=str(tmp_path / "a.csv"), delimiter=";", limit=1)[0][0] == "1"
    with pytest.raises(ValueError, match="not a list"):
        read(type="json", path=str(tmp_path / "n.json"), json_root="data.one")
    with pytest.raises(KeyError):
        read(type="json", path=str(tmp_path / "n.json"), json_root="data.no")
    with pytest.raises(ValueError, match="Unknown source type"):
        read(type="nope")
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert read(type="json", path=str(tmp_path / "l.jsonl")) == read(type="spark_json", path=str(tmp_path / "l.jsonl")) == [(1,), (2,)]
    source_registry.register("list_for_test")(lambda spark, cfg: [{"a": 1, "b": None}, {"a": 2}])
    assert read(type="list_for_test") == [(1, None), (2, None)]


def test_rest_parts_and_urls():
    assert at_root({"a": [{"b": [1]}]}, "a.0.b") == [1]
    with pytest.raises(ValueError):
        at_root({"a": 1}, "a")
    limiter = RateLimiter(1000, 2)
    for _ in range(4):
        limiter.acquire()
    assert jdbc_url("postgresql+psycopg2://u:p%40@h:5/db") == ("jdbc:postgresql://h:5/db", {"user": "u", "password": "p@"})
    assert jdbc_url("sqlite:///x.db")[0] == "jdbc:sqlite:x.db" and jdbc_url("jdbc:derby:x") == ("jdbc:derby:x", {})


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    m = NodeMapping(source="s", label="U", key="id", properties=[PropertyMapping(source_field="id"), PropertyMapping(source_field="v")])
    for batch in ([(1, "a"), (2, "b")], [(1, "c"), (3, "d")]):
        spark.createDataFrame(batch, "id int, v string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id int, v string").parquet(str(src))
        merge_stream(stream, m, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_stream_tables_survive_a_lost_driver(spark, tmp_path):
    """At every point of a swap the next batch finds all rows."""
    from weftgraph.streaming import merge as m

    path = tmp_path / "t"
    write = lambda where, data: spark.createDataFrame(data, "id int, v string, bucket int").coalesce(1).write.partitionBy("bucket").parquet(str(where))
    read = lambda: {(r.id, r.v) for r in m.bucketed(spark, str(path)).collect()}
    assert m.bucketed(spark, str(path)) is None
    m.recover(spark, str(path))
    write(path, [(1, "a", 0), (2, "b", 1)])
    write(path / m.NEW, [(1, "c", 0), (3, "d", 2)])
    assert read() == {(1, "a"), (2, "b")}  # new files are not seen before the swap
    m.swap(spark, str(path))
    assert read() == {(1, "c"), (2, "b"), (3, "d")}
    # the old bucket is away and the new one not yet there
    write(path / m.NEW, [(1, "e", 0)])
    (path / m.OLD).mkdir()
    (path / "bucket=0").rename(path / m.OLD / "bucket=0")
    m.recover(spark, str(path))
    assert read() == {(1, "c"), (2, "b"), (3, "d")}
    # both are there: the swap of that bucket was done
    write(path / m.OLD, [(1, "older", 0)])
    m.recover(spark, str(path))
    assert read() == {(1, "c"), (2, "b"), (3, "d")} and not (path / m.OLD).exists() and not (path / m.NEW).exists()


def test_progress_and_shared_folder(spark):
    from types import SimpleNamespace

    from weftgraph.metrics import JobMetrics, TaskProgress
    from weftgraph.sources.paths import shared_dir

    with TaskProgress(spark, 0.01) as p:
        spark.range(10).count()
        assert all(done <= tasks for _, done, tasks in p.report())
    m = JobMetrics()
    with pytest.raises(KeyError), m:
        with m.step("good") as s:
            s.records_processed = 10
        with m.step("bad"):
            raise KeyError("x")
    assert [s.status for s in m.steps] == ["completed", "failed"] and m.status == "failed" and m.errors == ["'x'"] and m.steps[1].error == "'x'"
    assert m.total_records_processed == 10 and m.duration_seconds >= 0 and m.steps[0].duration_seconds >= 0
    assert JobMetrics().step("x").to_dict()["status"] == "pending"
    remote = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(remote)


def test_stream_windows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("weft_windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM weft_windows").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_queries_match_sql(spark, sf):
    """Every registered query of the engine against its SQL."""
    import duckdb

    from weftgraph.plans import checks  # noqa: F401  it registers further queries
    from weftgraph.plans.catalogue import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "part", "events", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    wrong = []
    for name, q in QUERIES.items():
        df = q(spark, sf)
        cols = sorted(df.columns)
        got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
        cur = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})")
        if got != sorted(map(repr, cur.fetchall())):
            wrong.append(name)
    assert not wrong


def test_statements():
    from weftgraph.config import Connection
    from weftgraph.operators.statements import batched, connector_options, node_statement, rel_statement

    props = [PropertyMapping(source_field="id"), PropertyMapping(source_field="full", target="name")]
    node = NodeMapping(source="s", label="P", key="id", properties=props)
    assert batched(node_statement(node)) == "UNWIND $rows AS row MERGE (n:P {id: row.id}) SET n.name = row.name"
    assert node_statement(node.model_copy(update={"properties": props[:1]}), "event") == "MERGE (n:P {id: event.id})"
    rel = RelationshipMapping(source="s", rel_type="R", from_label="P", from_key="id", from_field="a", to_label="Q", to_key="k", to_field="b", properties=props[1:])
    assert rel_statement(rel) == "MATCH (a:P {id: row.from_val}) MATCH (b:Q {k: row.to_val}) MERGE (a)-[r:R]->(b) SET r.name = row.name"
    assert connector_options(Connection(username="u", password="p"), 7)["batch.size"] == "7"


def test_sequence_follows_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"k,v\n1,{i}a\n1,{i}b\n")
    df = read_source(spark, SourceConfig(name="s", type="csv", path=str(tmp_path / "*.csv")))
    seq = g.with_sequence(df)
    assert sorted(tuple(r[g.SEQ])[0].rsplit("/", 1)[-1] for r in seq.collect()) == ["0.csv"] * 2 + ["1.csv"] * 2 + ["2.csv"] * 2
    assert [tuple(r) for r in g.merge([seq], ["k"]).collect()] == [("1", "2b")]


@pytest.fixture
def api():
    """A server of records 0 to 24: by page, by cursor, with a list at the top, and failing once."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    failed = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            size = int(q.get("per_page", 25))
            if url.path == "/flaky" and not failed:
                failed.append(1)
                self.send_response(503)
                self.end_headers()
                return
            at = int(q.get("cursor", 0)) if url.path == "/cursor" else (int(q.get("page", 1)) - 1) * size
            rows = [{"id": i, "name": f"n{i}", "x": None if i < 20 else {"y": i}} for i in range(at, min(25, at + size))]
            body = {"data": {"rows": rows}, "meta": {"next": at + size if at + size < 25 else None}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(rows if url.path == "/top" else body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest_source(spark, api):
    ids = lambda **c: sorted(r.id for r in read_source(spark, SourceConfig(name="s", type="rest", **c)).collect())
    every = list(range(25))
    assert ids(url=f"{api}/top") == every
    assert ids(url=f"{api}/pages", json_root="data.rows", pagination={"page_size": 10}) == every
    assert ids(url=f"{api}/pages", json_root="data.rows", pagination={"page_size": 10, "max_pages": 2}) == every[:20]
    assert ids(url=f"{api}/cursor", json_root="data.rows", pagination={"type": "cursor", "page_size": 7, "next_cursor_path": "meta.next"}, rate_limit={"requests_per_second": 500}) == every
    assert ids(url=f"{api}/flaky", json_root="data.rows", params={"per_page": 3}) == every[:3]
    with pytest.raises(KeyError):
        ids(url=f"{api}/pages", json_root="data.none", pagination={"page_size": 10})


def test_rest_rows_keep_the_fields_of_later_pages(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    records = [{"id": 1, "price": 3, "code": 7}, {"id": 2, "price": 2.5, "note": "x", "code": "a"}, {"id": 3, "more": {"y": [1]}}]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("?page=")[1].split("&")[0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(records[page - 1 : page]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    cfg = SourceConfig(name="s", type="rest", url=f"http://127.0.0.1:{server.server_port}/", pagination={"page_size": 1})
    got = sorted(read_source(spark, cfg).collect(), key=lambda r: r.id)
    assert [(r.price, r.note, r.code) for r in got] == [(3.0, None, "7"), (2.5, "x", "a"), (None, None, None)]
    assert got[2].more.y == [1] and got[0].more is None
    server.shutdown()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_equals_row_by_row_upserts(spark, seed):
    """Any mix of mappings, nulls and repeats gives what setting properties one row at a time gives."""
    import random

    rng = random.Random(seed)
    want: dict = {}
    projections = []
    for _ in range(3):
        props = rng.sample(["p", "q", "r", "s"], rng.randint(1, 3))
        data = [(rng.choice([None, *range(12)]), *[rng.choice([None, "a", "b", "c"]) for _ in props]) for _ in range(60)]
        for k, *values in data:
            if k is not None:
                want.setdefault(k, {}).update(zip(props, values, strict=True))
        df = rows(spark, data, "k int, " + ", ".join(f"{p} string" for p in props))
        projections.append(df)
    got = {r.k: r.asDict() for r in g.merge(projections, ["k"]).collect()}
    names = sorted({n for p in projections for n in p.columns} - {"k"})
    assert {k: [r[n] for n in names] for k, r in got.items()} == {k: [v.get(n) for n in names] for k, v in want.items()}

    out = g.PropertyGraph(nodes={"P": g.Nodes(rows(spark, [(k,) for k in range(8)], "id int"), "id")})
    m = RelationshipMapping(source="s", rel_type="R", from_label="P", from_key="id", from_field="a", to_label="P", to_key="id", to_field="b", properties=[PropertyMapping(source_field="w")])
    pairs = [(rng.choice([None, *range(10)]), rng.randrange(10), rng.choice([None, 1, 2])) for _ in range(80)]
    g.merge_rels(out, m, [g.project_rels(rows(spark, pairs, "a int, b int, w int"), m)])
    last = {(a, b): w for a, b, w in pairs if a is not None and a < 8 and b < 8}
    assert {(r.from_val, r.to_val): r.w for r in out.rel("R").collect()} == last
    lost = g.dangling_rels(out, m, g.project_rels(rows(spark, pairs, "a int, b int, w int"), m))
    assert sorted(map(repr, map(tuple, lost.collect()))) == sorted(repr(p) for p in pairs if (p[0], p[1]) not in last)
