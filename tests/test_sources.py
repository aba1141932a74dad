import json

import pytest
from pyspark.sql import functions as F

from factweave.operators import compile as D
from factweave.operators.candidates import merge_graphs, resolve
from factweave.sources import documents as S
from factweave.sources import trees
from factweave.sources.observations import numbered_lines, observed_candidates, read_observations
from factweave.streaming.observations import malformed_observations, status_counts, stream_observations, write_stream
from tests.helpers import rows

GOOD = '{"method":"get","path":"/a/","status":200,"content_type":"application/json","trace_id":"t1","observed_at":"2025-01-01T00:00:00Z"}'


def test_observations(spark, tmp_path):
    f = tmp_path / "o.jsonl"
    f.write_text(f"{GOOD}\n\n{GOOD.replace('200', '404').replace('application/json', '')}\n")
    got = read_observations(spark, str(f))
    assert rows(got, "op_key", "status", "has_body", "line_no") == [("GET /a", 200, True, 1), ("GET /a", 404, False, 3)]
    assert observed_candidates(got).count() == 2
    for bad in ("not-json", '{"path":"/a","status":200}', '{"method":"GET","path":"/a","status":99}', '{"method":"GET","path":"/a","status":600}', "[1]"):
        f.write_text(f"{GOOD}\n{bad}\n")
        with pytest.raises(Exception, match="malformed observation"):
            read_observations(spark, str(f)).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(f"{GOOD}\n{GOOD}\nbroken\n" + GOOD.replace("t1", "t2") + "\n")
    rows_ = stream_observations(spark, str(tmp_path / "in"))
    write_stream(rows_, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.trace_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t1", "t2"]
    assert status_counts(rows_).isStreaming
    bad = malformed_observations(spark, str(tmp_path / "in"))
    write_stream(bad, str(tmp_path / "bad"), str(tmp_path / "ck2")).awaitTermination(120)
    assert [r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken"]


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 500), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join("\n" if i % 7 == 0 else f"{name}{i}\r\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4 or lines.select("value").count() == 503
        got = {(r.file[-7], r.line_no): r.value for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(f, i): "" if i % 7 == 0 else f"{f}{i}\r" for f, n in (("a", 500), ("b", 3)) for i in range(1, n + 1)}


def test_documentation(spark):
    op = {"method": "get", "path": "/a", "summary": "s", "responses": {"200": {"content_type": "text/plain"}}}
    df = S.read_documentation(spark, json.dumps({"operations": [op]}))
    assert rows(df, "op_key", "status", "confidence", "state") == [("GET /a", "200", 0.7, "document_only")]
    for broken in ({**op, "method": ""}, {**op, "path": "a"}, {**op, "responses": {}}, {**op, "responses": {"default": {}}}):
        with pytest.raises(ValueError):
            S.read_documentation(spark, json.dumps({"operations": [broken]}))
    with pytest.raises(ValueError):
        S.read_documentation(spark, json.dumps({"operations": [op, op]}))


def test_openapi(spark):
    new = {"paths": {"/pets/{id}": {"get": {"operationId": "getPet", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "integer"}}], "responses": {"200": {"description": "ok", "content": {"text/plain": {"schema": {"$ref": "#/components/schemas/Raw"}}, "application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}}}, "summary": "not a method"}}, "components": {"schemas": {"Pet": {"type": "object", "required": ["id"], "properties": {"id": {"type": ["integer", "null"]}}, "additionalProperties": True}}}}
    old = {"swagger": "2.0", "basePath": "/v1", "paths": {"/pets": {"post": {"parameters": [{"name": "b", "in": "body", "schema": {"$ref": "#/definitions/Pet"}}], "responses": {"201": {"description": "made", "schema": {"$ref": "#/definitions/Pet"}}}}}}, "definitions": {"Old": {"properties": {"x": {"type": "string"}}}}}
    docs = spark.createDataFrame([("new", json.dumps(new)), ("old", json.dumps(old))], "doc_id string, text string")
    ops = S.openapi_operations(docs)
    assert rows(ops, "doc_id", "op_key", "operation_id", "body_schema") == [("new", "GET /pets/{id}", "getPet", None), ("old", "POST /v1/pets", None, "Pet")]
    assert rows(S.openapi_parameters(ops), "op_key", "name", "location", "required", "type") == [("GET /pets/{id}", "id", "path", True, "integer")]
    assert rows(S.openapi_responses(ops), "status", "content_type", "schema") == [("200", "application/json", "Pet"), ("201", None, "Pet")]
    nodes = S.openapi_schemas(docs)
    assert rows(nodes, "schema_id", "path", "type", "required", "open") == [("Old", "", None, False, False), ("Old", "/properties/x", "string", False, False), ("Pet", "", "object", False, True), ("Pet", "/properties/id", "integer", True, False)]
    with pytest.raises(Exception, match="unreadable document"):
        S.openapi_operations(spark.createDataFrame([("x", "{")], "doc_id string, text string")).collect()
    flow = {"workflows": [{"workflowId": "w", "steps": [{"stepId": "a", "operationId": "x"}, {"stepId": "b"}]}]}
    assert rows(S.workflow_steps(spark.createDataFrame([("d", json.dumps(flow))], "doc_id string, text string")), "workflow_id", "pos", "step_id", "operation_id") == [("w", 0, "a", "x"), ("w", 1, "b", None)]
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, value string")
    assert rows(S.apply_overlay(base, spark.createDataFrame([("b", "3"), ("c", "4")], "path string, value string"))) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_trees_and_stores(spark, tmp_path):
    root = tmp_path / "src"
    (root / "vendor").mkdir(parents=True)
    for name in ("a.go", "a_test.go", "b.py", "c.txt", "vendor/d.go"):
        (root / name).write_text("x\ny")
    tree = trees.source_tree(spark, str(root))
    assert sorted(r.file.rsplit("/", 1)[-1] for r in tree.collect()) == ["a.go", "b.py"]
    assert rows(trees.directory_statistics(spark, str(root))) == [(5, 15)]
    graph = spark.createDataFrame([("GET /a", "x")], "op_key string, state string")
    store = str(tmp_path / "snap")
    assert trees.load_snapshot(spark, store, "f", "1") is None
    trees.save_snapshot(graph, store, "f", "1")
    trees.save_snapshot(graph.withColumn("state", F.lit("y")), store, "f", "2")
    trees.save_snapshot(graph.withColumn("state", F.lit("z")), store, "f", "2")
    assert rows(trees.load_snapshot(spark, store, "f", "1")) == [("GET /a", "x")] and rows(trees.load_snapshot(spark, store, "f", "2")) == [("GET /a", "z")]
    assert trees.load_snapshot(spark, store, "f", "3") is None
    memo = str(tmp_path / "memo")
    for i in range(3):
        trees.save_memo(graph, memo, f"k{i}")
    assert trees.load_memo(spark, memo, "k1").count() == 1 and trees.load_memo(spark, memo, "zz") is None
    assert len(trees.prune_memos(spark, memo, 2)) == 1


def test_document_output(spark, tmp_path):
    ops = spark.createDataFrame([("GET /b", "GET", "/b", "listB", "s"), ("PUT /a", "PUT", "/a", "putA", None), ("GET /a", "GET", "/a", "getA", None)], "op_key string, method string, path string, operation_id string, summary string")
    schema = "op_key string, slot_kind string, slot_key string, seq long, value_json string, confidence double, status string, evidence array<struct<source: string>>"
    c = spark.createDataFrame([("GET /a", "response", "200", 1, '{"x":"yes"}', 1.0, "verified", []), ("GET /a", "param", "z", 1, '{"in":"query"}', 1.0, "verified", []), ("GET /a", "param", "id", 1, '{"in":"path"}', 1.0, "verified", []), ("PUT /a", "body", "", 1, "{}", 1.0, "verified", []), ("GET /b", "response", "404", 1, "{}", 1.0, "verified", []), ("GET /b", "response", "404", 2, '{"a":1}', 1.0, "verified", [])], schema)
    text = D.rendered_twice(D.document_rows(ops, c.repartition(5)))
    assert text == D.rendered_twice(D.document_rows(ops, c.orderBy(F.desc("seq")).repartition(2)))
    assert text.index("/a:") < text.index("/b:") and text.index("getA") < text.index("putA") and text.index("name: id") < text.index("name: z")
    assert 'x: "yes"' in text and "x-state: conflict" in text and '"200":' in text
    assert [D.yaml_scalar(v) for v in ("a", "true", "", "1", 1, None, "a: b")] == ["a", '"true"', '""', '"1"', "1", "null", '"a: b"']
    a, b = D.stable_json(c.drop("evidence"), "op_key"), D.stable_json(c.drop("evidence").repartition(3), "op_key")
    assert rows(a) == rows(b)
    D.write_artifacts(spark, str(tmp_path / "out"), {"b.yaml": text, "a.md": D.report({"operations": 3}, [("x", 0.5), ("y", 0.2)], ["g"])})
    assert (tmp_path / "out/a.md").read_text().index("y: 0.20") < (tmp_path / "out/a.md").read_text().index("x: 0.50")
    assert len(D.operations_json(ops).collect()) == 3
    D.write_artifacts(spark, str(tmp_path / "out"), {"a.md": "again"})
    assert (tmp_path / "out/a.md").read_text() == "again"
    good = {"openapi": "3.1.0", "paths": {"/a": {"get": {"responses": {"200": {}, "default": {}}}}}}
    assert D.revalidated(json.dumps(good)) == good
    for broken in ({}, {**good, "openapi": "2.0"}, {**good, "paths": {"a": {"get": {"responses": {"200": {}}}}}}, {**good, "paths": {"/a": {"get": {"responses": {"99": {}}}}}}, {**good, "paths": {"/a": {"get": {}}}}):
        with pytest.raises(ValueError):
            D.revalidated(json.dumps(broken))


def test_sources_conflict(spark, tmp_path):
    """An OpenAPI response and an observation of one status share a class and differ: a conflict."""
    f = tmp_path / "o.jsonl"
    f.write_text(GOOD)
    seen = observed_candidates(read_observations(spark, str(f)))
    documented = seen.withColumn("value_json", F.lit('{"status":"200","description":"ok"}'))
    assert rows(resolve(merge_graphs(documented, seen)), "state", "candidates") == [("conflict", 2)]
