import json

from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.operators.nested import LEVELS, SCHEMA_EDGES, latest_documents, merged_edges, merged_schema, relate, schema_nodes
from factweave.sources.documents import schema_rows
from factweave.operators.schema_tree import Tree, canonical_shapes, flatten, replace_subtree, unknown_paths
from tests.helpers import rows

RAW = "raw_id long, schema_id string, schema_json string, received_at timestamp"


def expected(key, tree):
    out = []

    def add(child, path, parent, edge):
        if isinstance(child, dict):
            out.append((key, path, parent, edge))
            walk(child, path)

    def walk(node, at):
        for word, value in node.items():
            edge, kind = SCHEMA_EDGES.get(word, (None, None))
            if kind == "map" and isinstance(value, dict):
                for k, v in value.items():
                    add(v, f"{at}/{edge}/" + k.replace("~", "~0").replace("/", "~1"), at, edge)
            elif kind == "list" and isinstance(value, list):
                for i, v in enumerate(value):
                    add(v, f"{at}/{edge}/{i}", at, edge)
            elif kind == "one":
                add(value, f"{at}/{edge}", at, edge)

    walk(tree, "")
    return sorted(out)


def found(spark, raw):
    from datetime import datetime

    df = spark.createDataFrame([(i, k, t, datetime(2025, 1, d)) for i, k, t, d in raw], RAW)
    return rows(schema_nodes(df), "schema_id", "node_path", "parent_path", "edge")


def test_versions_and_broken_texts(spark):
    new = {"properties": {"a/b": {"items": {"not": {}}}, "x~y": None, "": {"allOf": [None, {"type": "x"}, 3]}}, "default": {"properties": {"no": {}}}, "items": [{}]}
    raw = [(1, "s", '{"properties":{"old":{}}}', 1), (2, "s", json.dumps(new), 2), (3, "s", '{"properties":{"cut":', 3), (4, "s", "[1]", 4), (5, "s", None, 5), (6, "s", "null", 6), (7, "s", '{"items":{}} trailing', 7), (8, "t", "{}", 1), (9, None, '{"items":{}}', 1)]
    assert found(spark, raw) == expected("s", new)
    assert found(spark, []) == []


tree = st.recursive(st.fixed_dictionaries({}), lambda c: st.fixed_dictionaries({}, optional={"properties": st.dictionaries(st.sampled_from(["a", "~", "/", "é", "items"]), c | st.none(), max_size=3), "items": c | st.none() | st.just([]), "all_of": st.lists(c | st.none(), max_size=2), "oneOf": st.lists(c, max_size=2), "not": c}), max_leaves=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(tree, min_size=1, max_size=6))
def test_any_tree(spark, trees):
    got = found(spark, [(i, f"s{i}", json.dumps(t), 1) for i, t in enumerate(trees)])
    assert got == sorted(x for i, t in enumerate(trees) for x in expected(f"s{i}", t))


def test_deep_tree(spark):
    t = {}
    for _ in range(25):
        t = {"items": t}
    assert len(found(spark, [(1, "s", json.dumps(t), 1)])) == 25


def test_relate(spark):
    texts = ['{"id":1,"tags":["x",null],"lines":[{"n":1,"sub":[{"v":2}]},{"n":2}],"a":{"b":"t"},"a_b":3}', '{"id":2,"extra":true}', "broken", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "k long, t string")
    ddl = merged_schema(df, "t")
    typed = df.selectExpr("k", f"from_json(t, '{ddl}') AS v")
    tables = relate(typed, "k", "v")
    assert set(tables) == {"root", "root_tags", "root_lines", "root_lines_sub"}
    assert tables["root"].count() == 4
    assert {"a_b", "a_b__2"} <= set(tables["root"].columns)
    assert rows(tables["root_lines"], "row_key", "parent_key", "ordinal", "n") == [("0/lines/0", "0", 0, 1), ("0/lines/1", "0", 1, 2)]
    assert rows(tables["root_lines_sub"], "row_key", "parent_key", "v") == [("0/lines/0/sub/0", "0/lines/0", 2)]
    assert rows(tables["root_tags"], "ordinal", "value") == [(0, "x"), (1, None)]


def nodes_of(spark, schemas):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in schemas.items()], "schema_id string, t string")
    return schema_rows(df.selectExpr("schema_id", "parse_json(t) AS node"))


def fields_of(tree, components=None):
    return sorted(set(Tree(tree, components).fields()))


def test_flatten_fields():
    pet = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "format": "int64"}, "when": {"type": "string", "format": "date"}, "tags": {"type": "array", "items": {"type": "string"}}, "owner": {"$ref": "#/s/Owner"}, "lost": {"$ref": "#/s/Lost"}, "x": None, "n": {"types": ["string", "null", "integer"]}}}
    owner = {"type": "object", "properties": {"name": {"type": "string"}, "lines": {"items": {"properties": {"v": {}}}}}}
    assert fields_of(pet, {"Owner": owner}) == sorted(["id|integer|true", "when|string/date|false", "tags|array|false", "owner|object|false", "owner.name|string|false", "owner.lines|?|false", "owner.lines[].v|?|false", "lost|$ref|false", "lost:$ref:Lost", "x|?|false", "n|string|integer|false"])
    assert fields_of({"items": {"properties": {"a": {"type": "string"}}}}) == ["[].a|string|false"]
    assert fields_of(None) == fields_of(3) == []


def test_flatten_merges_and_variants():
    string, integer = {"type": "string"}, {"type": "integer"}
    assert fields_of({"allOf": [{"properties": {"x": string}, "required": ["x"]}, {"allOf": [{"properties": {"x": integer}}, {"properties": {"y": string}}]}]}) == ["x|integer|true", "y|string|false"]
    either = {"properties": {"own": string}, "oneOf": [{"properties": {"a": string}}], "anyOf": [{"properties": {"b": string}}]}
    assert fields_of(either) == ["a|string|false", "b|string|false"]  # variants stand for the whole node
    assert fields_of({"allOf": [either, {"properties": {"c": string}}]}) == ["c|string|false", "own|string|false"]  # a branch gives its properties only
    both = {"result": {"$ref": "#/c/Payload"}}, {"error": {"$ref": "#/c/Error"}}
    components = {"Payload": {"properties": {"id": string}}, "Error": {"properties": {"code": integer}}}
    assert fields_of({"oneOf": [{"properties": b} for b in both]}, components) == ["error.code|integer|false", "error|object|false", "result.id|string|false", "result|object|false"]
    self = {"allOf": [{"$ref": "#/s/Self"}, {"properties": {"z": string}}]}
    assert fields_of(self, {"Self": self}) == ["z|string|false"]
    assert fields_of({"allOf": [{"$ref": "#/s/Alias"}]}, {"Alias": {"$ref": "#/s/Aim"}, "Aim": {"properties": {"w": string}}}) == []  # one hop


def test_flatten_depth():
    loop = {"properties": {"next": {"$ref": "#/s/Loop"}}}
    assert len(fields_of(loop, {"Loop": loop})) == 9  # a reference adds no level
    deep = {"properties": {"deep": {"type": "string"}}}
    for _ in range(8):
        deep = {"oneOf": [deep]}
    assert fields_of(deep) == ["deep|string|false"] and fields_of({"anyOf": [deep]}) == []


def test_open_paths():
    tree = {"additionalProperties": False, "properties": {"a": {"additionalProperties": {"type": "string"}}, "b": {"items": {"additionalProperties": True}}, "r": {"$ref": "x/R"}}, "anyOf": [{"additionalProperties": True}]}
    assert sorted(set(Tree(tree, {"R": {"$ref": "x/Q"}, "Q": {"properties": {"o": {"additionalProperties": True}}}}).open_paths())) == ["", "a", "b[]", "r.o"]
    assert list(Tree({"$ref": "x/A"}, {"A": {"$ref": "x/B"}, "B": {"$ref": "x/A"}}).open_paths()) == []


def test_flatten_operator(spark):
    df = spark.createDataFrame([(1, '{"properties":{"a":{"$ref":"#/c/A"}}}', '{"A":{"additionalProperties":true}}'), (2, None, None), (3, "[1]", None), (1, '{"properties":{"b":{}}}', None)], "raw_id long, t string, c string").selectExpr("raw_id", "try_parse_json(t) AS node", "try_parse_json(c) AS comps")
    assert rows(flatten(df, "raw_id", "node", "comps")) == sorted([(1, "field", "a|?|false"), (1, "field", "b|?|false"), (1, "open", "a")], key=str)
    assert flatten(df.limit(0), "raw_id").count() == 0


def test_flatten_query(spark, tmp_path):
    from datetime import datetime

    from __spark_entry__ import queries

    tree = {"properties": {"a": {"type": "string"}, "b": {"$ref": "#/x/S2"}}}
    for _ in range(5):
        tree = {"all_of": [tree]}
    raw = [(1, "S1", "r", "ir", json.dumps(tree), datetime(2025, 1, 1))] * 2 + [(2, "S1", "r", None, "{cut", datetime(2025, 1, 2)), (3, None, "r", None, '{"items":{"properties":{"c":{}}}}', None)]
    spark.createDataFrame(raw, "raw_id long, schema_id string, repo string, layout string, schema_json string, received_at timestamp").write.parquet(str(tmp_path / "raw_schemas.parquet"))
    assert rows(queries()["schema_flatten"](spark, str(tmp_path))) == sorted([("S1", 1, "a|string|false"), ("S1", 1, "b:$ref:S2"), ("S1", 1, "b|$ref|false"), (None, 3, "[].c|?|false")], key=lambda t: tuple((x is not None, str(x)) for x in t))



def test_shapes_and_edits(spark):
    nodes = nodes_of(spark, {"A": {"properties": {"x": {"type": "string"}}}, "B": {"properties": {"x": {"type": "string"}}}, "C": {"properties": {"x": {"additionalProperties": {"type": "string"}}}}})
    shapes = dict(rows(canonical_shapes(nodes)))
    assert shapes["A"] == shapes["B"] != shapes["C"]
    assert rows(unknown_paths(nodes)) == [("C", "/properties/x")]
    edited = replace_subtree(nodes, "A", "/properties/x", nodes.where("schema_id = 'B'"))
    assert rows(edited.where("schema_id = 'A'"), "path", "parent_path", "name") == [("", None, None), ("/properties/x", "", "x"), ("/properties/x/properties/x", "/properties/x", "x")]


def test_surrogate_keys_ordinals_and_depth(spark):
    tree = {"type": "object"}
    for i in range(3 * LEVELS + 1):
        tree = {"items": tree} if i % 2 else {"all_of": [None, tree, {"properties": {"x": {}}}], "allOf": [{}]}
    df = spark.createDataFrame([(1, "s", json.dumps(tree), None)], RAW)
    nodes = schema_nodes(df)
    got = nodes.collect()
    assert rows(nodes, "schema_id", "node_path", "parent_path", "edge") == expected("s", tree)
    keys = {r.node_key for r in got}
    assert len(keys) == len(got) and {r.parent_key for r in got} <= keys | {"s"}
    assert all((r.ordinal is not None) == (r.edge == "all_of") and (r.name is not None) == (r.edge == "properties") for r in got)
    by_key = {r.node_key: r for r in got}
    assert all(r.parent_path == by_key[r.parent_key].node_path for r in got if r.parent_key != "s")


def test_merged_edges(spark):
    df = spark.createDataFrame([(1, "s", '{"properties":{"items":{"not":3}},"allOf":{"x":1},"a: OBJECT<not: OBJECT<":1}', None), (2, "t", '{"any_of":[{"one_of":[1,{"not":[]},{"not":{"any\\u004ff":[]}}]}]}', None)], RAW)
    roots = latest_documents(df, "schema_id", "schema_json", ["received_at", "raw_id"])
    found = merged_edges(roots)
    assert set(found) == {"properties", "items", "any_of", "one_of", "not", "anyOf"}
    assert rows(schema_nodes(df), "schema_id", "node_path") == [("s", "/properties/items"), ("t", "/any_of/0"), ("t", "/any_of/0/one_of/1"), ("t", "/any_of/0/one_of/2"), ("t", "/any_of/0/one_of/2/not")]


def test_types_in_names(spark):
    df = spark.createDataFrame([('{"AVOID": null, "VOID": {"x": [null]}, "a OBJECT<": 1}',)], "t string")
    assert merged_schema(df, "t") == "STRUCT<AVOID: STRING, VOID: STRUCT<x: ARRAY<STRING>>, `a OBJECT<`: BIGINT>"
