import random

from pyspark.sql import functions as F

from factweave.operators import candidates as C
from tests.helpers import rows

SCHEMA = "op_key string, slot_kind string, slot_key string, seq long, value_json string, confidence double, status string, evidence array<struct<source: string>>"


def frame(spark, data):
    return spark.createDataFrame([(o, k, s, i, v, c, st, [(e,) for e in ev] if ev is not None else None) for o, k, s, i, v, c, st, ev in data], SCHEMA)


def test_equal_different_and_empty(spark):
    data = [
        ("GET /a", "param", "id", 1, '"x"', 1.0, "verified", ["source"]),
        ("GET /a", "param", "id", 2, '"x"', 0.8, "declared", ["openapi"]),
        ("GET /a", "param", "n", 1, '"string"', 0.9, "declared", ["openapi"]),
        ("GET /a", "param", "n", 2, '"integer"', 0.9, "declared", []),
        ("GET /b", "body", "", 1, None, None, None, None),
        ("GET /b", "body", "", 2, None, 0.5, "inferred", None),
    ]
    want = [("GET /a", "id", "verified", '"x"', 1.0, 2, False), ("GET /a", "n", "conflict", None, 0.9, 2, True), ("GET /b", "", "inferred", None, 0.5, 2, False)]
    columns = ["op_key", "slot_key", "state", "value_json", "confidence", "candidates", "different"]
    for order in (data, data[::-1], random.Random(1).sample(data, len(data))):
        for parts in (1, 5):
            assert rows(C.resolve(frame(spark, order).repartition(parts)), *columns) == want
    marked = rows(C.mark_conflicts(frame(spark, data)).where("slot_key = 'n'"), "seq", "status")
    assert marked == [(1, "conflict"), (2, "conflict")]
    assert C.resolve(frame(spark, [])).count() == 0


def test_priority(spark):
    p = lambda st, c, ev: frame(spark, [("o", "param", "k", 1, "1", c, st, ev)]).select(C.candidate_priority(F.col("evidence"), F.col("status"), F.col("confidence")).alias("p")).first()["p"]
    assert p(" Verified ", 0.5, ["LLM", " source"]) == 55.5
    assert p("observed", None, []) == 43.0
    assert p(None, 0.25, None) == 0.25
    assert p("conflict", 0.5, ["rumour"]) == 0.5


def test_variants(spark):
    base = [("o", "response", "200", 1, "a0", 1.0, "verified", ["source"]), ("o", "response", "200", 2, "a1", 1.0, "verified", ["source"])]
    df = frame(spark, base).withColumn("class", F.substring("value_json", 2, 1))
    assert rows(C.resolve_variants(df, "class"), "state", "variants", "candidates") == [("verified", 2, 2)]
    same = frame(spark, [*base, ("o", "response", "200", 3, "b0", 1.0, "verified", ["source"])]).withColumn("class", F.substring("value_json", 2, 1))
    assert rows(C.resolve_variants(same, "class"), "state", "variants") == [("conflict", 2)]


def test_merging(spark):
    ops = spark.createDataFrame([("o", 1, "source_only", 0.0, "", None, "d1"), ("o", 2, "source_only", 0.7, "id2", "s2", "d2"), ("p", 1, "conflict", 0.9, "x", "", ""), ("p", 2, "m", 0.8, "", "", "")], "op_key string, seq long, state string, confidence double, operation_id string, summary string, description string")
    assert rows(C.merge_operations(ops)) == [("o", "matched", 0.7, "id2", "s2", "d1", 2), ("p", "conflict", 0.8, "x", None, None, 2)]
    a = frame(spark, [("o", "param", "id", 5, "1", 1.0, "verified", [])])
    merged = C.merge_graphs(a, a.withColumn("value_json", F.lit("2")))
    assert merged.count() == 2 and merged.select("seq").distinct().count() == 2
    schemas = spark.createDataFrame([("Pet", "code", 1, "{}"), ("Pet", "openapi", 2, '{"a":1}'), ("Cat", "code", 1, "{}")], "name string, source string, seq long, json string")
    collisions = C.schema_collisions(schemas)
    assert rows(collisions, "source", "name", "new_name", "collides") == [("code", "Cat", "Cat", False), ("code", "Pet", "Pet", False), ("openapi", "Pet", "openapi.Pet", True)]
    refs = spark.createDataFrame([("code", "#/s/Pet"), ("openapi", "#/s/Pet")], "source string, ref string")
    assert rows(C.rewrite_references(refs, collisions, "ref"), "source", "ref") == [("code", "#/s/Pet"), ("openapi", "openapi.Pet")]


def test_aggregates(spark):
    r = spark.createDataFrame([("o", "200", 2, "b", "j", 5, True, False, None), ("o", "200", 1, "a", "", 3, True, True, None), ("o", "200", 3, "a", "k", 9, False, None, None)], "op_key string, status string, seq long, description string, content_type string, code int, code_known boolean, failure boolean, raw boolean")
    assert rows(C.group_responses(r)) == [("o", "200", "j", [3, 5], True, False, 3, "a; b")]
    flows = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("g", 2, "y"), ("h", 1, None)], "g string, p int, k string")
    assert rows(C.keys_on_every_path(flows, ["g"], "p", "k")) == [("g", "x", True), ("g", "y", False)]
    assert rows(C.stable_counts(flows, "p")) == [("1=2, 2=2",)]
    one = spark.createDataFrame([(0.0, 0.6), (0.9, None)], "c double, p double")
    assert rows(one.select(C.operation_confidence(F.col("c"), F.col("p")))) == [(0.6,), (0.9,)]
    resolved = C.resolve(frame(spark, [("o", "param", "k", 1, "1", 1.0, "verified", [])]))
    assert rows(C.graph_statistics(resolved)) == [(1, 1, 0, 0, 0)]
