"""Evaluation of generated facts against true ones, and the functions that make facts."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import candidates as C
from factweave.operators import metrics as M
from tests.helpers import rows

FACT = "op_key string, kind string, value string"


def facts(spark, *data):
    return spark.createDataFrame(list(data), FACT)


def evaluated(spark, spec, truth):
    return M.evaluate(facts(spark, *spec), facts(spark, *truth)).first().asDict()


def test_evaluate(spark):
    truth = [("GET /a", "route", ""), ("GET /b", "route", ""), ("GET /a", "param", "query|q|false|string"), ("GET /a", "response", "id|integer|true"), ("GET /a", "response", "n|string|false"), ("GET /a", "request", "x|string|true"), ("GET /a", "envelope", "200:0"), ("GET /a", "envelope", "200:1"), ("GET /b", "response", "only|string|true")]
    spec = [("GET /a", "route", ""), ("GET /c", "route", ""), ("GET /a", "param", "query|q|false|string"), ("GET /a", "response", "id|integer|false"), ("GET /a", "response", "n|string|false"), ("GET /a", "response", "extra|string|false"), ("GET /a", "envelope", "200:0"), ("GET /c", "response", "far|string|true")]
    m = evaluated(spark, spec, truth)
    assert m["route_recall"] == m["route_precision"] == 0.5 and m["param_f1"] == 1.0
    assert (m["request_precision"], m["request_recall"], m["request_f1"]) == (1.0, 0.0, 0.0)
    assert m["response_precision"] == pytest.approx(1 / 3) and m["response_recall"] == 0.5 and m["shape_recall"] == 1.0 and m["shape_precision"] == pytest.approx(2 / 3)
    assert m["envelope_recall"] == 0.5 and m["hallucination"] == pytest.approx(2 / 3)
    found = M.differences(facts(spark, *spec), facts(spark, *truth))
    assert rows(found) == sorted([("extra route", "GET /c"), ("missing route", "GET /b"), ("missing request", "GET /a: x|string|true"), ("missing response", "GET /a: id|integer|true"), ("spurious response", "GET /a: id|integer|false"), ("spurious response", "GET /a: extra|string|false"), ("missing envelope", "GET /a: 200:1")], key=lambda t: tuple((x is not None, str(x)) for x in t))
    report = M.report_text(M.evaluate(facts(spark, *spec), facts(spark, *truth)), found).first()["report"]
    assert report.startswith("Route recall      : 0.500\nRoute precision   : 0.500") and "Spurious Response (2):\n  - GET /a: extra|string|false\n  - GET /a: id|integer|false" in report


def test_self_and_empty(spark):
    same = [("GET /a", "route", ""), ("GET /a", "response", "x|string|true"), ("GET /a", "response", "x|string|true")]
    m = evaluated(spark, same, same)
    assert m["hallucination"] == m["envelope_recall"] == 0.0 and all(v == 1.0 for k, v in m.items() if k not in ("hallucination", "envelope_recall"))
    m = evaluated(spark, [], [])
    assert m["route_recall"] == 1.0 and m["route_precision"] == 0.0 and m["param_f1"] == 1.0
    empty = facts(spark)
    assert M.differences(empty, empty).count() == 0
    assert "Hallucination" in M.report_text(M.evaluate(empty, empty), M.differences(empty, empty)).first()["report"]


def test_open_objects(spark):
    make = lambda *v: spark.createDataFrame([("o", x, x.split("|")[0]) for x in v], "op_key string, value string, path string")
    spec = make("data|object|true", "data.extra|string|false", "data.id|integer|true", "list[].a|string|true", "list[][].b|string|true", "other|string|true")
    truth = make("data|object|true", "data.id|string|true")
    opened = lambda *p: spark.createDataFrame([("o", x) for x in p], "op_key string, prefix string")
    kept = lambda *p: [r[0] for r in rows(M.tolerate_open_objects(spec, truth, opened(*p), ["op_key"], "path", "value"), "value")]
    assert kept("data") == ["data.id|integer|true", "data|object|true", "list[].a|string|true", "list[][].b|string|true", "other|string|true"]
    assert kept("list") == ["data.extra|string|false", "data.id|integer|true", "data|object|true", "other|string|true"]
    assert kept("") == ["data.id|integer|true", "data|object|true"]
    assert kept("dat") == kept("zz") and len(kept("zz")) == 6


def test_envelope_codes_and_quads(spark):
    df = spark.createDataFrame([("200", ["0", "7"], "code=9"), ("200", None, "fails with code=3, or code=4); code= none"), ("200", [], None), ("200", None, "no codes"), ("404", None, None)], "s string, e array<string>, d string")
    assert [r[0] for r in df.select(M.envelope_codes(F.col("s"), F.col("e"), F.col("d"))).collect()] == [["200:0", "200:7"], ["200:3", "200:4"], ["200:0"], [], []]
    quad = spark.range(1).select(M.parameter_quad(F.lit("query"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit("string")))
    assert quad.first()[0] == "query||false|string"


def test_tag_constraints(spark):
    tags = [('binding:"required,min=2,max=5"', "string"), ('validate:"gte=1.5,lte=9"', "number"), ('binding:"" validate:"len=3"', "array"), ('binding:"oneof=a b,oneof=c,min=x"', "string"), ('json:"x"', "integer"), (None, "integer"), ('binding:"min=1,min=4,minlength=9"', "integer")]
    df = spark.createDataFrame(tags, "tag string, t string")
    got = [tuple(r[0]) for r in df.select(T.tag_constraints(F.col("tag"), F.col("t"))).collect()]
    assert got == [(2.0, 5.0, []), (1.5, 9.0, []), (3.0, 3.0, []), (None, None, ["a", "b", "c"]), (None, None, []), (None, None, []), (4.0, None, [])]


def test_small_functions(spark):
    df = spark.createDataFrame([("llm:error-code X ← return X", 1280), ("route here", 1023), (None, 5 << 30)], "q string, n long")
    assert [tuple(r) for r in df.select(T.evidence_label(F.col("q")), T.human_bytes(F.col("n"))).collect()] == [("llm:error-code X", "1.2 KiB"), ("route", "1023 B"), ("route", "5.0 GiB")]
    names = df.limit(1).select(T.name_in_source(F.lit(""), F.lit("x"), F.array(F.lit("x"))), T.name_in_source(F.lit("a-b"), F.lit("'a-b'"), F.array(F.lit("x"))), T.name_in_source(F.lit("a"), F.lit("`a`"), F.array(F.lit("x"))))
    assert tuple(names.first()) == (False, True, False)


def test_collisions_and_counters(spark):
    s = spark.createDataFrame([("A", "x", 1, "1"), ("A", "y", 2, "2"), ("A", "y", 3, "2"), ("B", "y", 4, "1")], "name string, source string, seq long, json string")
    assert rows(C.collision_diagnostics(C.schema_collisions(s))) == [("schema_name_collision", "schema A of y differs from another of that name and becomes y.A")]
    e = spark.createDataFrame([(1, None, True, [("a",)]), (2, 5, None, None)], "usage_in long, usage_out long, exhausted boolean, reads array<struct<tool: string>>")
    assert tuple(C.usage_counters(e).first()) == (2, 1, 3, 5, 1) and tuple(C.usage_counters(e.limit(0)).first()) == (0, 0, 0, 0, 0)
