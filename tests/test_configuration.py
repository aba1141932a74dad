"""Profiles, specifications, isolated work, labels."""

import json

import pytest
from pyspark.sql import functions as F

from factweave import __version__
from factweave.operators import compile as P
from factweave.operators import evidence as E
from factweave.operators import graph as G
from factweave.operators.isolate import engine_identity, isolated
from factweave.sources.profile import Profile, load_specs, save_spec
from tests.helpers import rows


def test_profile(spark, tmp_path):
    default = Profile.load(spark, str(tmp_path / "none.json"))
    assert default.framework == "unknown" and default.sink_rules(spark).count() == default.security_mapping(spark).count() == default.wildcard_rules(spark).count() == 0
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"framework": "gin", "response_sinks": [{"symbol": "x.Context.JSON"}, {"symbol": "y.JSON"}, {}], "auth_middleware": {"jwt": {"scheme": "bearer"}}, "path_conventions": {"wildcard_expansion": {"/v*/a": ["/v1/a", "/v2/a"]}}}))
    p = Profile.load(spark, str(f))
    symbols = spark.createDataFrame([("lib/x.Context.JSON",), ("y.JSON",)], "symbol string")
    assert rows(E.first_rule(symbols, p.sink_rules(spark))) == [("lib/x.Context.JSON", "x.Context.JSON"), ("y.JSON", "y.JSON")]
    assert rows(p.security_mapping(spark)) == [("jwt", "bearer")]
    routes = spark.createDataFrame([("/v*/a",)], "path string")
    assert rows(G.expand_wildcards(routes, p.wildcard_rules(spark)), "path") == [("/v1/a",), ("/v2/a",)]
    f.write_text("[1")
    with pytest.raises(ValueError):
        Profile.load(spark, str(f))


def test_specs(spark, tmp_path):
    folder = str(tmp_path / "specs")
    assert load_specs(spark, folder) == []
    save_spec(spark, folder, "b", {"z": 1, "a": "é"})
    save_spec(spark, folder, "a", {})
    save_spec(spark, folder, "b", {"z": 2})
    assert load_specs(spark, folder) == [("a", {}), ("b", {"z": 2})]
    (tmp_path / "specs" / "c.json").write_text("[]")
    with pytest.raises(ValueError):
        load_specs(spark, folder)


def test_isolated(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["4", None, "x", "0"])], "seq int, v string").repartition(3)
    got = rows(isolated(df, "v", lambda v: str(12 // int(v)), "seq"))
    assert [g[1] for g in got] == ["3", None, None, None] and got[0][2] is None and got[3][2].startswith("ZeroDivisionError") and got[2][2].startswith("ValueError")
    assert isolated(df.limit(0), "v", str, "seq").count() == 0
    assert engine_identity() == engine_identity() and engine_identity().startswith(__version__ + "+")


def test_labels(spark):
    df = spark.createDataFrame([("Env", "data", "Pet"), (None, None, "Pet"), ("", None, None)], "e string, f string, s string")
    assert [r[0] for r in df.select(P.body_label(F.col("e"), F.col("f"), F.col("s"))).collect()] == ["Env{data: Pet}", "Pet", ""]
    r = spark.createDataFrame([("o", 2, "", 0), ("o", 3, "B", 7), ("o", 1, None, 7), ("o", 4, "A", 3), ("p", 1, "", 0)], "op_key string, seq int, label string, code int")
    assert rows(P.listing_rows(r)) == [("o", "B", [3, 7]), ("p", "", [])]
