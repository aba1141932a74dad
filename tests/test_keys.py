from pyspark.sql import functions as F

from factweave.functions import keys as K
from factweave.functions import text as T


def value(spark, f, *xs):
    names = [f"c{i}" for i in range(len(xs))]
    df = spark.createDataFrame([xs], ", ".join(f"{n} string" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("v")).first()["v"]


def test_paths(spark):
    for raw, want in [("////", ""), ("", ""), ("  ", ""), ("/a///b//", "/a//b"), ("/", "/"), ("a/", "/a"), ("//v1/x", "/v1/x"), (None, None)]:
        assert value(spark, K.normalize_path, raw) == want
    assert value(spark, K.template_path, "/a/:id/b/*rest/v*") == "/a/{id}/b/{rest}/v*"
    assert value(spark, T.generic_template, "/a/<int:id>/{n:int}/:x") == "/a/{id}/{n}/{x}"
    assert value(spark, lambda c: K.normalize_operation_key(c, True), " get \t //v1/:id/ ") == "GET /v1/{id}"
    assert value(spark, K.normalize_file_path, ".\\.\\a\\b.go") == "a/b.go"
    assert value(spark, K.normalize_hash, "SHA256:AbC") == "abc"


def test_short_hash(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return f"{h & 0xFFFFFF:06x}"

    for s in ("", "a", "héllo", "pkg/a.Type"):
        assert value(spark, K.short_hash, s) == fnv(s)


def test_text_functions(spark):
    assert value(spark, T.component_safe, "aé.b c") == "a__.b_c"
    assert value(spark, T.token_set, "b a1 b _x") == ["_x", "a1", "b"]
    assert value(spark, T.whole_word, "a foo.bar b", "foo.bar") is True
    assert value(spark, T.whole_word, "a foo_bar", "foo") is False
    assert value(spark, T.gap_detail, "a: b: c") == "c"
    assert value(spark, T.site_line, "x/y.go:12 err.F") == 12
    assert value(spark, T.site_line, "nothing") is None
    assert value(spark, T.first_paragraph, "a\nb\n\nc") == "a b"
    assert value(spark, lambda t: T.json_name(t, F.lit("Name")), 'json:"x,omitempty"') == "x"
    assert value(spark, lambda t: T.json_name(t, F.lit("Name")), 'json:"-"') is None
    assert value(spark, lambda t: T.json_name(t, F.lit("Name")), None) == "Name"
    assert value(spark, T.required_by_tag, 'json:"x" binding:"required"') is True
    assert value(spark, T.required_by_tag, 'json:"x,omitempty"') is False
    assert value(spark, T.status_number, "404") == 404 and value(spark, T.status_number, "x") == 0
    assert value(spark, T.operation_id, "GET", "/v1/pets/{id}") == "getV1PetsById"
    assert value(spark, T.scalar_type, "*int64") == "integer" and value(spark, T.map_value_type, "map[string]Pet") == "Pet"
    assert value(spark, T.brace_balance, 'if x == "{" { // {') == 1
    assert value(spark, lambda c: T.human_bytes(c.cast("long")), "2048") == "2.0 KiB"
    assert value(spark, lambda p: T.relative_path(p, F.lit("/r/")), "/r/a/b") == "a/b"
    paths = spark.createDataFrame([(p,) for p in ("/b", "/a-b", "/a/z", "/a", "/a/b/c")], "p string")
    assert [r.p for r in paths.orderBy(T.path_order(F.col("p"))).collect()] == ["/a", "/a/b/c", "/a/z", "/a-b", "/b"]
