"""Evidence, joins, ordering, graphs, metrics and validation on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import evidence as E
from factweave.operators import graph as G
from factweave.operators import joins as J
from factweave.operators import metrics as M
from factweave.operators import ordering as O
from factweave.operators import validate as V
from tests.helpers import rows


def test_evidence_gate(spark):
    facts = spark.createDataFrame([("ok", [("f", 2, "h"), ("f", 99, None), ("g", 1, None)]), ("lost", [("f", 1, "other")]), ("none", []), ("null", None)], "fact_id string, evidence array<struct<file: string, start_line: int, blob_sha: string>>")
    files = spark.createDataFrame([("f", "h", 3)], "file string, blob_sha string, n_lines int")
    kept, dropped = E.evidence_gate(facts, files)
    assert [(r.fact_id, [e.start_line for e in r.evidence]) for r in kept.collect()] == [("ok", [2])]
    assert rows(dropped) == [("lost",), ("none",), ("null",)]


def test_lines(spark):
    files = spark.createDataFrame([("f", "a\nb\nc\nd"), ("g", "")], "file string, text string")
    lines = E.source_lines(files)
    assert rows(E.line_windows(lines, 1), "file", "line_no", "window") == [("f", 1, "a\nb"), ("f", 2, "a\nb\nc"), ("f", 3, "b\nc\nd"), ("f", 4, "c\nd"), ("g", 1, "")]
    accepted = spark.createDataFrame([("f", 1)], "file string, line_no int")
    assert rows(E.missed_lines(lines, "[ab]", accepted), "file", "line_no") == [("f", 2)]
    assert rows(E.prefiltered_files(lines, ["a"])) == [("f",)]
    keys = spark.createDataFrame([("f", "c"), ("f", "zz")], "file string, k string")
    assert rows(E.first_match(lines, keys, "k"), "k", "line_no") == [("c", 3)]
    rules = spark.createDataFrame([("r2", 2, "JSON"), ("r1", 1, "gin.Context.JSON"), ("r3", 3, "x.OK")], "rule string, pos int, pattern string")
    symbols = spark.createDataFrame([("lib/gin.Context.JSON",), ("x.OK",), ("y.No",)], "symbol string")
    assert rows(E.first_rule(symbols, rules)) == [("lib/gin.Context.JSON", "r1"), ("x.OK", "r3")]


def test_parameters(spark):
    ops = spark.createDataFrame([("GET /a/{id}/{n}", "/a/{id}/{n}")], "op_key string, path string")
    params = spark.createDataFrame([("GET /a/{id}/{n}", "path", "id"), ("GET /a/{id}/{n}", "path", "gone"), ("GET /a/{id}/{n}", "query", "q")], "op_key string, location string, name string")
    assert rows(E.path_parameters(ops, params), "name", "state") == [("gone", "removed"), ("id", "kept"), ("n", "added")]


def test_joins(spark):
    a = spark.createDataFrame([("k1", "x"), ("k2", "x"), ("k3", None), ("k4", None)], "op_key string, state string")
    b = spark.createDataFrame([("k2", "conflict"), ("k3", None), ("k4", "x"), ("k5", "x")], "op_key string, state string")
    assert rows(J.graph_diff(a, b), "op_key", "kind", "breaking") == [("k1", "removed", True), ("k2", "changed", True), ("k4", "changed", False), ("k5", "added", False)]
    assert rows(J.orphans(a, b, "op_key")) == [("k5",)]
    codes = spark.createDataFrame([("p.A", 1), ("q.B", 2), ("r.B", 3)], "symbol string, code int")
    refs = spark.createDataFrame([("p.A",), ("z.A",), ("z.B",)], "ref string")
    assert rows(J.lookup_code(refs, codes)) == [("p.A", 1), ("z.A", 1), ("z.B", None)]
    reads = spark.createDataFrame([(1, [("grep", "a", "d")]), (2, [("grep", "a", "x")]), (3, []), (4, None)], "k int, reads array<struct<tool: string, args: string, digest: string>>")
    current = spark.createDataFrame([("grep", "a", "d")], "tool string, args string, digest string")
    assert rows(J.replay_valid(reads, current, "k")) == [(1, True), (2, False), (3, True), (4, True)]
    impl = spark.createDataFrame([("I", "Real", False), ("I", "Mock", True), ("K", "Only", True)], "interface string, implementation string, is_double boolean")
    assert rows(J.implementations(impl, impl)) == [("I", "Real"), ("K", "Only")]
    assert rows(J.first_per_key(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, o int, v string"), ["k"], ["o"])) == [("k", 1, "a")]


@pytest.mark.parametrize("size", [4, 64, 1000])
def test_ranges(spark, size):
    rng = random.Random(size)
    ranges = [(rng.choice("fg"), a, a + rng.randrange(-2, 90), f"r{i}") for i, a in enumerate(rng.choices(range(200), k=60))]
    points = [(rng.choice("fgh"), p) for p in rng.choices(range(220), k=80)]
    r = spark.createDataFrame(ranges, "file string, a int, b int, id string")
    p = spark.createDataFrame(points, "file string, line int").distinct()
    want = sorted((f, x, min(i for g, a, b, i in ranges if g == f and a <= x <= b)) for f, x in set(points) if any(g == f and a <= x <= b for g, a, b, _ in ranges))
    assert rows(J.point_in_range(p, r, ["file"], "line", "a", "b", "id", size)) == sorted(want, key=str)
    assert J.semi_in_range(p, r, ["file"], "line", "a", "b", size).count() == len(want)


def test_budget_and_packing(spark):
    rng = random.Random(2)
    data = [(i, rng.random() < 0.3, rng.randrange(1, 60) * 200, rng.choice("ab")) for i in range(200)]
    df = spark.createDataFrame([(i, f, "x" * n, g) for i, f, n, g in data], "i int, free boolean, t string, g string").repartition(7)
    cum, want = 0, []
    for i, f, *_ in data:
        cum += not f
        if f or cum <= 40:
            want.append((i,))
    assert rows(O.select_within_budget(df, F.col("free"), ["i"], 40), "i") == sorted(want, key=str)
    assert O.select_within_budget(df, F.col("free"), ["i"], 0).count() == 200
    for parts in (1, 7):
        packed = rows(O.pack(df.repartition(parts), "g", "i", "t"))
        for g in "ab":
            used, kept = 0, []
            for _, i, n, h in sorted((x[0], x[0], x[2], x[3]) for x in data):
                if h == g and used + min(n, 6000) <= 24000:
                    used += min(n, 6000)
                    kept.append((g, i, min(n, 6000)))
            assert [x for x in packed if x[0] == g] == sorted(kept, key=lambda x: tuple((y is not None, str(y)) for y in x))


def test_names_and_windows(spark):
    ids = spark.createDataFrame([("a/p.T",), ("b/q.T",), ("c/q.T",), ("a/p.U",)], "type_id string")
    got = dict(rows(O.component_names(ids)))
    assert (got["a/p.T"], got["b/q.T"], got["a/p.U"]) == ("T", "q.T", "U") and got["c/q.T"].startswith("T-")
    hits = spark.createDataFrame([("g", i) for i in range(170)], "g string, o int")
    assert rows(O.blocks(hits, ["g"], ["o"]).groupBy("block").count()) == [(0, 80), (1, 80), (2, 10)]
    lines = spark.createDataFrame([("f", 1, "const X = 4"), ("f", 2, "use"), ("f", 4, "use")], "file string, line_no int, text string")
    assert rows(O.constant_before(lines, r"= (\d+)"), "line_no", "constant") == [(1, None), (2, "4"), (4, None)]


def test_routes_under_mounts(spark):
    text = {("m", 1): "app.use('/api', v1)", ("m", 2): "v1.use(\"/v2/\", users)", ("r", 1): "users.get('/list/{id}', ctl.list)", ("r", 9): "users.post('items', (q) => 1)"}
    lines = spark.createDataFrame([(f, n, t) for (f, n), t in text.items()], "file string, line_no int, text string")
    given = [
        ("GET", "/list/{id}", 1, "ctl.list"), ("get", "/api/v2/list/{id}", 1, "ctl.list"), ("POST", "/api/v2/items", 9, "inline"), ("POST", "/v2/items", 9, None),
        ("GET", "/other/list/{id}", 1, "ctl.list"), ("GET", "/api/v2/list/{id}", 1, "missing"), ("CONNECT", "/list/{id}", 1, "list"), ("GET", "/list/{id}", 7, "list"), ("GET", "/x/{id}", 1, "list"),
    ]
    routes = spark.createDataFrame([("r", *g) for g in given], "file string, method string, path string, line int, handler string")
    kept = E.verify_routes(routes, lines)
    assert kept.columns == routes.columns
    assert rows(kept, "method", "path", "line", "handler") == rows(routes.limit(4), "method", "path", "line", "handler")


def bfs(edges, seeds, cap):
    depth = {s: 0 for s in seeds}
    todo = list(seeds)
    for n in todo:
        if cap is None or depth[n] < cap:
            for a, b in edges:
                if a == n and b not in depth:
                    depth[b] = depth[n] + 1
                    todo.append(b)
    return depth


@pytest.mark.parametrize("cap", [0, 2, None])
def test_reach(spark, cap):
    rng = random.Random(3)
    edges = [(str(rng.randrange(25)), str(rng.randrange(25))) for _ in range(45)] + [("1", "1"), (None, "2")]
    e = spark.createDataFrame(edges, "caller string, callee string")
    seeds = spark.createDataFrame([("1",), ("7",)], "node string")
    assert dict(rows(G.forward_reach(e, seeds, cap))) == bfs(edges, ["1", "7"], cap)


def test_reach_of_whole_table(spark, tmp_path):
    from __spark_entry__ import oracle_sql, queries

    pairs = [(k, k, 10.0 + k % 40) for k in range(1, 10)] + [(k + 1, k, 20.0) for k in range(1, 10)] + [(40, 41, 1.0)]
    spark.createDataFrame(pairs * 2, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    both = [e for s, p, _ in pairs for e in ((f"s{s}", f"p{p}"), (f"p{p}", f"s{s}"))]
    got = dict(rows(queries()["forward_reach"](spark, str(tmp_path))))
    assert got == bfs(both, ["s1"], 12)
    assert max(got.values()) == 12 and got["s7"] == 12 and "p7" not in got and len(got) == 13
    assert "depth < 4" in oracle_sql()["text_reach"]


def test_graph_rest(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "use string, def string")
    labels = spark.createDataFrame([("z", "nil")], "node string, label string")
    assert rows(G.propagate_labels(e, labels)) == [("x", "nil"), ("y", "nil"), ("z", "nil")]
    routes = spark.createDataFrame([("ALL", "/a"), ("get", "/b")], "method string, path string")
    out = rows(G.fan_out_methods(routes), "path", "method", "unresolved")
    assert len(out) == 10 and ("/a", "CONNECT", "unsupported method") in out and ("/b", "GET", "") in out
    wild = spark.createDataFrame([("/api/v*/x",), ("/api/v1/y",), ("/files/*",), ("/r/*",)], "path string")
    rules = spark.createDataFrame([("/r/*", ["/r/a", "/r/b"])], "pattern string, expansions array<string>")
    assert rows(G.expand_wildcards(wild, rules)) == [("/api/v*/x", "/api/v1/x"), ("/api/v1/y", "/api/v1/y"), ("/files/*", "/files/{wildcard}"), ("/r/*", "/r/a"), ("/r/*", "/r/b")]


def test_metrics(spark):
    s = spark.createDataFrame([("o", "a"), ("o", "a"), ("o", "b"), ("p", "c")], "op string, v string")
    t = spark.createDataFrame([("o", "a"), ("q", "d")], "op string, v string")
    assert rows(M.set_counts(s, t, ["op"], "v")) == [("o", 1, 1, 0), ("p", 0, 1, 0), ("q", 0, 0, 1)]
    assert rows(M.micro_average(M.set_counts(s, t, ["op"], "v"))) == [(1, 2, 1, 1 / 3, 0.5, pytest.approx(0.4))]
    empty = s.limit(0)
    assert rows(M.micro_average(M.set_counts(empty, empty, ["op"], "v"))) == [(0, 0, 0, 1.0, 1.0, 1.0)]
    assert rows(M.route_metrics(empty, empty, ["op"])) == [(0, 0, 0, 1.0, 0.0)]
    assert rows(M.list_difference(s, t, "v"), "v") == [("b",), ("c",)]
    assert rows(M.intersection_count(s, t, "v")) == [(2,)]
    truth = spark.createDataFrame([("o", "data|object|required", "data"), ("o", "data.id|integer|required", "data.id")], "op string, t string, path string")
    spec = spark.createDataFrame([("o", "data.extra|string|optional", "data.extra"), ("o", "data.id|string|optional", "data.id"), ("o", "other|string|optional", "other")], "op string, t string, path string")
    opened = spark.createDataFrame([("o", "data")], "op string, prefix string")
    assert rows(M.tolerate_open_objects(spec, truth, opened, ["op"], "path", "t"), "path") == [("data.id",), ("other",)]
    pairs = spark.createDataFrame([("o", "200:0")], "op string, pair string")
    assert rows(M.envelope_recall(pairs, pairs.limit(0), ["op"])) == [(0.0,)]


def test_validation(spark):
    ops = spark.createDataFrame([("GET /pets/{id}", "get", "/pets/{id}", "matched", []), ("bad", "GET", "/x", "conflict", ["response: none"])], "op_key string, method string, path string, state string, gaps array<string>")
    c = spark.createDataFrame(
        [("GET /pets/{id}", "response", "900", 1, None, "#/s/Pet", "1"), ("GET /pets/{id}", "param", "q", 1, "nowhere", None, "1"), ("GET /pets/{id}", "param", "q", 2, "query", None, "2")],
        "op_key string, slot_kind string, slot_key string, seq long, location string, schema_ref string, value_json string",
    ).withColumn("status_code", F.lit(None).cast("string"))
    schemas = spark.createDataFrame([("Owner", True)], "schema_id string, unknown boolean")
    found = V.diagnostics(ops, c, schemas)
    assert [r.code for r in found.collect()] == ["operation_conflict", "operation_identity", "operation_unresolved", "parameter_conflict", "parameter_location", "path_parameter_missing", "response_status", "schema_reference_missing", "schema_unknown"]
    assert rows(V.diagnostics(None, c, schemas)) == [("graph_missing", "graph is missing")]
    confident = ops.withColumn("confidence", F.lit(0.5))
    assert rows(V.gates(found, confident, True, True, 0.8)) == [("confidence", 2), ("conflict", 2), ("unresolved", 4)]
    assert rows(V.gates(found, confident)) == []
    with pytest.raises(ValueError):
        V.guard(0, 1, 0, 0, 0)
    assert V.evaluation_failures({"recall": 0.5, "hallucination": 0.2}, 0.9) == ["recall", "hallucination"]


def test_attachments(spark):
    from factweave.functions.text import token_set
    from factweave.operators import candidates as C

    ops = spark.createDataFrame([("a", "", None), ("b", "own", "own")], "fact_id string, summary string, description string")
    extra = spark.createDataFrame([("a:enrich", "s", "d"), ("b:enrich", "s", "d")], "fact_id string, summary string, description string")
    assert rows(J.attach_enrichment(ops, extra)) == [("a", "s", "d"), ("b", "own", "own")]
    schemas = spark.createDataFrame([("Pet",)], "schema_id string")
    refs = spark.createDataFrame([("#/s/Pet",), ("Gone",), ("",), (None,)], "ref string")
    assert rows(J.resolve_references(refs, schemas, "ref")) == [(None, False), ("", False), ("#/s/Pet", False), ("Gone", True)]
    catalog = spark.createDataFrame([("errs.TooMany",), ("errs.Unused",)], "symbol string")
    assert rows(J.catalog_subset(catalog, spark.createDataFrame([("return errs.TooMany(x)",), (None,)], "text string"))) == [("errs.TooMany",)]
    routes = spark.createDataFrame([("o", ["log", "jwt", "key", "jwt2"])], "op_key string, middleware array<string>")
    mapping = spark.createDataFrame([("jwt", "bearer"), ("jwt2", "bearer"), ("key", "apiKey")], "middleware string, scheme string")
    assert rows(J.security_of(routes, mapping)) == [("o", ["bearer", "apiKey"])]
    hits = spark.createDataFrame([("o", "T", 1, False, "200", "b"), ("o", "T", 1, False, "200", "a"), ("o", "T", None, None, "200", None)], "op_key string, type string, code int, failure boolean, status string, sink string")
    assert rows(C.response_matrix(hits), "code", "hits", "sinks") == [(None, 1, ""), (1, 2, "a, b")]
    conf = spark.createDataFrame([("o", 0.9), ("p", 0.8)], "op_key string, confidence double")
    parts = spark.createDataFrame([("o", 0.4, True), ("o", 0.7, False)], "op_key string, confidence double, envelope boolean")
    assert rows(C.propagate_confidence(conf, parts)) == [("o", 0.7), ("p", 0.8)]
    ev = spark.createDataFrame([("o", [("source",), ("llm",)]), ("o", [("source",)]), ("p", None)], "op_key string, evidence array<struct<source: string>>")
    assert [(r.op_key, [e.source for e in r.evidence]) for r in C.operation_evidence(ev).collect()] == [("o", ["llm", "source"])]
    constants = spark.createDataFrame([("const", "x/errs"), ("const", "x/myerrs"), ("func", "errs")], "kind string, package string")
    assert rows(E.error_catalog(constants, "errs")) == [("const", "x/errs")]
    source = spark.createDataFrame([("o", 'q("name") limit')], "op_key string, text string").withColumn("tokens", token_set(F.col("text")))
    findings = spark.createDataFrame([("o", "limit", "query", "integer", "", 200), ("o", "made_up", "query", "integer", "", 200), ("o", "name", "moon", "string", "", 200), ("z", "limit", "query", "string", "", 200)], "op_key string, name string, location string, type string, format string, status int")
    good, bad = E.accepted_findings(findings, source)
    assert rows(good, "name") == [("limit",)] and bad.count() == 3
