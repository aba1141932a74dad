"""Queries that apply the reference's operators to the tables of its own domain, with DuckDB twins.

Where a table lacks an operator's input (middleware, findings), the docstring says what stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import keys as K
from factweave.functions import text as T
from factweave.operators import candidates as C
from factweave.operators import compile as P
from factweave.operators import evidence as E
from factweave.operators import graph as G
from factweave.operators import joins as J
from factweave.operators import metrics as M
from factweave.operators import ordering as O
from factweave.operators import schema_tree as S
from factweave.operators import validate as V
from factweave.plans.reference import _CANDIDATES, _DIAGNOSED, _LINES, diagnosed_graph, newest_lines, operation_paths, schema_trees, slot_candidates
from factweave.plans.registry import Registry
from factweave.plans.schema_sql import FLAT_TREES
from factweave.sources import documents as D
from factweave.tables import cut_lineage, table

DOMAIN = Registry()

_NAME = r"regexp_extract(symbol_id, '([^.]+)$', 1)"


def symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The symbol index, repeated rows once, with ``name``, the last part of the id."""
    return table(spark, d, "symbols", *columns).distinct().withColumn("name", F.regexp_extract("symbol_id", r"([^.]+)$", 1))


# ---- sources, filters, verification -------------------------------------------------------------


@DOMAIN.add(f"WITH {_LINES} SELECT DISTINCT file FROM l WHERE regexp_matches(text, 'errs?[.]New') AND regexp_matches(text, 'return') ORDER BY file LIMIT 200")
def candidate_files(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 files (by id) with a line that returns a new error."""
    return E.prefiltered_files(newest_lines(spark, d), ["errs?[.]New", "return"])


@DOMAIN.add(
    rf"""WITH {_LINES}, k AS (SELECT DISTINCT file_id AS file, {_NAME} AS name FROM symbols WHERE file_id IS NOT NULL)
SELECT k.file, k.name, min(line_no) AS line_no FROM k JOIN l USING (file) WHERE name <> '' AND (list_contains(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), name) OR contains(text, '"' || name || '"') OR contains(text, '''' || name || '''')) GROUP BY ALL"""
)
def name_locations(spark: SparkSession, d: str) -> DataFrame:
    """The first line of its file that has a symbol's name."""
    keys = symbols(spark, d, "symbol_id", "file_id").where("file_id IS NOT NULL").select(F.col("file_id").alias("file"), "name")
    return E.first_match(newest_lines(spark, d), keys, "name")


@DOMAIN.add(
    """WITH f AS (SELECT DISTINCT file_id, blob_sha, captured_at, content FROM source_files), n AS (SELECT DISTINCT ON (file_id) file_id, blob_sha FROM f ORDER BY file_id, captured_at DESC, content DESC)
SELECT f.file_id || ' ' || epoch_us(captured_at) AS fact_id, count(*) AS evidence FROM f JOIN n USING (file_id) WHERE coalesce(f.blob_sha, '') = '' OR f.blob_sha IS NOT DISTINCT FROM n.blob_sha GROUP BY 1"""
)
def evidence_hashes(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2: captures whose hash is that of the newest capture of their file; others are stale."""
    f = table(spark, d, "source_files", "file_id", "blob_sha", "captured_at", "content").distinct()
    newest = f.groupBy(F.col("file_id").cast("string").alias("file")).agg(F.max_by("blob_sha", F.struct("captured_at", "content")).alias("blob_sha")).withColumn("n_lines", F.lit(1))
    place = F.struct(F.col("file_id").cast("string").alias("file"), F.lit(1).alias("start_line"), "blob_sha")
    facts = f.groupBy(F.concat_ws(" ", F.col("file_id").cast("string"), F.unix_micros("captured_at").cast("string")).alias("fact_id")).agg(F.collect_list(place).alias("evidence"))
    kept, _ = E.evidence_gate(facts, newest)
    return kept.select("fact_id", F.size("evidence").cast("long").alias("evidence"))


@DOMAIN.add(
    rf"""WITH {_CANDIDATES}, o AS (SELECT DISTINCT op_key, substr(op_key, strpos(op_key, ' ') + 1) AS path FROM c), w AS (SELECT DISTINCT op_key, unnest(regexp_extract_all(path, '\{{([^{{}}/]+)\}}', 1)) AS name FROM o),
g AS (SELECT DISTINCT op_key, slot_key AS name FROM c WHERE slot_kind = 'param' AND param.param_in = 'path' AND slot_key IS NOT NULL)
SELECT coalesce(w.op_key, g.op_key) AS op_key, coalesce(w.name, g.name) AS name, CASE WHEN g.name IS NULL THEN 'added' WHEN w.name IS NULL THEN 'removed' ELSE 'kept' END AS state FROM w FULL JOIN g ON w.op_key = g.op_key AND w.name = g.name"""
)
def path_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Template names without a path parameter, path parameters outside the template, and those that fit."""
    c = slot_candidates(spark, d)
    ops = c.select("op_key", F.regexp_extract("op_key", r"^\S+ (.*)$", 1).alias("path")).distinct()
    given = c.where("slot_kind = 'param' AND slot_key IS NOT NULL").select("op_key", F.col("param.param_in").alias("location"), F.col("slot_key").alias("name"))
    return E.path_parameters(ops, given)


_FORMATS = "('date-time', 'date', 'int64', 'int32', 'double', 'float', 'byte', 'binary', 'uuid')"


@DOMAIN.add(
    f"""SELECT DISTINCT cand_id, coalesce(param.param_in IN ('path', 'query', 'header', 'cookie'), true) AND coalesce(param.type IN ('string', 'integer', 'number', 'boolean'), true)
 AND (coalesce(param.format, '') = '' OR param.format IN {_FORMATS}) AND coalesce(try_cast(response.status AS INT) BETWEEN 100 AND 599, true) AS valid FROM candidates"""
)
def valid_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose location, type, format and status lie in the closed sets."""
    c = table(spark, d, "candidates", "cand_id", "param", "response").select("cand_id", "param.param_in", "param.type", "param.format", F.col("response.status").try_cast("int").alias("status")).distinct()
    return c.select("cand_id", E.valid_proposal(F.col("param_in"), F.col("type"), F.col("format"), F.col("status")).alias("valid"))


@DOMAIN.add(
    r"""WITH s AS (SELECT DISTINCT snippet_id, code FROM source_snippets WHERE code IS NOT NULL), w AS (SELECT snippet_id, regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*') AS tokens, regexp_extract_all(code, '-?\d+(?:\.\d+)?') AS numbers FROM s)
SELECT snippet_id, list_contains(tokens, 'provisional') AND list_contains(tokens, 'default') AS enum_holds, CASE WHEN list_contains(numbers, '404') THEN '404' END AS bound FROM w"""
)
def verified_constraints(spark: SparkSession, d: str) -> DataFrame:
    """An enum of two values holds if the source has both, a bound is dropped if it lacks it."""
    s = table(spark, d, "source_snippets", "snippet_id", "code").where("code IS NOT NULL").distinct()
    enum = F.array(F.lit("provisional"), F.lit("default"))
    return s.select("snippet_id", E.verified_enum(enum, T.token_set(F.col("code"))).alias("enum_holds"), E.verified_bound(F.lit("404"), T.number_set(F.col("code"))).alias("bound"))


@DOMAIN.add(r"SELECT type_id AS tree_id FROM type_fields GROUP BY 1 HAVING bool_and(coalesce(json_name <> '' AND regexp_matches(type_str, '^\*?(string|error|u?int(8|16|32|64)?|byte|rune|float(32|64)|bool)$'), false))")
def verified_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Types all of whose fields have a name and a scalar type; one other field rejects the whole."""
    f = table(spark, d, "type_fields", "type_id", "type_str", "json_name").distinct()
    return E.verified_shapes(f.select(F.col("type_id").alias("tree_id"), T.scalar_type(F.col("type_str")).alias("type"), (F.col("json_name") != "").alias("named"), F.lit(1).alias("depth")))


@DOMAIN.add(
    rf"""WITH s AS (SELECT DISTINCT symbol_id AS symbol, kind, file_id FROM symbols), r AS (SELECT regexp_extract(symbol, '([^/]+)$', 1) AS pattern, min(file_id) AS pos, regexp_extract(symbol, '([^./]+)$', 1) AS last FROM s WHERE kind = 'func' GROUP BY 1, 3)
SELECT symbol, arg_min(pattern, (pos, pattern)) AS rule FROM s JOIN r ON regexp_extract(symbol, '([^./]+)$', 1) = last WHERE symbol = pattern OR ends_with(symbol, '/' || pattern) GROUP BY symbol"""
)
def first_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that names a symbol by package suffix; functions stand for the rules."""
    s = symbols(spark, d, "symbol_id", "kind", "file_id").withColumnRenamed("symbol_id", "symbol")
    rules = s.where("kind = 'func'").groupBy(F.regexp_extract("symbol", r"([^/]+)$", 1).alias("pattern")).agg(F.min("file_id").alias("n"))
    return E.first_rule(s.select("symbol").distinct(), rules.select(F.col("pattern").alias("rule"), "pattern", F.struct("n", "pattern").alias("pos")))


@DOMAIN.add(f"WITH {_CANDIDATES}, o AS (SELECT op_key, coalesce(min(nullif(confidence, 0)), 0) AS confidence, bool_or(status = 'conflict') AS bad FROM c GROUP BY 1) SELECT op_key, confidence FROM o WHERE confidence < 0.8 AND bad")
def listed_operations(spark: SparkSession, d: str) -> DataFrame:
    """Conflicting operations of low confidence."""
    rows = slot_candidates(spark, d).select("op_key", "seq", F.col("status").alias("state"), "confidence", F.lit("").alias("operation_id"), F.lit("").alias("summary"), F.lit("").alias("description"))
    return E.list_operations(C.merge_operations(rows), low_confidence=0.8, conflicts=True).select("op_key", "confidence")


@DOMAIN.add(
    r"""WITH j AS (SELECT DISTINCT entry_id, text::JSON AS t FROM cache_entries WHERE json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT'),
g AS (SELECT entry_id, t->>'$.operation' AS op, list_filter(from_json(t->'$.gaps', '["VARCHAR"]'), lambda x: NOT starts_with(x, 'In practice')) AS gaps FROM j WHERE json_type(t, '$.gaps') = 'ARRAY')
SELECT entry_id, op || ': ' || array_to_string(gaps, '; ') AS gap FROM g WHERE len(gaps) > 0 AND op IS NOT NULL"""
)
def answer_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the answers that are JSON objects, without those of one prefix."""
    e = table(spark, d, "cache_entries", "entry_id", "text").distinct()
    v = e.select("entry_id", F.try_parse_json("text").alias("v"))
    ops = v.select("entry_id", F.try_variant_get("v", "$.operation", "string").alias("op_key"), E.drop_gaps(F.try_variant_get("v", "$.gaps", "array<string>"), "In practice").alias("gaps")).where("op_key IS NOT NULL AND gaps IS NOT NULL")
    return E.gap_rows(ops.withColumn("op_key", F.concat(F.col("entry_id").cast("string"), F.lit(" "), "op_key"))).select(F.regexp_extract("gap", r"^(\d+) ", 1).cast("long").alias("entry_id"), F.regexp_replace("gap", r"^\d+ ", "").alias("gap"))


@DOMAIN.add("SELECT DISTINCT entry_id, cache_key, usage_in, usage_out FROM cache_entries")
def answer_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the answers; bodies are never selected."""
    return E.redacted(table(spark, d, "cache_entries"), ["entry_id", "cache_key", "usage_in", "usage_out"]).distinct()


@DOMAIN.add("SELECT symbol_id FROM (SELECT DISTINCT symbol_id, kind, pkg FROM symbols) WHERE kind = 'type' AND regexp_matches(pkg, '(^|/)internal/api/[^/]*$') AND ends_with(pkg, '/' || regexp_extract(pkg, '(internal/api/[^/]*)$', 1))")
def api_types(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of one kind in packages that end with a suffix; types of ``internal/api/...``."""
    y = table(spark, d, "symbols", "symbol_id", "kind", "pkg").distinct()
    rows = y.where("kind = 'type'").select("symbol_id", F.lit("const").alias("kind"), F.regexp_replace("pkg", r"(internal/api)/[^/]*$", "$1").alias("package"))
    return E.error_catalog(rows, "internal/api").select("symbol_id")


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT op_key, seq, response.code AS code, CASE WHEN coalesce(response.scalar_type, '') <> '' THEN '[]' || response.scalar_type WHEN coalesce(response.schema, '') <> '' THEN response.schema WHEN coalesce(response.map_value_type, '') <> '' THEN 'map[string]' || response.map_value_type ELSE '' END AS label FROM c WHERE slot_kind = 'response')
SELECT op_key, coalesce(arg_min(label, seq) FILTER (WHERE label <> ''), '') AS response, coalesce(array_to_string(list_sort(list_distinct(list(code) FILTER (WHERE code <> 0))), ','), '') AS error_codes FROM r GROUP BY 1"""
)
def operation_listing(spark: SparkSession, d: str) -> DataFrame:
    """First label and codes of each operation's responses; scalar types stand for array elements."""
    r = slot_candidates(spark, d).where("slot_kind = 'response'")
    rows = r.select("op_key", "seq", P.response_label(F.col("response.scalar_type"), F.col("response.schema"), F.col("response.map_value_type")).alias("label"), "response.code")
    return P.listing_rows(rows).select("op_key", "response", F.array_join("error_codes", ",").alias("error_codes"))


# ---- joins ---------------------------------------------------------------------------------------


@DOMAIN.add(
    """WITH t AS (SELECT type_id, min(doc) AS s, max(doc) AS e FROM type_fields GROUP BY 1), y AS (SELECT DISTINCT symbol_id, coalesce(doc, '') AS doc FROM symbols WHERE kind = 'type')
SELECT symbol_id AS fact_id, coalesce(nullif(doc, ''), s) AS summary, e AS description FROM y LEFT JOIN t ON type_id = symbol_id"""
)
def attached_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Types without documentation get a summary and description from rows of ``id:enrich``; their fields' docs."""
    types = table(spark, d, "symbols", "symbol_id", "kind", "doc").where("kind = 'type'").select(F.col("symbol_id").alias("fact_id"), F.coalesce("doc", F.lit("")).alias("summary"), F.lit("").alias("description")).distinct()
    enrichment = table(spark, d, "type_fields", "type_id", "doc").groupBy(F.concat("type_id", F.lit(":enrich")).alias("fact_id")).agg(F.min("doc").alias("summary"), F.max("doc").alias("description"))
    return J.attach_enrichment(types, enrichment).select("fact_id", "summary", "description")


@DOMAIN.add(f"WITH {_CANDIDATES}, k AS (SELECT DISTINCT body.schema AS id FROM c WHERE body.schema IS NOT NULL) SELECT seq, coalesce(response.schema, '') <> '' AND regexp_extract(response.schema, '([^/]*)$', 1) NOT IN (SELECT id FROM k) AS unknown FROM c WHERE slot_kind = 'response'")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose schema no request body has."""
    c = slot_candidates(spark, d)
    known = c.where("body.schema IS NOT NULL").select(F.col("body.schema").alias("schema_id"))
    return J.resolve_references(c.where("slot_kind = 'response'").select("seq", F.col("response.schema").alias("ref")), known, "ref").select("seq", "unknown")


@DOMAIN.add(
    r"""WITH c AS (SELECT symbol_id AS symbol, min(line) AS code, regexp_extract(symbol_id, '([^./]+)$', 1) AS last FROM symbols GROUP BY 1, 3), u AS (SELECT last, min(code) AS code FROM c GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT DISTINCT regexp_extract(site, '^\S+\s+(.*)$', 1) AS ref FROM site_contexts WHERE site IS NOT NULL UNION SELECT symbol FROM c)
SELECT ref, coalesce(c.code, u.code) AS code FROM r LEFT JOIN c ON symbol = ref LEFT JOIN u ON u.last = regexp_extract(ref, '([^./]+)$', 1)"""
)
def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The line of the same symbol, else of the only symbol with that last segment."""
    codes = table(spark, d, "symbols", "symbol_id", "line").groupBy(F.col("symbol_id").alias("symbol")).agg(F.min("line").alias("code"))
    sites = table(spark, d, "site_contexts", "site").where("site IS NOT NULL").select(T.site_expression(F.col("site")).alias("ref"))
    return J.lookup_code(sites.unionByName(codes.select(F.col("symbol").alias("ref"))).distinct(), codes)


@DOMAIN.add(r"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*')) AS t FROM site_contexts) SELECT DISTINCT symbol_id AS symbol FROM symbols WHERE regexp_extract(symbol_id, '([^./]+)$', 1) IN (SELECT t FROM t)")
def catalog_names(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name is a token of some source window."""
    catalog = table(spark, d, "symbols", F.col("symbol_id").alias("symbol")).distinct()
    return J.catalog_subset(catalog, table(spark, d, "site_contexts", F.col("code").alias("text")))


@DOMAIN.add(
    """WITH e AS (SELECT cand_id, unnest(evidence) AS e FROM (SELECT DISTINCT ON (cand_id) * FROM candidates)), p AS (SELECT cand_id, e.file AS file, e.start_line AS line FROM e WHERE e.file IS NOT NULL),
r AS (SELECT file_path AS file, line * 20 AS a, end_line * 20 AS b FROM symbols WHERE end_line IS NOT NULL)
SELECT cand_id, p.file, p.line FROM p WHERE EXISTS (SELECT 1 FROM r WHERE regexp_replace(r.file, '_[0-9]+[.]', '.') = p.file AND p.line BETWEEN a AND b)"""
)
def focus_containment(spark: SparkSession, d: str) -> DataFrame:
    """C11: evidence that lies in some symbol's range of a file of that name; ranges are stretched, for the
    claims' line numbers are larger than those of the files."""
    e = table(spark, d, "candidates", "cand_id", "evidence").dropDuplicates(["cand_id"]).select("cand_id", F.explode("evidence").alias("e"))
    points = e.where("e.file IS NOT NULL").select("cand_id", "e.file", F.col("e.start_line").alias("line"))
    y = table(spark, d, "symbols", "file_path", "line", "end_line").where("end_line IS NOT NULL").distinct()
    ranges = y.select(F.regexp_replace("file_path", r"_[0-9]+[.]", ".").alias("file"), (F.col("line") * 20).alias("a"), (F.col("end_line") * 20).alias("b"))
    return J.semi_in_range(points, ranges, ["file"], "line", "a", "b", 256)


@DOMAIN.add("SELECT r_regionkey AS region, s_suppkey AS supplier, 2 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA' AND s_acctbal < 0".replace("2 AS depth", "1 AS depth"))
def sink_trace(spark: SparkSession, d: str) -> DataFrame:
    """Edges from what a region reaches to sinks, suppliers in debt; the depth is the caller's."""
    nation, supplier = table(spark, d, "nation", "n_nationkey", "n_regionkey"), table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("caller"), name("n", "n_nationkey").alias("callee")).unionByName(supplier.select(name("n", "s_nationkey").alias("caller"), name("s", "s_suppkey").alias("callee")))
    asia = table(spark, d, "region", "r_regionkey", "r_name").where("r_name = 'ASIA'")
    hits = G.trace_sinks(edges, asia.select(name("r", "r_regionkey").alias("node")), supplier.where("s_acctbal < 0").select(name("s", "s_suppkey").alias("symbol")))
    return hits.crossJoin(F.broadcast(asia.select(F.col("r_regionkey").alias("region")))).select("region", F.expr("CAST(substring(callee, 2) AS LONG)").alias("supplier"), "depth")  # one row


@DOMAIN.add(
    """WITH i AS (SELECT DISTINCT type_str AS interface, type_id AS implementation, nullable AS double FROM type_fields), r AS (SELECT interface, bool_or(NOT double) AS real FROM i GROUP BY 1)
SELECT DISTINCT interface, implementation FROM i JOIN r USING (interface) WHERE NOT real OR NOT double"""
)
def interface_implementations(spark: SparkSession, d: str) -> DataFrame:
    """C14: owners of fields by type; nullable fields stand for test doubles, which count where there is nothing else."""
    i = table(spark, d, "type_fields", "type_str", "type_id", "nullable").select(F.col("type_str").alias("interface"), F.col("type_id").alias("implementation"), F.col("nullable").alias("is_double")).distinct()
    return J.implementations(i, i).distinct()


_SCHEMES = {"grep": "apiKey", "read_symbol": "bearer", "read_lines": "bearer"}


@DOMAIN.add(
    """WITH m AS (SELECT entry_id, unnest(list_transform(reads, lambda r: r.tool)) AS tool, generate_subscripts(reads, 1) AS pos FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries)),
s AS (SELECT entry_id, CASE tool WHEN 'grep' THEN 'apiKey' WHEN 'read_symbol' THEN 'bearer' WHEN 'read_lines' THEN 'bearer' END AS scheme, min(pos) AS pos FROM m GROUP BY ALL)
SELECT entry_id AS op_key, string_agg(scheme, ',' ORDER BY pos) AS schemes FROM s WHERE scheme IS NOT NULL GROUP BY 1"""
)
def route_security(spark: SparkSession, d: str) -> DataFrame:
    """C17: schemes of a route's middleware, each once, in its order; the tools an answer used stand for it."""
    routes = table(spark, d, "cache_entries", "entry_id", "reads").dropDuplicates(["entry_id"]).select(F.col("entry_id").alias("op_key"), F.transform("reads", lambda r: r["tool"]).alias("middleware"))
    mapping = spark.createDataFrame(list(_SCHEMES.items()), "middleware string, scheme string")
    return J.security_of(routes, mapping).select("op_key", F.array_join("schemes", ",").alias("schemes"))


@DOMAIN.add("WITH a AS (SELECT field_name, min(json_name) AS j FROM type_fields WHERE json_name IS NOT NULL GROUP BY 1) SELECT DISTINCT field_id, coalesce(j, f.field_name) AS field_name FROM type_fields f LEFT JOIN a USING (field_name)")
def serialised_names(spark: SparkSession, d: str) -> DataFrame:
    """Fields by their serialised name."""
    f = table(spark, d, "type_fields", "field_id", "field_name", "json_name").distinct()
    aliases = f.where("json_name IS NOT NULL").groupBy(F.col("field_name").alias("source_name")).agg(F.min("json_name").alias("serialised"))
    return J.rename(f.select("field_id", "field_name"), aliases, "field_name")


# ---- aggregation ---------------------------------------------------------------------------------

_COLLISIONS = """v AS (SELECT DISTINCT raw_id AS seq, repo AS source, regexp_extract(schema_id, '([^.]*)$', 1) AS name, schema_json AS json FROM raw_schemas WHERE schema_id IS NOT NULL AND schema_json IS NOT NULL AND repo IS NOT NULL),
k AS (SELECT name, arg_min(json, seq) AS kept FROM v GROUP BY 1), x AS (SELECT v.*, json IS DISTINCT FROM kept AS collides, CASE WHEN json IS DISTINCT FROM kept THEN source || '.' || name ELSE name END AS new_name FROM v JOIN k USING (name))"""


def collisions(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_schemas", "raw_id", "schema_id", "repo", "schema_json").where("schema_id IS NOT NULL AND schema_json IS NOT NULL AND repo IS NOT NULL").distinct()
    return C.schema_collisions(raw.select(F.regexp_extract("schema_id", r"([^.]*)$", 1).alias("name"), F.col("repo").alias("source"), F.col("raw_id").alias("seq"), F.col("schema_json").alias("json")))


@DOMAIN.add(f"WITH {_COLLISIONS} SELECT name, source, new_name, count(*) AS versions FROM x GROUP BY ALL")
def schema_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Schemas of one name and other JSON get the name of their repo before theirs."""
    return collisions(spark, d).groupBy("name", "source", "new_name").agg(F.count("*").alias("versions"))


@DOMAIN.add(f"WITH {_COLLISIONS} SELECT DISTINCT 'schema_name_collision' AS code, 'schema ' || name || ' of ' || source || ' differs from another of that name and becomes ' || new_name AS message FROM x WHERE collides")
def collision_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The diagnostics of renamed schemas."""
    return C.collision_diagnostics(collisions(spark, d))


@DOMAIN.add(f"WITH {_CANDIDATES}, r AS (SELECT op_key, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' ELSE coalesce(arg_max(status, (rank, -seq)), 'unresolved') END AS state FROM c GROUP BY op_key, slot_kind, slot_key) SELECT count(*) AS slots, count(DISTINCT op_key) AS operations, count(*) FILTER (WHERE state = 'conflict') AS conflicts, count(*) FILTER (WHERE state = 'unresolved') AS unresolved, (SELECT count(DISTINCT type_id) FROM type_fields WHERE type_str = 'any') AS unknown_schemas FROM r")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Slots, operations, conflicts, and unknown schemas (types with a field of any type)."""
    schemas = table(spark, d, "type_fields", "type_id", "type_str").groupBy("type_id").agg(F.bool_or(F.col("type_str") == "any").alias("unknown"))
    return C.graph_statistics(C.resolve(slot_candidates(spark, d)), schemas)


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, h AS (SELECT op_key, response.schema AS type, response.code AS code, response.failure AS failure, response.status AS status, response.sink AS sink FROM c WHERE slot_kind = 'response')
SELECT op_key, type, code, failure, status, count(*) AS hits, coalesce(string_agg(DISTINCT sink, ', ' ORDER BY sink), '') AS sinks FROM h GROUP BY ALL"""
)
def response_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Responses by type, code, failure and status with their sinks."""
    r = slot_candidates(spark, d).where("slot_kind = 'response'").select("op_key", F.col("response.schema").alias("type"), "response.code", "response.failure", "response.status", "response.sink")
    return C.response_matrix(r)


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, o AS (SELECT op_key, max(confidence) AS confidence FROM c GROUP BY 1), s AS (SELECT op_key, min(confidence) AS least FROM c WHERE slot_kind <> 'param' AND coalesce(body.envelope, response.envelope) IS NULL GROUP BY 1)
SELECT op_key, least(confidence, least) AS confidence FROM o LEFT JOIN s USING (op_key)"""
)
def propagated_confidence(spark: SparkSession, d: str) -> DataFrame:
    """An operation's confidence is at most the least of its bodies' and responses', envelopes aside."""
    c = slot_candidates(spark, d)
    children = c.where("slot_kind <> 'param'").select("op_key", "confidence", F.coalesce("body.envelope", "response.envelope").isNotNull().alias("envelope"))
    return C.propagate_confidence(c.groupBy("op_key").agg(F.max("confidence").alias("confidence")), children)


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, o AS (SELECT op_key, min(confidence) FILTER (WHERE slot_kind = 'param') AS p, coalesce(max(confidence), 0) AS m, bool_or(status = 'unresolved') AS gap FROM c GROUP BY 1),
k AS (SELECT op_key, least(CASE WHEN m = 0 THEN 1.0 ELSE m END, p) AS confidence, gap FROM o)
SELECT op_key, confidence, CASE WHEN NOT gap AND confidence < 0.8 THEN 0.8 ELSE confidence END AS raised FROM k"""
)
def operation_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Least of operation and parameters; raised to the cap of a typed proof where no gap is left."""
    c = slot_candidates(spark, d)
    o = c.groupBy("op_key").agg(F.min(F.when(F.col("slot_kind") == "param", F.col("confidence"))).alias("p"), F.max("confidence").alias("m"), F.bool_or(F.col("status") == "unresolved").alias("gap"))
    gaps = F.when(F.col("gap"), F.array(F.lit("open"))).otherwise(F.array().cast("array<string>"))
    k = o.select("op_key", C.operation_confidence(F.col("m"), F.col("p")).alias("confidence"), gaps.alias("gaps"))
    return k.select("op_key", "confidence", C.recompute_confidence(F.col("confidence"), F.col("gaps"), C.verification_cap(F.lit("typed"))).alias("raised"))


@DOMAIN.add(f"WITH {_CANDIDATES}, e AS (SELECT DISTINCT op_key, unnest(evidence) AS e FROM c) SELECT op_key, count(*) AS evidence FROM e GROUP BY 1")
def operation_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Number of different pieces of evidence of each operation."""
    return C.operation_evidence(slot_candidates(spark, d)).select("op_key", F.size("evidence").cast("long").alias("evidence"))


@DOMAIN.add("SELECT count(*) AS answers, count(*) FILTER (WHERE exhausted) AS exhausted, sum(usage_in)::BIGINT AS usage_in, sum(usage_out)::BIGINT AS usage_out, sum(coalesce(len(reads), 0))::BIGINT AS reads FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries)")
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    """Usage of all answers."""
    return C.usage_counters(table(spark, d, "cache_entries", "entry_id", "exhausted", "usage_in", "usage_out", "reads").dropDuplicates(["entry_id"]))


# ---- windows and orders --------------------------------------------------------------------------


@DOMAIN.add(
    f"""WITH {_LINES}, y AS (SELECT DISTINCT symbol_id AS func_id, file_id AS file, line AS a, end_line AS b FROM symbols WHERE kind IN ('func', 'method') AND end_line IS NOT NULL),
h AS (SELECT func_id, line_no AS line, a, b, row_number() OVER (PARTITION BY func_id ORDER BY line_no) AS n FROM y JOIN l USING (file) WHERE line_no BETWEEN a AND b AND contains(text, 'err'))
SELECT func_id, line, greatest(line - 20, a) AS first, least(line + 20, b) AS last FROM h WHERE n <= 8"""
)
def site_windows(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight windows of twenty lines around the lines of a function that hold an error."""
    y = table(spark, d, "symbols", "symbol_id", "kind", "file_id", "line", "end_line").where("kind IN ('func', 'method') AND end_line IS NOT NULL").distinct()
    functions = y.groupBy(F.col("symbol_id").alias("func_id"), F.col("file_id").alias("file")).agg(F.min("line").alias("start_line"), F.min("end_line").alias("end_line"))
    lines = newest_lines(spark, d).where(F.contains("text", F.lit("err"))).select("file", F.col("line_no").alias("line"))
    sites = J.point_in_range(lines, functions, ["file"], "line", "start_line", "end_line", "func_id")
    return O.clipped_windows(sites.select("func_id", "line"), functions.select("func_id", "start_line", "end_line"))


@DOMAIN.add(f"WITH {_CANDIDATES} SELECT op_key, arg_min(slot_kind, seq) AS slot_kind, arg_min(slot_key, seq) AS slot_key, min(seq) AS seq FROM c GROUP BY 1")
def first_claims(spark: SparkSession, d: str) -> DataFrame:
    """The first claim of each operation."""
    return J.first_per_key(slot_candidates(spark, d).select("op_key", "seq", "slot_kind", "slot_key"), ["op_key"], ["seq"]).select("op_key", "slot_kind", "slot_key", "seq")


@DOMAIN.add(rf"WITH {_LINES}, w AS (SELECT file, line_no, regexp_extract(lag(text) OVER (PARTITION BY file ORDER BY line_no), '(\w+) :=', 1) AS constant FROM l) SELECT file, line_no, constant FROM w WHERE constant <> ''")
def constants_before(spark: SparkSession, d: str) -> DataFrame:
    """The name that the line right before sets."""
    return O.constant_before(newest_lines(spark, d), r"(\w+) :=").where("constant IS NOT NULL").select("file", "line_no", "constant")


@DOMAIN.add(f"WITH {_CANDIDATES}, s AS (SELECT DISTINCT op_key, slot_kind, slot_key FROM c WHERE slot_key IS NOT NULL) SELECT *, 's' || (row_number() OVER (PARTITION BY op_key ORDER BY slot_kind, slot_key) - 1) AS gap_id FROM s")
def numbered_slots(spark: SparkSession, d: str) -> DataFrame:
    """The slots of an operation numbered s0, s1, ..."""
    return O.numbered_gaps(slot_candidates(spark, d).where("slot_key IS NOT NULL").select("op_key", "slot_kind", "slot_key").distinct(), ["op_key"], ["slot_kind", "slot_key"])


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, p AS (SELECT op_key, slot_key, arg_min(coalesce(param.param_in, ''), seq) AS loc FROM c WHERE slot_kind = 'param' GROUP BY ALL)
SELECT op_key, slot_key, row_number() OVER (PARTITION BY op_key ORDER BY CASE loc WHEN 'path' THEN 0 WHEN 'query' THEN 1 WHEN 'header' THEN 2 WHEN 'cookie' THEN 3 ELSE 4 END, slot_key) AS place FROM p"""
)
def parameter_order(spark: SparkSession, d: str) -> DataFrame:
    """parameters by location, then name."""
    from pyspark.sql import Window as W

    p = slot_candidates(spark, d).where("slot_kind = 'param'").groupBy("op_key", "slot_key").agg(F.min_by(F.coalesce("param.param_in", F.lit("")), "seq").alias("loc"))
    return p.select("op_key", "slot_key", F.row_number().over(W.partitionBy("op_key").orderBy(T.location_order(F.col("loc")), "slot_key")).alias("place"))


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT op_key, seq, response.envelope IS NOT NULL AS e, coalesce(response.code, -2) AS code, coalesce(response.failure, false) AS f, coalesce(response.sink, '') AS sink FROM c WHERE slot_kind = 'response')
SELECT op_key, seq, row_number() OVER (PARTITION BY op_key ORDER BY NOT e, CASE WHEN code = 0 THEN 0 WHEN code > 0 THEN 1 WHEN code = -3 THEN 2 WHEN code = -2 THEN 3 ELSE 4 END, code, f, sink, seq) AS place FROM r"""
)
def response_order(spark: SparkSession, d: str) -> DataFrame:
    """response rows: enveloped first, success, business, uncoded codes, success before failure, the sink."""
    from pyspark.sql import Window as W

    r = slot_candidates(spark, d).where("slot_kind = 'response'").select("op_key", "seq", F.col("response.envelope").isNotNull().alias("e"), F.coalesce("response.code", F.lit(-2)).alias("code"), F.coalesce("response.failure", F.lit(False)).alias("f"), F.coalesce("response.sink", F.lit("")).alias("sink"))
    order = O.response_order(F.col("e"), F.col("code"), F.col("f"), F.col("sink"))
    return r.select("op_key", "seq", F.row_number().over(W.partitionBy("op_key").orderBy(order, "seq")).alias("place"))


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, g AS (SELECT op_key, bool_or(slot_kind = 'response') AS r, bool_or(slot_kind IN ('body', 'param')) AS b FROM c WHERE status = 'unresolved' GROUP BY 1)
SELECT op_key, CASE WHEN r THEN 0 WHEN b THEN 1 ELSE 2 END AS priority FROM g"""
)
def gap_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Work priority of operations by the kind of their unresolved slots."""
    g = slot_candidates(spark, d).where("status = 'unresolved'").groupBy("op_key").agg(F.collect_set(T.gap_text(F.col("slot_kind"), F.coalesce("slot_key", F.lit("")))).alias("gaps"))
    return g.select("op_key", O.gap_priority(F.col("gaps")).alias("priority"))


@DOMAIN.add("SELECT pkg, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY p, line, symbol_id) AS n FROM (SELECT DISTINCT pkg, symbol_id, line, CASE kind WHEN 'func' THEN 0 WHEN 'method' THEN 1 ELSE 2 END AS p FROM symbols)) WHERE n <= 9")
def top_slices(spark: SparkSession, d: str) -> DataFrame:
    """the first nine symbols of each package by (priority, line, id)."""
    y = table(spark, d, "symbols", "pkg", "symbol_id", "line", "kind").select("pkg", "symbol_id", "line", F.when(F.col("kind") == "func", 0).when(F.col("kind") == "method", 1).otherwise(2).alias("prio")).distinct()
    return O.top_slices(y, ["pkg"], ["prio", "line", "symbol_id"]).select("pkg", "symbol_id")


# ---- sets ----------------------------------------------------------------------------------------


@DOMAIN.add("SELECT DISTINCT file_path FROM operation_dependencies WHERE file_path IS NOT NULL EXCEPT SELECT file_path FROM symbols")
def files_without_symbols(spark: SparkSession, d: str) -> DataFrame:
    """G1: files of the log that the index lacks."""
    return M.set_difference(table(spark, d, "operation_dependencies", "file_path").where("file_path IS NOT NULL"), table(spark, d, "symbols", "file_path"), ["file_path"])


@DOMAIN.add("SELECT count(*) AS n FROM symbols WHERE file_path IN (SELECT file_path FROM source_files)")
def shared_files(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, repeated rows counted, whose file is there."""
    return M.intersection_count(table(spark, d, "symbols", "file_path"), table(spark, d, "source_files", "file_path"), "file_path")


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, w AS (SELECT op_key, slot_kind, slot_key, status, 0 AS source, seq FROM c WHERE status = 'verified' UNION ALL SELECT op_key, slot_kind, slot_key, status, 1, seq FROM c WHERE status = 'declared')
SELECT op_key, slot_kind, slot_key, arg_min(status, (source, seq)) AS status, count(*) AS claims FROM w GROUP BY op_key, slot_kind, slot_key"""
)
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Claims of two sources, those of the first before those of the second."""
    c = slot_candidates(spark, d).select("op_key", "slot_kind", "slot_key", "status", "seq")
    merged = C.merge_graphs(c.where("status = 'verified'"), c.where("status = 'declared'"))
    return merged.groupBy("op_key", "slot_kind", "slot_key").agg(F.min_by("status", "seq").alias("status"), F.count("*").alias("claims"))


# ---- trees and expansions ------------------------------------------------------------------------

_OPEN_TREES = """t AS (SELECT DISTINCT type_id AS schema_id, json_name, type_str FROM type_fields WHERE json_name IS NOT NULL AND json_name NOT LIKE '%/%'),
n AS (SELECT schema_id, '/properties/' || json_name AS path, bool_or(type_str LIKE 'map%') AS open, bool_or(type_str LIKE '%any%') AS unknown FROM t GROUP BY ALL)"""


def field_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The structs as trees of two levels, map values below their field."""
    f = table(spark, d, "type_fields", "type_id", "json_name", "type_str").where("json_name IS NOT NULL AND json_name NOT LIKE '%/%'").distinct()
    first = f.groupBy(F.col("type_id").alias("schema_id"), F.concat(F.lit("/properties/"), "json_name").alias("path")).agg(F.bool_or(F.startswith("type_str", F.lit("map"))).alias("open"), F.bool_or(F.contains("type_str", F.lit("any"))).alias("unknown"))
    return first.unionByName(first.where("open").select("schema_id", F.concat("path", F.lit("/items")).alias("path"), F.lit(False).alias("open"), F.lit(True).alias("unknown")))


@DOMAIN.add(f"WITH {_OPEN_TREES} SELECT schema_id, path FROM n WHERE unknown")
def unknown_field_paths(spark: SparkSession, d: str) -> DataFrame:
    """H8: fields of unknown type; nothing below an open object is listed."""
    return S.unknown_paths(field_nodes(spark, d))


@DOMAIN.add(
    f"""WITH {_OPEN_TREES}, a AS (SELECT schema_id, path, open FROM n UNION ALL SELECT schema_id, path || '/items', false FROM n WHERE open)
SELECT schema_id, sha256(string_agg(h, chr(10) ORDER BY h)) AS shape FROM (SELECT schema_id, sha256(path || '|||' || open) AS h FROM a) GROUP BY 1"""
)
def shape_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The same hash for structs of the same fields."""
    empty = F.lit(None).cast("string")
    return S.canonical_shapes(field_nodes(spark, d).withColumn("type", empty).withColumn("required", empty))


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT DISTINCT seq, unnest(CASE WHEN len(param.enum) > 0 THEN param.enum ELSE [NULL] END) AS value FROM c WHERE slot_kind = 'param') SELECT seq, value FROM r"""
)
def enum_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """One row per enum value; parameters without an enum stay once."""
    p = slot_candidates(spark, d).where("slot_kind = 'param'").select("seq", F.col("param.enum").alias("value"))
    return G.alternatives(p, "value").distinct()


@DOMAIN.add(
    r"""WITH p AS (SELECT DISTINCT regexp_replace(file_path, '\\', '/', 'g') AS p FROM operation_dependencies WHERE file_path IS NOT NULL), w AS (SELECT DISTINCT '/' || regexp_replace(p, '[^/]*$', '*') AS raw_path FROM p)
SELECT raw_path, replace(raw_path, '*', '{wildcard}') AS path FROM w"""
)
def wildcard_routes(spark: SparkSession, d: str) -> DataFrame:
    """Wildcard paths without a rule or version become templates; the folders of the log."""
    p = table(spark, d, "operation_dependencies", "file_path").where("file_path IS NOT NULL").select(F.translate("file_path", "\\", "/").alias("p")).distinct()
    routes = p.select(F.concat(F.lit("/"), F.regexp_extract("p", r"^(.*/)?", 0), F.lit("*")).alias("path")).distinct()
    return G.expand_wildcards(routes, spark.createDataFrame([], "pattern string, expansions array<string>"))


@DOMAIN.add(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS d, 'o' || o_orderkey AS u FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem WHERE l_quantity > 48),
s AS (SELECT 'c' || c_custkey AS node, CASE WHEN c_acctbal < 0 THEN 'opaque' ELSE c_mktsegment END AS label FROM customer),
r AS (SELECT node, label, 0 AS depth FROM s UNION SELECT u, label, depth + 1 FROM r JOIN e ON d = node WHERE depth < 8) SELECT label, count(DISTINCT node) AS nodes FROM r GROUP BY 1"""
)
def label_flow(spark: SparkSession, d: str) -> DataFrame:
    """Labels flow along def-use edges; from customers over orders (those of even keys) to parts."""
    o, l = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = o.where("o_orderkey % 2 = 0").select(name("c", "o_custkey").alias("def"), name("o", "o_orderkey").alias("use")).unionByName(l.where("l_quantity > 48").select(name("o", "l_orderkey").alias("def"), name("p", "l_partkey").alias("use")))
    labels = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment").select(name("c", "c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, "opaque").otherwise(F.col("c_mktsegment")).alias("label"))
    return G.propagate_labels(edges, labels).groupBy("label").agg(F.count_distinct("node").alias("nodes"))


# ---- scalar functions ----------------------------------------------------------------------------


@DOMAIN.add(
    r"""WITH k AS (SELECT DISTINCT regexp_replace(operation_key, '^\s+|\s+$', '', 'g') AS k FROM operation_dependencies), p AS (SELECT k, regexp_extract(k, '^\S*\s*(.*)$', 1) AS p FROM k),
g AS (SELECT k, p, regexp_replace(regexp_replace(regexp_replace(p, '<(?:[A-Za-z_]\w*:)?([A-Za-z_]\w*)>', '{\1}', 'g'), '\{([A-Za-z_]\w*)(?::[^{}]*)?\}', '{\1}', 'g'), ':([A-Za-z_]\w*)', '{\1}', 'g') AS t FROM p)
SELECT k AS op_key, regexp_replace(regexp_replace(p, ':([^/]*)', '{\1}', 'g'), '(^|/)\*([A-Za-z0-9_][^/]*)', '\1{\2}', 'g') AS framework, t AS generic, array_to_string(list_distinct(regexp_extract_all(t, '\{([^{}/]+)\}', 1)), ',') = '' AS plain,
 regexp_extract(k, '^([A-Z]+)\s+\S', 1) AS method FROM g"""
)
def path_templates(spark: SparkSession, d: str) -> DataFrame:
    """Path templates of frameworks, generic ones, and the method of a pattern."""
    k = table(spark, d, "operation_dependencies", "operation_key").select(K.trim_space(F.col("operation_key")).alias("op_key")).distinct()
    _, path = K.split_operation_key(F.col("op_key"))
    generic = T.generic_template(path)
    return k.select("op_key", K.template_path(path).alias("framework"), generic.alias("generic"), (F.size(T.template_names(generic)) == 0).alias("plain"), T.method_of_pattern(F.col("op_key")).alias("method"))


@DOMAIN.add(
    r"""SELECT DISTINCT symbol_id, regexp_replace(symbol_id, '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_extract(regexp_extract(symbol_id, '([^/]*)$', 1), '([^.]*)$', 1) AS last, regexp_matches(regexp_extract(symbol_id, '([^./]+)$', 1), '^[A-Za-z_][A-Za-z0-9_]*$') AS identifier,
 CASE WHEN starts_with(file_path, 'internal/') THEN substr(file_path, 10) ELSE file_path END AS relative FROM symbols"""
)
def symbol_names(spark: SparkSession, d: str) -> DataFrame:
    """Safe component names, last segments, identifiers, relative paths (ids are ASCII here)."""
    y = table(spark, d, "symbols", "symbol_id", "file_path").distinct()
    return y.select("symbol_id", T.component_safe(F.col("symbol_id")).alias("safe"), K.last_segment(F.col("symbol_id")).alias("last"), T.is_identifier(F.regexp_extract("symbol_id", r"([^./]+)$", 1)).alias("identifier"), T.relative_path(F.col("file_path"), F.lit("internal")).alias("relative"))


@DOMAIN.add(
    r"""WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS cut, trim(split_part(text, chr(10), 1)) AS first_line,
 CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) ELSE printf('%.1f MiB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT *, octet_length(encode(text)) AS n FROM t)"""
)
def text_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at 80 characters, their first line and size."""
    t = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").distinct()
    return t.select("doc_id", T.truncate_characters(F.col("text"), 80).alias("cut"), T.first_line(F.col("text")).alias("first_line"), T.human_bytes(F.octet_length("text")).alias("size"))


@DOMAIN.add(
    r"""WITH f AS (SELECT DISTINCT field_id, coalesce(tag, '') AS tag FROM type_fields), g AS (SELECT field_id, regexp_extract(tag, '(?:^|\s)json:"([^"]*)"', 1) AS j, concat_ws(',', nullif(regexp_extract(tag, '(?:^|\s)binding:"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?:^|\s)validate:"([^"]*)"', 1), '')) AS rules FROM f)
SELECT field_id, CASE WHEN rules <> '' THEN list_contains(string_split(rules, ','), 'required') ELSE NOT list_contains(string_split(j, ','), 'omitempty') END AS required FROM g"""
)
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Requiredness of fields by their tags."""
    f = table(spark, d, "type_fields", "field_id", "tag").select("field_id", F.coalesce("tag", F.lit("")).alias("tag")).distinct()
    return f.select("field_id", T.required_by_tag(F.col("tag")).alias("required"))


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT DISTINCT slot_key FROM c WHERE slot_kind = 'response' AND slot_key IS NOT NULL), n AS (SELECT slot_key, CASE WHEN regexp_matches(slot_key, '^[0-9]{{1,9}}$') THEN slot_key::INT ELSE 0 END AS number FROM r)
SELECT slot_key, number, CASE number WHEN 200 THEN 'OK' WHEN 400 THEN 'Bad Request' WHEN 404 THEN 'Not Found' WHEN 409 THEN 'Conflict' WHEN 401 THEN 'Unauthorized' WHEN 403 THEN 'Forbidden' WHEN 500 THEN 'Internal Server Error' WHEN 201 THEN 'Created' WHEN 204 THEN 'No Content' ELSE 'Response' END AS phrase FROM n"""
)
def status_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Status numbers and reason phrases."""
    r = slot_candidates(spark, d).where("slot_kind = 'response' AND slot_key IS NOT NULL").select("slot_key").distinct()
    return r.select("slot_key", T.status_number(F.col("slot_key")).alias("number"), T.status_text(T.status_number(F.col("slot_key"))).alias("phrase"))


@DOMAIN.add(
    rf"""WITH {_LINES}, b AS (SELECT file, line_no, text, regexp_replace(regexp_replace(text, '"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|`[^`]*`', '""', 'g'), '//.*$|#.*$', '') AS bare FROM l)
SELECT file, line_no, length(regexp_replace(bare, '[^{{]', '', 'g')) - length(regexp_replace(bare, '[^}}]', '', 'g')) AS balance, length(regexp_extract(text, '^([ \t]*)', 1)) AS indent FROM b"""
)
def brace_balances(spark: SparkSession, d: str) -> DataFrame:
    """Opening less closing braces of each line outside literals, and its indentation."""
    return newest_lines(spark, d).select("file", "line_no", T.brace_balance(F.col("text")).alias("balance"), T.indentation(F.col("text")).alias("indent"))


# ---- validation and metrics ----------------------------------------------------------------------


@DOMAIN.add(
    rf"""WITH {_DIAGNOSED}, n AS (SELECT (SELECT count(*) FROM s WHERE slot_kind IN ('body', 'response') AND conflict) + (SELECT count(*) FROM s WHERE slot_kind = 'param' AND n > 1 AND conflict) + (SELECT count(*) FROM o WHERE state = 'conflict') AS conflict,
 (SELECT count(*) FROM r WHERE id NOT IN (SELECT id FROM known)) + (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.op_key = t.op_key AND x.slot_key = t.name AND slot_kind = 'param' AND lower(loc) = 'path')) + (SELECT count(*) FROM o WHERE state = 'unresolved') + (SELECT count(*) FROM known WHERE unknown) AS unresolved)
SELECT 'conflict' AS gate, conflict AS failures FROM n WHERE conflict > 0 UNION ALL SELECT 'unresolved', unresolved FROM n WHERE unresolved > 0"""
)
def gate_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of the gates for conflicts and unresolved parts."""
    operations, rows, schemas = diagnosed_graph(spark, d)
    return V.gates(V.diagnostics(operations, rows, schemas), operations.withColumn("confidence", F.lit(1.0)), True, True, 0.5)


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT op_key, CASE WHEN count(DISTINCT v) > 1 THEN 1 ELSE 0 END AS bad FROM c GROUP BY op_key, slot_kind, slot_key) SELECT op_key, CASE WHEN max(bad) = 1 THEN 'conflict' ELSE 'matched' END AS state FROM r GROUP BY 1"""
)
def marked_states(spark: SparkSession, d: str) -> DataFrame:
    """Operations with a conflicting slot are in conflict."""
    c = slot_candidates(spark, d)
    return V.mark_states(c.select("op_key").distinct().withColumn("state", F.lit("matched")), C.resolve(c))


_SIDES = """truth AS (SELECT * FROM c WHERE status = 'declared'), spec AS (SELECT * FROM c WHERE status IN ('verified', 'observed', 'inferred')),
both_ops AS (SELECT DISTINCT op_key FROM spec WHERE op_key IN (SELECT op_key FROM truth))"""
_QUAD = "concat_ws('|', coalesce(param.param_in, ''), coalesce(param.name, ''), coalesce(param.required, false)::VARCHAR, coalesce(param.type, '?'))"
_FIELDS = """d2 AS (SELECT schema_id, min((received_at, raw_id)) AS lo, max((received_at, raw_id)) AS hi FROM doc WHERE schema_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
old AS (SELECT schema_id, entry FROM flat_fields JOIN doc USING (raw_id) JOIN d2 USING (schema_id) WHERE (received_at, raw_id) = lo), new AS (SELECT schema_id, entry FROM flat_fields JOIN doc USING (raw_id) JOIN d2 USING (schema_id) WHERE (received_at, raw_id) = hi)"""


def claimed_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts of two sides: claims from code and traffic, and declared ones as the truth. Parameters give quads,
    responses envelope codes."""
    c = slot_candidates(spark, d)
    p, r = F.col("param"), F.col("response")
    quads = c.where("slot_kind = 'param'").select("status", "op_key", F.lit("param").alias("kind"), M.parameter_quad(p["param_in"], p["name"], p["required"], p["type"]).alias("value"))
    enum = F.when(r["code_known"], F.array(r["code"].cast("string")))
    codes = c.where("slot_kind = 'response' AND response.status IS NOT NULL").select("status", "op_key", F.lit("envelope").alias("kind"), F.explode(M.envelope_codes(r["status"], enum, r["description"])).alias("value"))
    routes = c.select("status", "op_key", F.lit("route").alias("kind"), F.lit("").alias("value")).distinct()
    facts = cut_lineage(quads.unionByName(codes).unionByName(routes))  # both sides are read several times
    return facts.where("status IN ('verified', 'observed', 'inferred')").drop("status"), facts.where("status = 'declared'").drop("status")


def version_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Response fields of two sides: the first and the last readable version of each schema that has several,
    without what stands below an open object of the last (B3)."""
    trees = schema_trees(spark, d).where("schema_id IS NOT NULL")
    when = F.struct("received_at", "raw_id")
    ends = trees.groupBy("schema_id").agg(F.min(when)["raw_id"].alias("lo"), F.max(when)["raw_id"].alias("hi"), F.count("*").alias("n")).where("n > 1")
    ends = cut_lineage(ends)
    entries = cut_lineage(S.flatten(trees.join(ends, "schema_id").where("raw_id = lo OR raw_id = hi"), "raw_id"))

    def side(which: str, kind: str) -> DataFrame:
        return entries.where(F.col("kind") == kind).join(ends.select(F.col("schema_id").alias("op_key"), F.col(which).alias("raw_id")), "raw_id").select("op_key", F.lit("response").alias("kind"), F.col("entry").alias("value"), F.regexp_extract("entry", r"^([^|]*)", 1).alias("path"))

    truth = side("hi", "field")
    spec = M.tolerate_open_objects(side("lo", "field"), truth, side("hi", "open").select("op_key", F.col("value").alias("prefix")), ["op_key"], "path", "value")
    routes = ends.select(F.col("schema_id").alias("op_key"), F.lit("route").alias("kind"), F.lit("").alias("value"))
    return spec.select("op_key", "kind", "value").unionByName(routes), truth.select("op_key", "kind", "value").unionByName(routes)


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, {_SIDES}, s AS (SELECT DISTINCT op_key, {_QUAD} AS q FROM spec WHERE slot_kind = 'param' AND op_key IN (SELECT op_key FROM both_ops)), t AS (SELECT DISTINCT op_key, {_QUAD} AS q FROM truth WHERE slot_kind = 'param' AND op_key IN (SELECT op_key FROM both_ops)),
n AS (SELECT (SELECT count(*) FROM s JOIN t USING (op_key, q)) AS tp, (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM t) AS nt)
SELECT CASE WHEN ns = 0 THEN 1.0 ELSE tp / ns END AS precision, CASE WHEN nt = 0 THEN 1.0 ELSE tp / nt END AS recall, CASE WHEN ns + nt = 0 THEN 1.0 WHEN tp = 0 AND ns > 0 AND nt > 0 THEN 0.0 ELSE 2 * (CASE WHEN ns = 0 THEN 1.0 ELSE tp / ns END) * (CASE WHEN nt = 0 THEN 1.0 ELSE tp / nt END) / ((CASE WHEN ns = 0 THEN 1.0 ELSE tp / ns END) + (CASE WHEN nt = 0 THEN 1.0 ELSE tp / nt END)) END AS f1 FROM n"""
)
def parameter_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of parameter quads over operations of both sides."""
    return M.evaluate(*claimed_facts(spark, d)).select(F.col("param_precision").alias("precision"), F.col("param_recall").alias("recall"), F.col("param_f1").alias("f1"))


@DOMAIN.add(
    f"""WITH RECURSIVE {FLAT_TREES}, {_FIELDS}, z AS (SELECT (SELECT count(*) FROM old JOIN new USING (schema_id, entry)) AS tp, (SELECT count(*) FROM old) AS ns, (SELECT count(*) FROM new) AS nt),
so AS (SELECT DISTINCT schema_id, regexp_replace(entry, '\\|[^|]*$', '') AS e FROM old), sn AS (SELECT DISTINCT schema_id, regexp_replace(entry, '\\|[^|]*$', '') AS e FROM new), m AS (SELECT (SELECT count(*) FROM so JOIN sn USING (schema_id, e)) AS tp, (SELECT count(*) FROM so) AS ns, (SELECT count(*) FROM sn) AS nt)
SELECT z.tp / z.ns AS precision, z.tp / z.nt AS recall, 2 * z.tp / (z.ns + z.nt) AS f1, 2 * m.tp / (m.ns + m.nt) AS shape_f1, (z.ns - z.tp) / z.nt AS hallucination FROM z, m"""
)
def field_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Response fields of the first version of each schema against those of the last."""
    m = M.evaluate(*version_facts(spark, d))
    return m.select(F.col("response_precision").alias("precision"), F.col("response_recall").alias("recall"), F.col("response_f1").alias("f1"), "shape_f1", "hallucination")


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, {_SIDES}, p AS (SELECT op_key, status, response.status AS st, response.code AS code, coalesce(response.code_known, false) AND response.code IS NOT NULL AS known, coalesce(response.description, '') AS d FROM c WHERE slot_kind = 'response' AND response.status IS NOT NULL AND op_key IN (SELECT op_key FROM both_ops)),
e AS (SELECT op_key, status, st || ':' || unnest(CASE WHEN known THEN [code::VARCHAR] ELSE list_concat(list_filter(regexp_extract_all(d, 'code=([^ :);,]*)', 1), lambda x: x <> ''), CASE WHEN st = '200' AND NOT contains(d, 'code') THEN ['0'] ELSE [] END) END) AS pair FROM p),
s AS (SELECT op_key, pair FROM e WHERE status IN ('verified', 'observed', 'inferred')), t AS (SELECT op_key, pair FROM e WHERE status = 'declared'),
n AS (SELECT (SELECT count(*) FROM s WHERE EXISTS (SELECT 1 FROM t WHERE t.op_key = s.op_key AND t.pair = s.pair)) AS tp, (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE t.op_key = s.op_key AND t.pair = s.pair)) AS fn),
o AS (SELECT (SELECT count(DISTINCT op_key) FROM spec) AS ns, (SELECT count(DISTINCT op_key) FROM truth) AS nt, (SELECT count(*) FROM both_ops) AS hits)
SELECT hits / nt AS route_recall, hits / ns AS route_precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS envelope_recall FROM n, o"""
)
def envelope_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Routes, and recall of ``status:code`` pairs."""
    return M.evaluate(*claimed_facts(spark, d)).select("route_recall", "route_precision", "envelope_recall")


@DOMAIN.add(
    f"""WITH RECURSIVE {FLAT_TREES}, {_FIELDS} SELECT 'missing response' AS section, schema_id || ': ' || entry AS entry FROM (SELECT schema_id, entry FROM new EXCEPT SELECT schema_id, entry FROM old)
UNION ALL SELECT 'spurious response', schema_id || ': ' || entry FROM (SELECT schema_id, entry FROM old EXCEPT SELECT schema_id, entry FROM new)"""
)
def field_differences(spark: SparkSession, d: str) -> DataFrame:
    """Missing and spurious fields of schemas between their first and last version."""
    return M.differences(*version_facts(spark, d))


# ---- documents -----------------------------------------------------------------------------------

_OPERATIONS = f"""WITH {_CANDIDATES}, o AS (SELECT DISTINCT regexp_extract(op_key, '^(\\S+)', 1) AS repo, substr(op_key, strpos(op_key, ' ') + 1) AS op_key FROM c),
m AS (SELECT repo, op_key, split_part(op_key, ' ', 1) AS method, substr(op_key, strpos(op_key, ' ') + 1) AS path FROM o WHERE split_part(op_key, ' ', 1) IN ('GET', 'PUT', 'POST', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS', 'TRACE'))"""


def claimed_documents(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, text``: a document per repo and operation, as JSON, alternately in both layouts: OpenAPI 3 with a
    body reference, and Swagger 2 with a base path and a body parameter; with the claimed parameters."""
    c = slot_candidates(spark, d).select(F.regexp_extract("op_key", r"^(\S+)", 1).alias("repo"), F.regexp_extract("op_key", r"^\S+ (.*)$", 1).alias("op"), "slot_kind", "slot_key", "seq", "param")
    parameter = F.when(F.col("slot_kind") == "param", F.struct(F.col("slot_key").alias("name"), F.coalesce("param.param_in", F.lit("query")).alias("in"), F.coalesce("param.required", F.lit(False)).alias("required"), F.struct(F.col("param.type").alias("type")).alias("schema")))
    status = F.when(F.col("slot_kind") == "response", F.col("slot_key"))
    g = c.groupBy("repo", "op").agg(F.array_sort(F.collect_set(parameter)).alias("parameters"), F.array_sort(F.collect_set(status)).alias("statuses"))
    method, path = K.split_operation_key(F.col("op"))
    responses = F.map_from_arrays("statuses", F.transform("statuses", lambda s: F.struct(F.concat(F.lit("answer "), s).alias("description"))))
    three = F.struct(F.lit("getIt").alias("operationId"), F.col("parameters"), responses.alias("responses"))
    old = F.length("op") % 2 == 0
    doc3 = F.to_json(F.struct(F.create_map(path, F.create_map(F.lower(method), three)).alias("paths")))
    doc2 = F.to_json(F.struct(F.lit("2.0").alias("swagger"), F.lit("/").alias("basePath"), F.create_map(path, F.create_map(F.lower(method), three)).alias("paths")))
    return g.select(F.concat_ws(" ", "repo", "op").alias("doc_id"), F.when(old, doc2).otherwise(doc3).alias("text"))


@DOMAIN.add(_OPERATIONS + " SELECT repo || ' ' || op_key AS doc_id, op_key, method, path FROM m")
def document_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operations of documents of both layouts, written from the claims and read again."""
    return D.openapi_operations(claimed_documents(spark, d)).select("doc_id", "op_key", "method", "path")


@DOMAIN.add(_OPERATIONS + " SELECT DISTINCT c.op_key AS doc_id, slot_key AS name, coalesce(param.param_in, 'query') AS location, coalesce(param.required, false) AS required, param.type AS type FROM c JOIN m ON c.op_key = m.repo || ' ' || m.op_key WHERE slot_kind = 'param' AND slot_key IS NOT NULL AND coalesce(param.param_in, 'query') <> 'body'")
def document_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A3, A5: parameters of those documents."""
    return D.openapi_parameters(D.openapi_operations(claimed_documents(spark, d))).select("doc_id", "name", "location", "required", "type").distinct()


@DOMAIN.add(_OPERATIONS + " SELECT DISTINCT c.op_key AS doc_id, slot_key AS status, 'answer ' || slot_key AS description FROM c JOIN m ON c.op_key = m.repo || ' ' || m.op_key WHERE slot_kind = 'response' AND slot_key IS NOT NULL")
def document_responses(spark: SparkSession, d: str) -> DataFrame:
    """A3, A10: responses of those documents."""
    return D.openapi_responses(D.openapi_operations(claimed_documents(spark, d))).select("doc_id", "status", "description")


@DOMAIN.add(
    """WITH b AS (SELECT symbol_id AS path, min(doc) AS v FROM symbols WHERE kind = 'type' GROUP BY 1), o AS (SELECT type_id AS path, max(doc) AS v FROM type_fields GROUP BY 1)
SELECT coalesce(b.path, o.path) AS path, CASE WHEN o.path IS NOT NULL THEN o.v ELSE b.v END AS value FROM b FULL JOIN o ON b.path = o.path"""
)
def overlay(spark: SparkSession, d: str) -> DataFrame:
    """Values of one document over those of another; docs of types under those of their fields."""
    base = table(spark, d, "symbols", "symbol_id", "kind", "doc").where("kind = 'type'").groupBy(F.col("symbol_id").alias("path")).agg(F.min("doc").alias("value"))
    return D.apply_overlay(base, table(spark, d, "type_fields", "type_id", "doc").groupBy(F.col("type_id").alias("path")).agg(F.max("doc").alias("value")))


@DOMAIN.add("SELECT entry_id AS doc_id, unnest(list_transform(reads, lambda r: r.tool)) AS step_id, unnest(list_transform(reads, lambda r: r.digest)) AS operation_id, generate_subscripts(reads, 1) - 1 AS pos FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries)")
def workflow_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of workflow documents; the reads of each answer are written as one and read again."""
    e = table(spark, d, "cache_entries", "entry_id", "reads").dropDuplicates(["entry_id"]).where("reads IS NOT NULL")
    steps = F.transform("reads", lambda r: F.struct(r["tool"].alias("stepId"), r["digest"].alias("operationId")))
    text = F.to_json(F.struct(F.array(F.struct(F.lit("w").alias("workflowId"), steps.alias("steps"))).alias("workflows")))
    return D.workflow_steps(e.select(F.col("entry_id").alias("doc_id"), text.alias("text"))).select("doc_id", "step_id", "operation_id", "pos")


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT op_key, slot_kind, slot_key, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' ELSE coalesce(arg_max(status, (rank, -seq)), 'unresolved') END AS state FROM c GROUP BY op_key, slot_kind, slot_key),
p AS (SELECT *, split_part(op_key, ' ', 2) AS method, regexp_extract(op_key, '^\\S+ \\S+ (.*)$', 1) AS path FROM r)
SELECT op_key, slot_kind, slot_key, state, CASE WHEN slot_kind = 'response' THEN CASE slot_key WHEN '200' THEN 'OK' WHEN '400' THEN 'Bad Request' WHEN '404' THEN 'Not Found' WHEN '409' THEN 'Conflict' ELSE 'Response' END END AS status_text,
 dense_rank() OVER (ORDER BY string_split(regexp_replace(path, '^/', ''), '/'), CASE method WHEN 'GET' THEN 0 WHEN 'PUT' THEN 1 WHEN 'POST' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4 WHEN 'HEAD' THEN 5 WHEN 'OPTIONS' THEN 6 WHEN 'TRACE' THEN 7 ELSE 8 END, op_key) AS place FROM p"""
)
def document_slots(spark: SparkSession, d: str) -> DataFrame:
    """Resolved slots in the order of the document, numbered by operation."""
    c = slot_candidates(spark, d)
    method, path = F.split("op_key", " ")[1], F.regexp_extract("op_key", r"^\S+ \S+ (.*)$", 1)
    none = F.lit(None).cast("string")
    ops = c.select("op_key").distinct().select("op_key", method.alias("method"), path.alias("path"), none.alias("operation_id"), none.alias("summary"))
    order = ops.select("op_key", T.path_order(F.col("path")).alias("p"), T.method_order(F.col("method")).alias("m"))
    places = O.numbered(order, [], ["p", "m", "op_key"], "place").select("op_key", "place")
    return P.document_rows(ops, c).join(places, "op_key").select("op_key", "slot_kind", "slot_key", "state", "status_text", "place")


@DOMAIN.add(f"WITH {_CANDIDATES}, o AS (SELECT DISTINCT op_key, slot_kind FROM c) SELECT '{{\"version\":\"1\",\"op_key\":\"' || op_key || '\",\"slot_kind\":\"' || slot_kind || '\"}}' AS value FROM o")
def operation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Operations as JSON lines with the version of the format."""
    return P.operations_json(slot_candidates(spark, d).select("op_key", "slot_kind").distinct())


@DOMAIN.add("SELECT type_id, '[' || string_agg('{\"field_name\":\"' || field_name || '\",\"required\":' || required || '}', ',' ORDER BY '{\"field_name\":\"' || field_name || '\",\"required\":' || required || '}') || ']' AS json FROM (SELECT DISTINCT type_id, field_name, required FROM type_fields WHERE required IS NOT NULL) GROUP BY 1")
def stable_types(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each type as JSON in a fixed order."""
    return P.stable_json(table(spark, d, "type_fields", "type_id", "field_name", "required").where("required IS NOT NULL").distinct(), "type_id")


@DOMAIN.add(
    """WITH s AS (SELECT CAST(g.engine_version AS VARCHAR) AS engine_version, e.key AS op_key, json_extract_string(e.value, '$.state') AS state, g.created_at, g.fingerprint, g.repo FROM (SELECT DISTINCT * FROM contract_graph_cache WHERE graph_json IS NOT NULL AND repo IS NOT NULL) g, json_each(g.graph_json, '$.operations') e),
r AS (SELECT repo, min((created_at, fingerprint)) AS lo, max((created_at, fingerprint)) AS hi FROM s GROUP BY 1),
a AS (SELECT s.repo, op_key, arg_min(state, engine_version) AS state FROM s JOIN r USING (repo) WHERE (created_at, fingerprint) = lo GROUP BY ALL), b AS (SELECT s.repo, op_key, arg_min(state, engine_version) AS state FROM s JOIN r USING (repo) WHERE (created_at, fingerprint) = hi GROUP BY ALL)
SELECT coalesce(a.repo, b.repo) || ' ' || coalesce(a.op_key, b.op_key) AS op_key, CASE WHEN a.repo IS NULL THEN 'added' WHEN b.repo IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.state AS before, b.state AS after,
 b.repo IS NULL OR a.repo IS NOT NULL AND coalesce(b.state IN ('conflict', 'unresolved'), false) AS breaking FROM a FULL JOIN b ON a.repo = b.repo AND a.op_key = b.op_key WHERE a.repo IS NULL OR b.repo IS NULL OR a.state IS DISTINCT FROM b.state"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Operations of each repo in its first saved snapshot against those in its last."""
    g = table(spark, d, "contract_graph_cache").where("graph_json IS NOT NULL AND repo IS NOT NULL").distinct()
    when = F.struct("created_at", "fingerprint")
    ends = g.groupBy("repo").agg(F.min(when).alias("lo"), F.max(when).alias("hi"))
    held = g.withColumn("w", when).join(ends, "repo").where("w = lo OR w = hi").select("repo", "engine_version", (F.col("w") == F.col("lo")).alias("first"), (F.col("w") == F.col("hi")).alias("last"), F.try_variant_get(F.try_parse_json("graph_json"), "$.operations", "variant").alias("o"))
    ops = spark.sql("SELECT repo, engine_version, first, last, e.key AS k, try_variant_get(e.value, '$.state', 'string') AS state FROM {h} h, LATERAL variant_explode(h.o) AS e(pos, key, value)", h=held)
    side = lambda which: ops.where(which).groupBy(F.concat_ws(" ", "repo", "k").alias("op_key")).agg(F.min_by("state", "engine_version").alias("state"))
    return J.graph_diff(side("first"), side("last"))


@DOMAIN.add(
    f"""WITH {_CANDIDATES}, q AS (SELECT DISTINCT op_key, substr(op_key, strpos(op_key, ' ') + 1) AS k FROM c), o AS (SELECT op_key, split_part(k, ' ', 1) AS method, string_split(trim(substr(k, strpos(k, ' ') + 1), '/'), '/') AS parts FROM q)
SELECT op_key, lower(method) || array_to_string(list_transform(list_filter(parts, lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, '{{') THEN 'By' ELSE '' END || array_to_string(list_transform(regexp_extract_all(s, '[A-Za-z0-9]+'), lambda w: upper(left(w, 1)) || substr(w, 2)), '')), '') AS operation_id FROM o"""
)
def operation_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of operations from method and path."""
    method, path = K.split_operation_key(F.regexp_extract("op_key", r"^\S+ (.*)$", 1))
    return slot_candidates(spark, d).select("op_key").distinct().select("op_key", T.operation_id(method, path).alias("operation_id"))


@DOMAIN.add(
    f"""WITH RECURSIVE {FLAT_TREES}, {_FIELDS}, a AS (SELECT schema_id || ' ' || regexp_extract(entry, '^([^|]*)', 1) AS path, max(entry) AS value FROM old GROUP BY 1), b AS (SELECT schema_id || ' ' || regexp_extract(entry, '^([^|]*)', 1) AS path, max(entry) AS value FROM new GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.value <> b.value"""
)
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """C4: fields added, removed or modified between the first and the last version of each schema."""
    spec, truth = version_facts(spark, d)
    shredded = lambda side: side.where("kind = 'response'").groupBy(F.concat_ws(" ", "op_key", F.regexp_extract("value", r"^([^|]*)", 1)).alias("path")).agg(F.max("value").alias("value"))
    return J.document_diff(shredded(spec), shredded(truth))


@DOMAIN.add(f"WITH {_CANDIDATES}, o AS (SELECT DISTINCT op_key FROM c) SELECT op_key FROM o WHERE ends_with(op_key, '/history') AND op_key <> 'GET /history' ORDER BY op_key LIMIT 5")
def suggested_operations(spark: SparkSession, d: str) -> DataFrame:
    """Up to five operations that end with the path of a key that isn't there."""
    return E.find_operation(slot_candidates(spark, d).select("op_key").distinct(), "GET /history")[1]
