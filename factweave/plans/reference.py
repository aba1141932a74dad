"""Queries that apply the reference's operators to the tables at hand.

The tables hold few of the reference's own objects, so most queries apply an operator to data of the
same shape; the docstring names the operator. Each has a DuckDB twin unless stated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import keys as K
from factweave.functions import text as T
from factweave.operators import candidates as C
from factweave.operators import evidence as E
from factweave.operators import graph as G
from factweave.operators import incremental as N
from factweave.operators import joins as J
from factweave.operators import metrics as M
from factweave.operators import ordering as O
from factweave.operators import validate as V
from factweave.operators.nested import with_object
from factweave.operators.schema_tree import flatten
from factweave.plans.registry import Registry
from factweave.plans.schema_sql import FLAT_TREES
from factweave.tables import cut_lineage, table

REFERENCE = Registry()


@REFERENCE.add("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_representative(spark: SparkSession, d: str) -> DataFrame:
    """D1 reduced, I10: documents of equal text and the first of each."""
    docs = table(spark, d, "documents", "doc_id", "text", "source").where("text IS NOT NULL")
    return docs.select(F.sha2("text", 256).alias("text_hash"), "doc_id", "source").groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


def slot_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates table in the long form of the resolution operators, with keys in normal form (I1-I4);
    repeated rows once."""
    c = table(spark, d, "candidates").dropDuplicates(["cand_id"])
    value = F.coalesce(F.to_json("param"), F.to_json("body"), F.to_json("response"))
    key = F.concat_ws(" ", "repo", K.normalize_operation_key(F.col("op_key"), templates=True))
    return c.select(key.alias("op_key"), "slot_kind", F.lower(K.trim_space(F.col("slot_key"))).alias("slot_key"), F.col("cand_id").alias("seq"), value.alias("value_json"), "confidence", F.lower(K.trim_space(F.col("status"))).alias("status"), "evidence", "param", "body", "response")


_PRIORITY = """(CASE WHEN coalesce(src, 0) > 0 THEN src ELSE CASE status WHEN 'verified' THEN 5 WHEN 'observed' THEN 4 WHEN 'declared' THEN 3 WHEN 'inferred' THEN 1 ELSE 0 END END) * 10.0::DOUBLE
 + CASE status WHEN 'verified' THEN 5 WHEN 'declared' THEN 4 WHEN 'observed' THEN 3 WHEN 'inferred' THEN 2 WHEN 'inconclusive' THEN 1 ELSE 0 END"""
_CANDIDATES = rf"""c0 AS (SELECT DISTINCT ON (cand_id) *, regexp_replace(op_key, '^\s+|\s+$', '', 'g') AS k0 FROM candidates),
c1 AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(k0, '^\S*\s*(.*)$', 1), ':([^/]*)', '{{\1}}', 'g'), '(^|/)\*([A-Za-z0-9_][^/]*)', '\1{{\2}}', 'g') AS p0 FROM c0),
c2 AS (SELECT *, replace(CASE WHEN starts_with(p0, '/') THEN p0 ELSE '/' || p0 END, '//', '/') AS p1 FROM c1),
c3 AS (SELECT repo || ' ' || upper(regexp_extract(k0, '^(\S*)', 1)) || ' ' || CASE WHEN p0 = '' THEN '' WHEN length(p1) > 1 THEN regexp_replace(p1, '/+$', '') ELSE p1 END AS op_key,
 slot_kind, lower(trim(slot_key)) AS slot_key, cand_id AS seq, confidence, lower(trim(status)) AS status, param, body, response, evidence,
 (SELECT max(CASE lower(trim(e.source)) WHEN 'source' THEN 5 WHEN 'runtime' THEN 4 WHEN 'openapi' THEN 3 WHEN 'documentation' THEN 2 WHEN 'human' THEN 2 WHEN 'llm' THEN 1 ELSE 0 END) FROM (SELECT unnest(evidence) AS e)) AS src,
 coalesce(to_json(param), 'null') || coalesce(to_json(body), 'null') || coalesce(to_json(response), 'null') AS v FROM c2),
c AS (SELECT *, {_PRIORITY} AS rank, {_PRIORITY} + coalesce(confidence, 0) AS prio FROM c3)"""


@REFERENCE.add(
    f"""WITH {_CANDIDATES} SELECT op_key, slot_kind, slot_key, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' ELSE coalesce(arg_max(status, (rank, -seq)), 'unresolved') END AS state,
 CASE WHEN count(DISTINCT v) = 1 THEN arg_max(seq, (prio, -seq)) END AS representative, max(confidence) AS confidence, count(*) AS candidates FROM c GROUP BY op_key, slot_kind, slot_key"""
)
def candidate_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The state of every slot, its representative where its values are equal, the resolved confidence."""
    return C.resolve(slot_candidates(spark, d)).select("op_key", "slot_kind", "slot_key", "state", "representative", "confidence", "candidates")


@REFERENCE.add(
    f"""WITH {_CANDIDATES}, k AS (SELECT op_key, slot_kind, slot_key, v, coalesce(response.status, '') || '|' || coalesce(response.code, 0) || '|' || coalesce(response.code_known, false) || '|' || coalesce(response.failure, false) || '|' || coalesce(response.raw, false) AS class FROM c WHERE slot_kind = 'response'),
g AS (SELECT op_key, slot_kind, slot_key, class, count(DISTINCT v) > 1 AS conflict, count(*) AS n FROM k GROUP BY ALL)
SELECT op_key, slot_kind, slot_key, bool_or(conflict) AS conflict, count(*) AS variants, sum(n)::BIGINT AS candidates FROM g GROUP BY ALL"""
)
def response_variants(spark: SparkSession, d: str) -> DataFrame:
    """Responses of several classes are variants, not conflicts."""
    r = F.col("response")
    rows = slot_candidates(spark, d).where("slot_kind = 'response'").withColumn("class", C.response_class(r["status"], r["code"], r["code_known"], r["failure"], r["raw"]))
    return C.resolve_variants(rows, "class").select("op_key", "slot_kind", "slot_key", F.col("different").alias("conflict"), "variants", "candidates")


@REFERENCE.add(
    f"""WITH {_CANDIDATES}, r AS (SELECT op_key, response.status AS status, seq, response.content_type AS ct, response.description AS description, response.code AS code, response.code_known AS known, response.failure AS failure, response.raw AS raw FROM c WHERE slot_kind = 'response'),
t AS (SELECT op_key, status, string_agg(description, '; ' ORDER BY seq, description) AS descriptions FROM (SELECT op_key, status, description, min(seq) AS seq FROM r WHERE coalesce(description, '') <> '' GROUP BY ALL) GROUP BY ALL),
g AS (SELECT op_key, status, arg_min(ct, seq) FILTER (WHERE coalesce(ct, '') <> '') AS content_type, list_sort(list_distinct(list(code) FILTER (WHERE known AND code IS NOT NULL))) AS codes,
 coalesce(bool_or(failure), false) AS failure, coalesce(bool_or(raw), false) AS raw, count(*) AS candidates FROM r WHERE status IS NOT NULL GROUP BY ALL)
SELECT op_key, status, content_type, coalesce(array_to_string(codes, ','), '') AS codes, failure, raw, candidates, coalesce(descriptions, '') AS descriptions FROM g LEFT JOIN t USING (op_key, status)"""
)
def response_groups(spark: SparkSession, d: str) -> DataFrame:
    """Responses grouped by status, with their different descriptions."""
    rows = slot_candidates(spark, d).where("slot_kind = 'response' AND response.status IS NOT NULL").select("op_key", "seq", "response.status", "response.description", "response.content_type", "response.code", "response.code_known", "response.failure", "response.raw")
    return C.group_responses(rows).select("op_key", "status", "content_type", F.array_join("codes", ",").alias("codes"), "failure", "raw", "candidates", "descriptions")


@REFERENCE.add(
    f"""WITH {_CANDIDATES} SELECT op_key, CASE WHEN bool_or(status = 'conflict') THEN 'conflict' WHEN count(*) > 1 THEN 'matched' ELSE min(status) END AS state,
 coalesce(min(nullif(confidence, 0)), 0) AS confidence, arg_min(slot_key, seq) FILTER (WHERE slot_key <> '') AS operation_id, count(*) AS sources FROM c GROUP BY op_key"""
)
def operation_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Operation scalars merged over their claims."""
    rows = slot_candidates(spark, d).select("op_key", "seq", F.col("status").alias("state"), "confidence", F.col("slot_key").alias("operation_id"), F.lit("").alias("summary"), F.lit("").alias("description"))
    return C.merge_operations(rows).select("op_key", "state", "confidence", "operation_id", "sources")


@REFERENCE.add("SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def stable_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by event type as one text per user."""
    return C.stable_counts(table(spark, d, "events", "user_id", "event_type"), "event_type", ["user_id"])


@REFERENCE.add(
    """WITH p AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem), t AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM p GROUP BY 1)
SELECT l_partkey, l_returnflag, count(*) = any_value(n) AS required FROM p JOIN t USING (l_partkey) GROUP BY ALL"""
)
def keys_on_every_path(spark: SparkSession, d: str) -> DataFrame:
    """Flags that every supplier of a part shows."""
    return C.keys_on_every_path(table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey"], "l_suppkey", "l_returnflag")


@REFERENCE.add("SELECT field_name, min(type_str) AS type_str FROM type_fields GROUP BY 1 HAVING count(DISTINCT type_str) = 1")
def unique_field_types(spark: SparkSession, d: str) -> DataFrame:
    """Field names with one type."""
    return C.unique_index(table(spark, d, "type_fields", "field_name", "type_str"), "field_name", "type_str")


@REFERENCE.add("SELECT p_brand, list_sort(list_distinct(list(p_type))) AS \"values\" FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 2")
def enum_types(spark: SparkSession, d: str) -> DataFrame:
    """Values of types with two or more constants."""
    return C.enum_values(table(spark, d, "part", "p_brand", "p_type"), "p_brand", "p_type")


_KEYED = r"""k AS (SELECT DISTINCT operation_key, regexp_replace(operation_key, '^\s+|\s+$', '', 'g') AS k FROM operation_dependencies),
p AS (SELECT *, upper(regexp_extract(k, '^(\S*)', 1)) AS method, regexp_extract(k, '^\S*\s*(.*)$', 1) AS p0 FROM k),
r AS (SELECT *, replace(CASE WHEN starts_with(p0, '/') THEN p0 ELSE '/' || p0 END, '//', '/') AS p1 FROM p),
n AS (SELECT operation_key, method, CASE WHEN p0 = '' THEN '' WHEN length(p1) > 1 THEN regexp_replace(p1, '/+$', '') ELSE p1 END AS path FROM r)"""


def operation_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distinct spellings of operation keys with their normal method and path."""
    raw = table(spark, d, "operation_dependencies", "operation_key").distinct()
    method, path = K.split_operation_key(F.col("operation_key"))
    return raw.select("operation_key", K.normalize_method(method).alias("method"), K.normalize_path(path).alias("path"))


@REFERENCE.add(f"WITH {_KEYED} SELECT method, count(*) AS routes, count(DISTINCT path) AS distinct_routes, count(*) - count(DISTINCT path) AS collapsed FROM n GROUP BY 1")
def path_identity(spark: SparkSession, d: str) -> DataFrame:
    """Spellings, different routes, and routes that collapse."""
    return operation_paths(spark, d).groupBy("method").agg(F.count("*").alias("routes"), F.count_distinct("path").alias("distinct_routes")).withColumn("collapsed", F.col("routes") - F.col("distinct_routes"))


@REFERENCE.add(
    rf"""WITH {_KEYED}, u AS (SELECT DISTINCT method || ' ' || path AS op_key, path FROM n)
SELECT op_key, unnest(list_distinct(regexp_extract_all(path, '\{{([^{{}}/]+)\}}', 1))) AS name, 'added' AS state FROM u"""
)
def template_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Template names that lack a path parameter (none is given here, so all are added)."""
    ops = operation_paths(spark, d).select(F.concat_ws(" ", "method", "path").alias("op_key"), "path").distinct()
    return E.path_parameters(ops, ops.select("op_key", F.lit("query").alias("location"), F.lit("q").alias("name")))


@REFERENCE.add(
    f"""WITH {_KEYED}, u AS (SELECT DISTINCT method, path FROM n)
SELECT method, path, row_number() OVER (PARTITION BY method ORDER BY string_split(regexp_replace(path, '^/', ''), '/')) AS place,
 CASE method WHEN 'GET' THEN 0 WHEN 'PUT' THEN 1 WHEN 'POST' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4 ELSE 8 END AS method_rank FROM u"""
)
def path_order(spark: SparkSession, d: str) -> DataFrame:
    """paths in segment order within each method."""
    u = operation_paths(spark, d).select("method", "path").distinct().withColumn("order", T.path_order(F.col("path")))
    return O.numbered(u, ["method"], ["order", "path"], "place").drop("order").withColumn("method_rank", T.method_order(F.col("method")))


@REFERENCE.add(
    """WITH f AS (SELECT DISTINCT ON (file_id) file_id, len(string_split(content, chr(10))) AS n FROM source_files ORDER BY file_id, captured_at DESC, content DESC)
SELECT symbol_id AS fact_id, count(*) AS evidence FROM (SELECT DISTINCT symbol_id, file_id, end_line FROM symbols) s JOIN f USING (file_id) WHERE end_line BETWEEN 1 AND n GROUP BY 1"""
)
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2: symbols whose recorded last line exists in the newest capture of their file."""
    newest = table(spark, d, "source_files", "file_id", "content", "captured_at").groupBy("file_id").agg(F.max_by(F.size(F.split("content", "\n")), F.struct("captured_at", "content")).alias("n_lines"))
    files = newest.select(F.col("file_id").cast("string").alias("file"), F.lit("").alias("blob_sha"), "n_lines")
    place = F.struct(F.col("file_id").cast("string").alias("file"), F.col("end_line").alias("start_line"), F.lit("").alias("blob_sha"))
    facts = table(spark, d, "symbols", "symbol_id", "file_id", "end_line").distinct().groupBy(F.col("symbol_id").alias("fact_id")).agg(F.collect_list(place).alias("evidence"))
    kept, _ = E.evidence_gate(facts, files)
    return kept.select("fact_id", F.size("evidence").cast("long").alias("evidence"))


def newest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the newest capture of each file."""
    newest = table(spark, d, "source_files", "file_id", "content", "captured_at").groupBy("file_id").agg(F.max_by("content", F.struct("captured_at", "content")).alias("text"))
    return E.source_lines(newest, "file_id")


_LINES = "l AS (SELECT file_id AS file, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM (SELECT DISTINCT ON (file_id) file_id, content FROM source_files ORDER BY file_id, captured_at DESC, content DESC))"


@REFERENCE.add(f"WITH {_LINES} SELECT file, line_no, length(text) AS length FROM l WHERE regexp_matches(text, '^func ') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = l.file AND s.line = l.line_no)")
def missed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like functions and are not in the index."""
    accepted = table(spark, d, "symbols", "file_id", "line").select(F.col("file_id").alias("file"), F.col("line").alias("line_no"))
    return E.missed_lines(newest_lines(spark, d), "^func ", accepted).select("file", "line_no", F.length("text").alias("length"))


@REFERENCE.add(f"WITH {_LINES} SELECT file, line_no, length(concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w, text, lead(text) OVER w, lead(text, 2) OVER w)) AS length FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no)")
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    """E5: size of the text two lines around each line."""
    return E.line_windows(newest_lines(spark, d)).select("file", "line_no", F.length("window").alias("length"))


@REFERENCE.add(
    f"""WITH {_LINES}, y AS (SELECT DISTINCT file_id, line AS start_line, end_line, symbol_id FROM symbols WHERE kind IN ('func', 'method') AND end_line IS NOT NULL)
SELECT file, line_no, min(symbol_id) AS symbol_id FROM l JOIN y ON file = file_id AND line_no BETWEEN start_line AND end_line WHERE contains(text, 'return') GROUP BY ALL"""
)
def range_locate(spark: SparkSession, d: str) -> DataFrame:
    """The function around each line that returns."""
    points = newest_lines(spark, d).where(F.contains("text", F.lit("return"))).select("file", "line_no")
    symbols = table(spark, d, "symbols", "symbol_id", "kind", "file_id", "line", "end_line").where("kind IN ('func', 'method') AND end_line IS NOT NULL")
    ranges = symbols.select(F.col("file_id").alias("file"), F.col("line").alias("start_line"), "end_line", "symbol_id").distinct()
    return J.point_in_range(points, ranges, ["file"], "line_no", "start_line", "end_line", "symbol_id")


@REFERENCE.add(r"""SELECT DISTINCT site_id, regexp_extract(site, '^([^\s:]+):\d+', 1) AS file, try_cast(regexp_extract(site, '^[^\s:]+:(\d+)', 1) AS INT) AS line, regexp_extract(site, '^\S+\s+(.*)$', 1) AS expression FROM site_contexts""")
def site_parts(spark: SparkSession, d: str) -> DataFrame:
    """File, line and expression of each site."""
    return table(spark, d, "site_contexts", "site_id", "site").select("site_id", T.site_file(F.col("site")).alias("file"), T.site_line(F.col("site")).alias("line"), T.site_expression(F.col("site")).alias("expression")).distinct()


@REFERENCE.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a large order."""
    return J.orphans(table(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer", "c_custkey"), "c_custkey")


@REFERENCE.add(
    """WITH s AS (SELECT o_custkey AS op_key, o_orderdate < TIMESTAMP '1995-01-01' AS early, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY ALL),
j AS (SELECT coalesce(a.op_key, b.op_key) AS op_key, a.state AS before, b.state AS after, a.op_key IS NULL AS is_new, b.op_key IS NULL AS gone FROM (SELECT * FROM s WHERE early) a FULL JOIN (SELECT * FROM s WHERE NOT early) b ON a.op_key = b.op_key)
SELECT op_key, CASE WHEN is_new THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS kind, before, after, gone AS breaking FROM j WHERE is_new OR gone OR before <> after"""
)
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    """Last order status of each customer before and after a date."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")
    state = lambda rows: rows.groupBy(F.col("o_custkey").alias("op_key")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("state"))
    return J.graph_diff(state(o.where(early)), state(o.where(~early)))


@REFERENCE.add(
    """WITH cur AS (SELECT file_path, arg_max(file_hash, (recorded_at, dep_seq)) AS h FROM (SELECT file_path, coalesce(file_hash, '') AS file_hash, recorded_at, dep_seq FROM operation_dependencies) GROUP BY 1)
SELECT DISTINCT operation_key FROM operation_dependencies d JOIN cur c USING (file_path) WHERE coalesce(d.file_hash, '') IS DISTINCT FROM c.h"""
)
def stale_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operations with a dependency whose file has another hash by now."""
    deps = table(spark, d, "operation_dependencies", "operation_key", "file_path", "file_hash", "recorded_at", "dep_seq").withColumn("file_hash", F.coalesce("file_hash", F.lit("")))
    return N.stale_rows(deps.select("operation_key", "file_path", "file_hash").distinct(), N.latest_state(deps, ["file_path"], "file_hash", ["recorded_at", "dep_seq"]), "operation_key")


@REFERENCE.add(
    """WITH e AS (SELECT entry_id, unnest(CASE WHEN len(reads) > 0 THEN reads ELSE [NULL] END) AS r FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries)),
cur AS (SELECT r.tool AS tool, r.args AS args, max(r.digest) AS digest FROM e WHERE r IS NOT NULL GROUP BY ALL)
SELECT entry_id, bool_and(r IS NULL OR coalesce(r.digest = c.digest, false)) AS valid FROM e LEFT JOIN cur c ON e.r.tool = c.tool AND e.r.args = c.args GROUP BY 1"""
)
def replay_valid(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose tool reads would still give the same."""
    entries = table(spark, d, "cache_entries", "entry_id", "reads").dropDuplicates(["entry_id"])
    current = entries.select(F.explode("reads").alias("r")).groupBy("r.tool", "r.args").agg(F.max("r.digest").alias("digest"))
    return J.replay_valid(entries, current, "entry_id")


@REFERENCE.add(
    """WITH y AS (SELECT DISTINCT file_path AS file, regexp_extract(symbol_id, '([^.]+)$', 1) AS name FROM symbols WHERE kind = 'func'),
s AS (SELECT name, min(file) AS only_file FROM y GROUP BY 1 HAVING count(DISTINCT file) = 1),
u AS (SELECT DISTINCT file_path AS file, regexp_extract(symbol_id, '([^.]+)$', 1) AS name FROM symbols)
SELECT u.file, u.name, CASE WHEN y.name IS NOT NULL THEN u.file ELSE only_file END AS def_file FROM u LEFT JOIN y USING (file, name) LEFT JOIN s ON s.name = u.name"""
)
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The definition of a name: in the same file, else the only one."""
    y = table(spark, d, "symbols", "symbol_id", "kind", "file_path").select(F.col("file_path").alias("file"), F.regexp_extract("symbol_id", "([^.]+)$", 1).alias("name"), "kind")
    return J.resolve_names(y.select("file", "name"), y.where("kind = 'func'").select("file", "name"))


@REFERENCE.add("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 16")
def lru_prune(spark: SparkSession, d: str) -> DataFrame:
    """The latest 16 events of each user."""
    return J.latest_rows(table(spark, d, "events", "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 16)


@REFERENCE.add(
    """SELECT o_orderkey, o_orderstatus FROM (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) OVER (ORDER BY o_orderdate, o_orderkey) AS cum FROM orders) WHERE o_orderstatus = 'F' OR cum <= 5000"""
)
def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """Free orders all, paid ones until the budget of 5,000 is used."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    return O.select_within_budget(o, F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"], 5000).select("o_orderkey", "o_orderstatus")


@REFERENCE.add(
    """WITH RECURSIVE s AS (SELECT source, doc_id, least(coalesce(octet_length(encode(text)), 0), 6000)::INT AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, doc_id, size, n, true AS taken, size AS used FROM s WHERE n = 1
 UNION ALL SELECT s.source, s.doc_id, s.size, s.n, f.used + s.size <= 24000, CASE WHEN f.used + s.size <= 24000 THEN f.used + s.size ELSE f.used END FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source AND s.n = f.n + 1)
SELECT source, doc_id, size FROM f WHERE taken"""
)
def capacity_pack(spark: SparkSession, d: str) -> DataFrame:
    """Which documents of each source are packed into 24,000 bytes, skipping what does not fit."""
    return O.pack(table(spark, d, "documents", "doc_id", "source", "text"), "source", "doc_id", "text")


@REFERENCE.add(
    """WITH t AS (SELECT DISTINCT type_id, regexp_extract(type_id, '([^./]+)$', 1) AS last, regexp_extract(type_id, '([^/.]+)\\.[^./]+$', 1) AS pkg FROM type_fields),
f AS (SELECT last, min(type_id) AS first FROM t GROUP BY 1), g AS (SELECT last, pkg, min(type_id) AS second FROM t JOIN f USING (last) WHERE type_id <> first GROUP BY ALL)
SELECT type_id, CASE WHEN type_id = first THEN last WHEN type_id = second AND pkg <> '' THEN pkg || '.' || last
 ELSE last || '-' || lpad(lower(to_hex(list_reduce(list_prepend(2237221::BIGINT, list_transform(string_split(type_id, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 435) & 16777215))), 6, '0') END AS name
FROM t JOIN f USING (last) LEFT JOIN g USING (last, pkg)""".replace("\\\\", "\\")
)
def component_names(spark: SparkSession, d: str) -> DataFrame:
    """Short names of types, unique by package and hash."""
    return O.component_names(table(spark, d, "type_fields", "type_id"))


@REFERENCE.add("SELECT user_id, block, count(*) AS hits FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 80 AS block FROM events) GROUP BY ALL")
def hit_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Hits in blocks of 80."""
    return O.blocks(table(spark, d, "events", "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).groupBy("user_id", "block").agg(F.count("*").alias("hits"))


@REFERENCE.add(
    """WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 150000), t AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT (SELECT count(*) FROM s JOIN t USING (o_custkey, o_orderpriority)) AS tp, (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM t) AS nt)
SELECT tp, ns - tp AS fp, nt - tp AS fn, tp / ns AS precision, tp / nt AS recall, 2 * (tp / ns) * (tp / nt) / (tp / ns + tp / nt) AS f1 FROM c"""
)
def micro_prf1(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision, recall and F1 over the priorities of each customer."""
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return M.micro_average(M.set_counts(o.where("o_totalprice > 150000"), o.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderpriority"))


@REFERENCE.add(
    """WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 30), t AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 100000),
c AS (SELECT (SELECT count(*) FROM s JOIN t USING (k)) AS hits, (SELECT count(*) FROM t) AS truth, (SELECT count(*) FROM s) AS generated) SELECT hits, truth, generated, hits / truth AS recall, hits / generated AS precision FROM c"""
)
def set_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2: recall and precision of one key set against another."""
    s = table(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 30").select(F.col("l_orderkey").alias("k"))
    return M.route_metrics(s, table(spark, d, "orders", "o_orderkey", "o_totalprice").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k")), ["k"])


@REFERENCE.add("SELECT s_nationkey AS k FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def list_difference(spark: SparkSession, d: str) -> DataFrame:
    """suppliers' nations outside one region, duplicates kept."""
    return M.list_difference(table(spark, d, "supplier", "s_nationkey").select(F.col("s_nationkey").alias("k")), table(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")), "k")


@REFERENCE.add(
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_quantity > 45 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_quantity < 5),
r AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY 1"""
)
def text_reach(spark: SparkSession, d: str) -> DataFrame:
    """H2: what one supplier reaches over parts within four steps, by large and small quantities only."""
    l = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity")  # noqa: E741
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = l.where("l_quantity > 45").select(s.alias("caller"), p.alias("callee")).unionByName(l.where("l_quantity < 5").select(p.alias("caller"), s.alias("callee")))
    return G.forward_reach(edges, spark.createDataFrame([("s1",)], "node string"), 4)


@REFERENCE.add(
    """WITH RECURSIVE e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
r AS (SELECT 's1' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY 1"""
)
def forward_reach(spark: SparkSession, d: str) -> DataFrame:
    """H1: what one supplier reaches over parts and suppliers within twelve steps; every row of lineitem
    is an edge from its supplier to its part and one back."""
    l = table(spark, d, "lineitem", "l_suppkey", "l_partkey").distinct()  # noqa: E741
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    edges = l.select(F.inline(F.array(F.struct(s.alias("caller"), p.alias("callee")), F.struct(p.alias("caller"), s.alias("callee")))))
    return G.forward_reach(edges, spark.createDataFrame([("s1",)], "node string"), G.REACH)


@REFERENCE.add("SELECT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def closure_filter(spark: SparkSession, d: str) -> DataFrame:
    """H3: customers in the closure of one region."""
    nation = table(spark, d, "nation", "n_nationkey", "n_regionkey")
    edges = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("callee"))
    seeds = table(spark, d, "region", "r_regionkey", "r_name").where("r_name = 'EUROPE'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey").withColumn("node", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return G.closure_filter(rows, edges, seeds, "node").select("c_custkey", "c_nationkey")


@REFERENCE.add("SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS alternatives FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) BETWEEN 2 AND 8")
def closed_unions(spark: SparkSession, d: str) -> DataFrame:
    """Nations with two to eight market segments."""
    return G.closed_union(table(spark, d, "customer", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment")


@REFERENCE.add(
    """SELECT event_id, m AS method, CASE WHEN m = 'CONNECT' THEN 'unsupported method' ELSE '' END AS unresolved FROM (SELECT event_id, unnest(CASE WHEN event_type = 'view' THEN ['GET','PUT','POST','DELETE','PATCH','HEAD','OPTIONS','TRACE','CONNECT'] ELSE [upper(event_type)] END) AS m FROM events)"""
)
def method_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A route for all methods becomes nine rows."""
    routes = table(spark, d, "events", "event_id", "event_type").select("event_id", F.when(F.col("event_type") == "view", "ALL").otherwise(F.col("event_type")).alias("method"))
    return G.fan_out_methods(routes)


@REFERENCE.add("SELECT DISTINCT k AS path, json_type(v) AS type FROM (SELECT unnest(json_keys(props)) AS k, json_extract(props, '$.' || unnest(json_keys(props))) AS v FROM events)".replace("json_type(v)", "CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN json_type(v) = 'VARCHAR' THEN 'string' ELSE lower(json_type(v)) END"))
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Paths and types of the first level of the event properties, which are free objects without a schema."""
    rows = table(spark, d, "events", "props").select(F.try_parse_json("props").alias("v"))
    flat = spark.sql("SELECT e.key AS path, schema_of_variant(e.value) AS t FROM {rows} r, LATERAL variant_explode(r.v) AS e(pos, key, value)", rows=rows)
    return flat.select("path", F.when(F.col("t") == "BIGINT", "integer").when(F.col("t") == "STRING", "string").otherwise(F.lower("t")).alias("type")).distinct()


def schema_trees(spark: SparkSession, d: str) -> DataFrame:
    """``raw_id, schema_id, received_at, node`` of every readable version of raw_schemas, repeated rows once."""
    raw = table(spark, d, "raw_schemas", "raw_id", "schema_id", "schema_json", "received_at").distinct()
    return with_object(raw, "schema_json").where("node IS NOT NULL").drop("schema_json")


@REFERENCE.add(f"WITH RECURSIVE {FLAT_TREES} SELECT schema_id, raw_id, entry AS triple FROM flat_fields JOIN doc USING (raw_id)")
def schema_flatten(spark: SparkSession, d: str) -> DataFrame:
    """H5, H6, I16: ``path|type|required`` of every readable tree of raw_schemas, all versions."""
    trees = schema_trees(spark, d).select(F.struct("schema_id", "raw_id").alias("tree"), "node")
    return flatten(trees, "tree").where("kind = 'field'").select("tree.schema_id", "tree.raw_id", F.col("entry").alias("triple"))


@REFERENCE.add("SELECT key AS op_key, count(*) AS snapshots, count(DISTINCT json_extract_string(value, '$.state')) AS states FROM (SELECT DISTINCT fingerprint, graph_json FROM contract_graph_cache WHERE graph_json IS NOT NULL) g, json_each(g.graph_json, '$.operations') GROUP BY 1")
def snapshot_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operations over the saved graph snapshots, and how many different states each had."""
    g = table(spark, d, "contract_graph_cache", "fingerprint", "graph_json").where("graph_json IS NOT NULL").distinct().select(F.try_variant_get(F.try_parse_json("graph_json"), "$.operations", "variant").alias("o"))
    ops = spark.sql("SELECT e.key AS op_key, try_variant_get(e.value, '$.state', 'string') AS state FROM {g} g, LATERAL variant_explode(g.o) AS e(pos, key, value)", g=g)
    return ops.groupBy("op_key").agg(F.count("*").alias("snapshots"), F.count_distinct("state").alias("states"))


_DIAGNOSED = rf"""{_CANDIDATES}, w AS (SELECT DISTINCT ON (cand_id) cand_id AS seq, op_key AS raw FROM candidates),
x AS (SELECT substr(c.op_key, strpos(c.op_key, ' ') + 1) AS op_key, slot_kind, slot_key, c.seq, status, v, param.param_in AS loc, coalesce(param.schema, body.schema, response.schema) AS ref, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS k FROM c JOIN w USING (seq)),
o AS (SELECT op_key, regexp_extract(min(k), '^(\S*)', 1) AS method, regexp_extract(min(k), '^\S*\s*(.*)$', 1) AS path, CASE WHEN bool_or(status = 'conflict') THEN 'conflict' WHEN bool_or(status = 'unresolved') THEN 'unresolved' ELSE 'matched' END AS state FROM x GROUP BY op_key),
q AS (SELECT *, replace(CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END, '//', '/') AS p1 FROM o),
s AS (SELECT op_key, slot_kind, slot_key, arg_min(coalesce(loc, ''), seq) AS loc, count(*) AS n, count(DISTINCT v) > 1 AS conflict FROM x GROUP BY ALL),
t AS (SELECT DISTINCT op_key, unnest(regexp_extract_all(path, '\{{([^{{}}/]+)\}}', 1)) AS name FROM o),
known AS (SELECT body.schema AS id, count(*) < 3 AS unknown FROM c WHERE body.schema IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT op_key, slot_kind, slot_key, regexp_extract(trim(ref), '([^/]*)$', 1) AS id FROM x WHERE coalesce(ref, '') <> '')"""


@REFERENCE.add(
    rf"""WITH {_DIAGNOSED}, d AS (
SELECT 'operation_identity' AS code FROM q WHERE method = '' OR path = '' OR op_key <> upper(method) || ' ' || CASE WHEN length(p1) > 1 THEN regexp_replace(p1, '/+$', '') ELSE p1 END
UNION ALL SELECT 'parameter_location' FROM s WHERE slot_kind = 'param' AND lower(loc) NOT IN ('path', 'query', 'header', 'cookie')
UNION ALL SELECT 'parameter_conflict' FROM s WHERE slot_kind = 'param' AND n > 1 AND conflict
UNION ALL SELECT 'schema_reference_missing' FROM r WHERE id NOT IN (SELECT id FROM known)
UNION ALL SELECT 'path_parameter_missing' FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.op_key = t.op_key AND x.slot_key = t.name AND slot_kind = 'param' AND lower(loc) = 'path')
UNION ALL SELECT 'request_body_conflict' FROM s WHERE slot_kind = 'body' AND conflict
UNION ALL SELECT 'response_status' FROM s WHERE slot_kind = 'response' AND NOT coalesce(try_cast(slot_key AS INT) BETWEEN 100 AND 599, false)
UNION ALL SELECT 'response_conflict' FROM s WHERE slot_kind = 'response' AND conflict
UNION ALL SELECT 'operation_conflict' FROM o WHERE state = 'conflict'
UNION ALL SELECT 'operation_unresolved' FROM o WHERE state = 'unresolved'
UNION ALL SELECT 'schema_unknown' FROM known WHERE unknown)
SELECT code, count(*) AS diagnostics FROM d GROUP BY 1"""
)
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of the candidates of all repos as one graph, counted by code. An operation's
    method and path are those of one of its spellings; known schemas are those of request bodies, unknown
    if fewer than three claims name them."""
    return V.diagnostics(*diagnosed_graph(spark, d)).groupBy("code").agg(F.count("*").alias("diagnostics"))


def diagnosed_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations, candidates and schemas for the validation rules."""
    c = slot_candidates(spark, d).join(table(spark, d, "candidates", "cand_id", F.col("op_key").alias("raw")).dropDuplicates(["cand_id"]), F.col("seq") == F.col("cand_id"))
    key = F.regexp_extract("op_key", r"^\S+ (.*)$", 1)
    rows = c.select(key.alias("op_key"), "slot_kind", "slot_key", "seq", "value_json", "status", K.trim_space(F.col("raw")).alias("raw"), F.col("param.param_in").alias("location"), F.coalesce("param.schema", "body.schema", "response.schema").alias("schema_ref"), F.lit(None).cast("string").alias("status_code"), F.col("body.schema").alias("body_schema"))
    rows = cut_lineage(rows)  # a dozen rules read it
    method, path = K.split_operation_key(F.col("raw"))
    state = F.when(F.bool_or(F.col("status") == "conflict"), "conflict").when(F.bool_or(F.col("status") == "unresolved"), "unresolved").otherwise("matched")
    operations = rows.groupBy("op_key").agg(F.min("raw").alias("raw"), state.alias("state")).select("op_key", method.alias("method"), path.alias("path"), "state", F.array().cast("array<string>").alias("gaps"))
    schemas = rows.where("body_schema IS NOT NULL").groupBy(F.col("body_schema").alias("schema_id")).agg((F.count("*") < 3).alias("unknown"))
    return operations, rows, schemas


@REFERENCE.add("SELECT repo, sha256('v1' || chr(0) || string_agg(file_path || chr(0) || coalesce(blob_sha, ''), chr(0) ORDER BY file_path || chr(0) || coalesce(blob_sha, ''))) AS fingerprint, count(*) AS files FROM (SELECT DISTINCT repo, file_path, blob_sha FROM source_files) GROUP BY 1")
def run_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of the files of each repo."""
    return N.run_fingerprint(table(spark, d, "source_files", "repo", "file_path", "blob_sha").distinct(), ["repo"], "file_path", "blob_sha", "v1")


@REFERENCE.add(
    r"""SELECT DISTINCT field_id, CASE split_part(regexp_extract(coalesce(tag, ''), '(?:^|\s)json:"([^"]*)"', 1), ',', 1) WHEN '-' THEN NULL WHEN '' THEN field_name ELSE split_part(regexp_extract(coalesce(tag, ''), '(?:^|\s)json:"([^"]*)"', 1), ',', 1) END AS json,
 CASE WHEN regexp_matches(type_str, '^\*?(string|error)$') THEN 'string' WHEN regexp_matches(type_str, '^\*?(u?int(8|16|32|64)?|byte|rune)$') THEN 'integer' WHEN regexp_matches(type_str, '^\*?float(32|64)$') THEN 'number' WHEN regexp_matches(type_str, '^\*?bool$') THEN 'boolean' END AS scalar,
 nullif(regexp_extract(type_str, '^\*?map\[[^\]]+\](.+)$', 1), '') AS map_value FROM type_fields"""
)
def field_types(spark: SparkSession, d: str) -> DataFrame:
    """Serialised names, scalar types and map value types of struct fields."""
    t = table(spark, d, "type_fields", "field_id", "field_name", "tag", "type_str").distinct()
    return t.select("field_id", T.json_name(F.col("tag"), F.col("field_name")).alias("json"), T.scalar_type(F.col("type_str")).alias("scalar"), T.map_value_type(F.col("type_str")).alias("map_value"))


@REFERENCE.add("SELECT snippet_id, len(list_distinct(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*'))) AS tokens, len(list_distinct(regexp_extract_all(code, '-?\\d+(?:\\.\\d+)?'))) AS numbers FROM (SELECT DISTINCT snippet_id, code FROM source_snippets WHERE code IS NOT NULL)".replace("\\\\", "\\"))
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of different identifiers and numeric literals of each snippet."""
    s = table(spark, d, "source_snippets", "snippet_id", "code").where("code IS NOT NULL").distinct()
    return s.select("snippet_id", F.size(T.token_set(F.col("code"))).cast("long").alias("tokens"), F.size(T.number_set(F.col("code"))).cast("long").alias("numbers"))


@REFERENCE.add("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_quantity) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def relational_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Plain filter and aggregation; checks the set-up, not an operator of the reference."""
    l = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")  # noqa: E741
    return l.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("count_order"))


@REFERENCE.add("SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def relational_join(spark: SparkSession, d: str) -> DataFrame:
    """Plain joins; checks the set-up, not an operator of the reference."""
    c, o = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    l, s = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")  # noqa: E741
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.join(table(spark, d, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
