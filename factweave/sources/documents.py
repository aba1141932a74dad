"""Structured documentation and OpenAPI documents as candidates and schema nodes (A2-A10)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.keys import operation_key, schema_ref
from factweave.operators.nested import SCHEMA_EDGES, tree_nodes

DOC_CONFIDENCE, OPENAPI_CONFIDENCE = 0.7, 0.95
#: The methods that a path item may hold.
METHODS = ["get", "put", "post", "delete", "patch", "head", "options", "trace"]


def parse_text(text: str) -> dict:
    """JSON, or YAML where the module is installed; a document must be an object."""
    try:
        value = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the document is not JSON, and YAML cannot be read here") from e
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("the document is neither JSON nor YAML") from e
    if not isinstance(value, dict):
        raise ValueError("a document must be an object")
    return value


def read_documentation(spark: SparkSession, text: str, source: str = "doc") -> DataFrame:
    """A2: ``op_key, summary, status, content_type, schema, confidence, state`` of one document.

    Raises on a missing method, a path without a leading slash, no responses, a status that is no
    number, or an operation given twice.
    """
    rows, seen = [], set()
    for op in parse_text(text).get("operations") or []:
        method, path = str(op.get("method") or "").strip().upper(), str(op.get("path") or "").strip()
        if not method:
            raise ValueError("an operation without a method")
        if not path.startswith("/"):
            raise ValueError(f"the path {path!r} is relative")
        if not op.get("responses"):
            raise ValueError(f"{method} {path} has no responses")
        if (method, path) in seen:
            raise ValueError(f"{method} {path} is given twice")
        seen.add((method, path))
        for status, r in op["responses"].items():
            if not str(status).isdigit() or not 100 <= int(status) <= 599:
                raise ValueError(f"{method} {path} has the status {status!r}")
            rows.append((method, path, op.get("summary"), str(status), (r or {}).get("content_type"), (r or {}).get("schema"), source))
    df = spark.createDataFrame(rows, "method string, path string, summary string, status string, content_type string, schema string, source string")
    return df.select(operation_key(F.col("method"), F.col("path")).alias("op_key"), "summary", "status", "content_type", "schema", "source", F.lit(DOC_CONFIDENCE).alias("confidence"), F.lit("document_only").alias("state"))


def _with_document(documents: DataFrame) -> DataFrame:
    """``doc_id, doc``: parsed documents; an unreadable one raises."""
    parsed = F.try_parse_json("text")
    return documents.select("doc_id", F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("unreadable document "), F.col("doc_id").cast("string"))).cast("variant")).alias("doc"))


def openapi_operations(documents: DataFrame) -> DataFrame:
    """``doc_id, op_key, method, path, operation_id, summary, body_schema, op`` of every operation.

    Both layouts are read: OpenAPI 3 bodies under ``requestBody``, Swagger 2 bodies as a ``body``
    parameter; ``basePath`` goes before the path. ``documents``: ``doc_id, text`` (JSON).
    """
    spark = documents.sparkSession
    base = _with_document(documents).select("doc_id", F.try_variant_get("doc", "$.paths", "variant").alias("paths"), F.coalesce(F.try_variant_get("doc", "$.basePath", "string"), F.lit("")).alias("base"))
    paths = spark.sql("SELECT doc_id, base, e.key AS path, e.value AS item FROM {b} b, LATERAL variant_explode(b.paths) AS e(pos, key, value)", b=base)
    names = ", ".join(f"'{m}'" for m in METHODS)
    ops = spark.sql(f"SELECT doc_id, base, path, e.key AS method, e.value AS op FROM {{p}} p, LATERAL variant_explode(p.item) AS e(pos, key, value) WHERE lower(e.key) IN ({names})", p=paths)
    full = F.concat(F.rtrim("base", F.lit("/")), F.col("path"))
    body = F.coalesce(*[F.try_variant_get("op", f"$.requestBody.content['{t}'].schema['$ref']", "string") for t in ("application/json", "application/x-www-form-urlencoded", "multipart/form-data")])
    swagger = F.filter(F.coalesce(F.try_variant_get("op", "$.parameters", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.try_variant_get(p, "$.in", "string") == "body")
    old = F.try_variant_get(F.get(swagger, F.lit(0)), "$.schema['$ref']", "string")
    return ops.select("doc_id", operation_key(F.col("method"), full).alias("op_key"), F.upper("method").alias("method"), full.alias("path"), F.try_variant_get("op", "$.operationId", "string").alias("operation_id"), F.try_variant_get("op", "$.summary", "string").alias("summary"), schema_ref(F.coalesce(body, old)).alias("body_schema"), "op")


def openapi_parameters(operations: DataFrame) -> DataFrame:
    """A3: ``doc_id, op_key, seq, name, location, required, type`` of the parameters but ``body``."""
    rows = operations.sparkSession.sql("SELECT doc_id, op_key, e.pos AS seq, e.value AS p FROM {o} o, LATERAL variant_explode(try_variant_get(o.op, '$.parameters', 'variant')) AS e(pos, key, value)", o=operations)
    get = lambda path, t="string": F.try_variant_get("p", path, t)
    return rows.select("doc_id", "op_key", F.col("seq").cast("long").alias("seq"), get("$.name").alias("name"), get("$.in").alias("location"), F.coalesce(get("$.required", "boolean"), F.lit(False)).alias("required"), F.coalesce(get("$.schema.type"), get("$.type")).alias("type")).where("name IS NOT NULL AND location <> 'body'")


def openapi_responses(operations: DataFrame) -> DataFrame:
    """A3, A10: ``doc_id, op_key, status, description, content_type, schema`` of every response.

    Of several media types the lexicographically first counts.
    """
    spark = operations.sparkSession
    rows = spark.sql("SELECT doc_id, op_key, e.key AS status, e.value AS r FROM {o} o, LATERAL variant_explode(try_variant_get(o.op, '$.responses', 'variant')) AS e(pos, key, value)", o=operations)
    media = F.array_min(F.map_keys(F.try_variant_get("r", "$.content", "map<string,variant>")))
    ref = F.try_variant_get(F.try_element_at(F.try_variant_get("r", "$.content", "map<string,variant>"), media), "$.schema['$ref']", "string")
    return rows.select("doc_id", "op_key", "status", F.try_variant_get("r", "$.description", "string").alias("description"), media.alias("content_type"), schema_ref(F.coalesce(ref, F.try_variant_get("r", "$.schema['$ref']", "string"))).alias("schema"))


def openapi_schemas(documents: DataFrame) -> DataFrame:
    """A3-A5: ``schema_id, path, parent_path, edge, ordinal, name, type, required, open, ref, unknown`` of
    the documents' named schemas, roots included. ``additionalProperties`` that is a schema makes a
    node unknown, ``true`` makes it open."""
    spark = documents.sparkSession
    base = _with_document(documents).select("doc_id", F.coalesce(F.try_variant_get("doc", "$.components.schemas", "variant"), F.try_variant_get("doc", "$.definitions", "variant")).alias("s"))
    roots = spark.sql("SELECT e.key AS schema_id, e.value AS node FROM {b} b, LATERAL variant_explode(b.s) AS e(pos, key, value)", b=base)
    return schema_rows(roots)


def schema_rows(roots: DataFrame) -> DataFrame:
    """Node rows, roots included, of ``schema_id, node`` trees, for ``schema_tree.flatten``."""
    below = tree_nodes(roots, "schema_id", "node", SCHEMA_EDGES)
    path = F.col("node_path")
    all_nodes = below.select("schema_id", path.alias("path"), "parent_path", "edge", "ordinal", "name").unionByName(roots.select("schema_id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(None).cast("string").alias("edge"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("name")))
    return all_nodes.join(node_properties(roots), ["schema_id", "path"], "left").join(required_names(roots), ["schema_id", "parent_path", "name"], "left").withColumn("required", F.coalesce("required", F.lit(False)))


def _walk(roots: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in rows(json.loads(t))]
            columns = list(zip(*out, strict=True)) or [()] * len(schema.split(", "))
            yield pa.RecordBatch.from_pydict({n.split()[0]: list(c) for n, c in zip(schema.split(", "), columns, strict=True)}, schema=_arrow(schema))

    return roots.select("schema_id", F.to_json("node").alias("t")).mapInArrow(run, schema)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _nodes(node: object, path: str = ""):
    if not isinstance(node, dict):
        return
    yield path, node
    for word, (edge, kind) in SCHEMA_EDGES.items():
        child = node.get(word)
        if kind == "map" and isinstance(child, dict):
            for k, v in child.items():
                yield from _nodes(v, f"{path}/{edge}/{k.replace('~', '~0').replace('/', '~1')}")
        elif kind == "list" and isinstance(child, list):
            for i, v in enumerate(child):
                yield from _nodes(v, f"{path}/{edge}/{i}")
        elif kind == "one":
            yield from _nodes(child, f"{path}/{edge}")


def node_properties(roots: DataFrame) -> DataFrame:
    """``schema_id, path, type, open, ref, unknown`` of every node; a tree is one row and read at once."""

    def rows(tree):
        for path, n in _nodes(tree):
            types = n.get("types") or n.get("type")
            types = [t for t in (types if isinstance(types, list) else [types]) if t and t != "null"]
            extra = n.get("additionalProperties", n.get("additional_properties"))
            ref = n.get("$ref") or n.get("ref")
            yield path, "|".join(map(str, types)) or None, extra is True, str(ref).rsplit("/", 1)[-1] if ref else None, isinstance(extra, dict) or bool(n.get("unknown"))

    return _walk(roots, rows, "schema_id string, path string, type string, open boolean, ref string, unknown boolean")


def required_names(roots: DataFrame) -> DataFrame:
    """``schema_id, parent_path, name, required`` of the properties that their node requires."""

    def rows(tree):
        for path, n in _nodes(tree):
            for name in dict.fromkeys(x for x in n.get("required") or [] if isinstance(x, str)) if isinstance(n.get("required"), list) else ():
                yield path, name, True

    return _walk(roots, rows, "schema_id string, parent_path string, name string, required boolean")


def apply_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """``path, value`` rows with those of the overlay in place of the base's or added to them."""
    o = overlay.select("path", F.col("value").alias("__new"), F.lit(True).alias("__o"))
    return base.join(o, "path", "full_outer").select("path", F.when(F.col("__o"), F.col("__new")).otherwise(F.col("value")).alias("value"))


def workflow_steps(documents: DataFrame) -> DataFrame:
    """``doc_id, workflow_id, pos, step_id, operation_id`` of workflow documents."""
    spark = documents.sparkSession
    base = _with_document(documents).select("doc_id", F.try_variant_get("doc", "$.workflows", "variant").alias("w"))
    flows = spark.sql("SELECT doc_id, try_variant_get(e.value, '$.workflowId', 'string') AS workflow_id, try_variant_get(e.value, '$.steps', 'variant') AS s FROM {b} b, LATERAL variant_explode(b.w) AS e(pos, key, value)", b=base)
    return spark.sql("SELECT doc_id, workflow_id, e.pos AS pos, try_variant_get(e.value, '$.stepId', 'string') AS step_id, try_variant_get(e.value, '$.operationId', 'string') AS operation_id FROM {f} f, LATERAL variant_explode(f.s) AS e(pos, key, value)", f=flows)
