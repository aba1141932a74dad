"""From a resolved graph to a document and back: ordered rows, YAML and JSON output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.text import location_order, method_order, path_order, status_number, status_text
from factweave.operators.candidates import resolve
from factweave.tables import hadoop_path

SCHEMA_VERSION = "1"


def document_rows(operations: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per slot of each operation in document order: paths by segment, methods,
    parameters by location and name, the body, responses by status. Conflicting slots have no value."""
    slots = resolve(candidates).join(operations.select("op_key", "method", "path", "operation_id", "summary"), "op_key")
    kind = F.when(F.col("slot_kind") == "param", 0).when(F.col("slot_kind") == "body", 1).otherwise(2)
    location = F.get_json_object("value_json", "$.in")
    return slots.withColumn("location", location).orderBy(path_order(F.col("path")), method_order(F.col("method")), kind, location_order(F.coalesce(location, F.lit(""))), F.col("slot_key")).select("op_key", "method", "path", "operation_id", "summary", "slot_kind", "slot_key", "location", "state", "value_json", "confidence", F.when(F.col("slot_kind") == "response", status_text(status_number(F.col("slot_key")))).alias("status_text"))


_PLAIN = re.compile(r"^[A-Za-z_/][A-Za-z0-9_./{}\- ]*$")
_WORDS = {"true", "false", "null", "yes", "no", "on", "off", "~", "y", "n"}


def yaml_scalar(value: object) -> str:
    """Plain where it reads back as the same text, else in double quotes."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    s = str(value)
    return s if _PLAIN.match(s) and s.lower() not in _WORDS and s == s.strip() else json.dumps(s, ensure_ascii=False)


def render_yaml(value: object, indent: int = 0) -> str:
    """Deterministic YAML of dicts (in their order), lists and scalars."""
    pad = "  " * indent
    if isinstance(value, dict):
        if not value:
            return f"{pad}{{}}\n"
        out = ""
        for k, v in value.items():
            key = yaml_scalar(str(k)) if not str(k).isdigit() else f'"{k}"'
            out += f"{pad}{key}:\n{render_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}{key}: {'{}' if v == {} else '[]' if v == [] else yaml_scalar(v)}\n"
        return out
    if isinstance(value, list):
        out = ""
        for v in value:
            if isinstance(v, (dict, list)) and v:
                body = render_yaml(v, indent + 1)
                out += f"{pad}- {body[len(pad) + 2 :]}"
            else:
                out += f"{pad}- {yaml_scalar(v)}\n"
        return out
    return f"{pad}{yaml_scalar(value)}\n"


def render_document(rows: Iterable, title: str = "contract", version: str = "1.0.0") -> str:
    """The document of ordered slot rows as OpenAPI YAML; the same rows give the same bytes.

    Rows are consumed one by one (``DataFrame.toLocalIterator``); the document itself is what the
    driver must hold.
    """
    paths: dict = {}
    for r in rows:
        op = paths.setdefault(r["path"], {}).setdefault(r["method"].lower(), {})
        if r["operation_id"]:
            op["operationId"] = r["operation_id"]
        value = json.loads(r["value_json"]) if r["value_json"] else {"x-state": r["state"]}
        if r["slot_kind"] == "param":
            op.setdefault("parameters", []).append({"name": r["slot_key"], **value})
        elif r["slot_kind"] == "body":
            op["requestBody"] = value
        else:
            op.setdefault("responses", {})[r["slot_key"]] = {"description": r["status_text"], **value}
    return render_yaml({"openapi": "3.1.0", "info": {"title": title, "version": version}, "paths": paths})


def rendered_twice(rows: DataFrame) -> str:
    """The document, after checking that two renderings are equal to the byte."""
    first, second = render_document(rows.toLocalIterator()), render_document(rows.toLocalIterator())
    if first != second:
        raise RuntimeError("two renderings differ")
    return first


def operations_json(operations: DataFrame) -> DataFrame:
    """One JSON text per operation in key order, with the format's version."""
    return operations.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("version"), *[F.col(c) for c in sorted(operations.columns)])).alias("value"), "op_key").orderBy("op_key").select("value")


def body_label(envelope: Column, field: Column, schema: Column) -> Column:
    """A body in short: its schema, within its envelope if it has one; empty without either."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.when(empty(envelope) != "", F.concat(envelope, F.lit("{"), empty(field), F.lit(": "), empty(schema), F.lit("}"))).otherwise(empty(schema))


def response_label(element: Column, schema: Column, map_value: Column) -> Column:
    """A response in short: the element of an array, the schema, or the values of a map."""
    some = lambda c, text: F.when(F.coalesce(c, F.lit("")) != "", text)
    return F.coalesce(some(element, F.concat(F.lit("[]"), element)), some(schema, schema), some(map_value, F.concat(F.lit("map[string]"), map_value)), F.lit(""))


def listing_rows(responses: DataFrame) -> DataFrame:
    """``op_key, response, error_codes``: of each operation the first label by ``seq`` that says something, and
    its codes but 0 in order. ``responses`` has ``op_key, seq, label, code``."""
    said = F.when(F.coalesce("label", F.lit("")) != "", F.col("seq"))
    codes = F.array_sort(F.collect_set(F.when(F.col("code") != 0, F.col("code"))))
    return responses.groupBy("op_key").agg(F.coalesce(F.min_by("label", said), F.lit("")).alias("response"), codes.alias("error_codes"))


def stable_json(rows: DataFrame, group: str) -> DataFrame:
    """Per group the rows as JSON in a fixed order, whatever order they came in."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns) if c != group]))
    return rows.groupBy(group).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(line)), ","), F.lit("]")).alias("json"))


def report(statistics: dict[str, object], low: list[tuple[str, float]], gaps: list[str]) -> str:
    """The run report: counts, operations of low confidence in rising order, gaps."""
    lines = ["# Run report", "", *[f"- {k}: {v}" for k, v in statistics.items()]]
    if low:
        lines += ["", "## Low confidence", "", *[f"- {k}: {c:.2f}" for k, c in sorted(low, key=lambda x: x[1])]]
    if gaps:
        lines += ["", "## Gaps", "", *[f"- {g}" for g in gaps]]
    return "\n".join(lines) + "\n"


def write_artifacts(spark: SparkSession, folder: str, files: dict[str, str]) -> None:
    """Writes the files in name order to a folder of any file system that Spark knows, each by a rename."""
    fs, root = hadoop_path(spark, folder)
    fs.mkdirs(root)
    for name in sorted(files):
        staged, final = hadoop_path(spark, f"{folder}/.{name}.tmp")[1], hadoop_path(spark, f"{folder}/{name}")[1]
        out = fs.create(staged, True)
        try:
            out.write(bytearray(files[name].encode("utf-8")))
        finally:
            out.close()
        fs.delete(final, False)
        if not fs.rename(staged, final):
            raise RuntimeError(f"{name} could not be written")


def revalidated(text: str) -> dict:
    """A document's JSON text read again before it is published; raises if it isn't an object, lacks its
    version, or has an operation without responses or an empty status."""
    document = json.loads(text)
    if not isinstance(document, dict) or not str(document.get("openapi", "")).startswith("3."):
        raise ValueError("not an OpenAPI 3 document")
    for path, item in (document.get("paths") or {}).items():
        for method, op in item.items():
            responses = op.get("responses")
            if not path.startswith("/") or not responses or any(not re.fullmatch(r"[1-5]\d\d|default", str(k)) for k in responses):
                raise ValueError(f"{method.upper()} {path} is not valid")
    return document
