"""Validation rules and gates (L1-L22): each rule is one condition; those on the same rows share one pass.

``operations``: ``op_key, method, path, state, gaps``; ``candidates``: ``op_key, slot_kind, slot_key, seq,
location, schema_ref, status_code, value_json``; ``schemas``: ``schema_id, unknown``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.keys import operation_key, schema_ref
from factweave.functions.text import PARAM_LOCATIONS, template_names


def diagnostics(operations: DataFrame | None, candidates: DataFrame, schemas: DataFrame) -> DataFrame:
    """``code, message`` of everything that is wrong, sorted by both."""
    spark = candidates.sparkSession
    if operations is None:
        return spark.createDataFrame([("graph_missing", "graph is missing")], "code string, message string")
    key = F.col("op_key")
    first = candidates.groupBy("op_key", "slot_kind", "slot_key").agg(
        F.min_by(F.struct("location", "status_code"), "seq").alias("f"),
        F.count("*").alias("n"),
        (F.min(F.coalesce("value_json", F.lit("null"))) != F.max(F.coalesce("value_json", F.lit("null")))).alias("conflict"),
    )
    known = schemas.select(F.col("schema_id").alias("__id")).distinct()
    refs = candidates.where(F.coalesce("schema_ref", F.lit("")) != "").select("op_key", "slot_kind", "slot_key", schema_ref(F.col("schema_ref")).alias("__id")).distinct()
    templates = operations.select("op_key", F.explode(template_names(F.col("path"))).alias("slot_key")).distinct()
    given = candidates.where((F.col("slot_kind") == "param") & (F.lower("location") == "path")).select("op_key", "slot_key").distinct()
    status = F.col("slot_key").try_cast("int")

    def found(rows: DataFrame, *rules: tuple[str, Column, Sequence[str | Column]]) -> DataFrame:
        """Of each row a diagnostic per rule whose condition holds: one pass over the rows."""
        each = [F.when(condition, F.struct(F.lit(code).alias("code"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text]).alias("message"))) for code, condition, text in rules]
        return rows.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("x.*")

    is_ = lambda kind: F.col("slot_kind") == kind
    identified = key.eqNullSafe(operation_key(F.col("method"), F.col("path"))) & (F.coalesce("method", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != "")
    parameter, response = [key, " parameter ", F.col("slot_key")], [key, " status ", F.coalesce("slot_key", F.lit(""))]
    parts = [
        found(
            operations,
            ("operation_missing", key.isNull(), ["operation without a key"]),
            ("operation_identity", key.isNotNull() & ~identified, [key, " does not match its method and path"]),
            ("operation_conflict", F.col("state") == "conflict", [key, " has conflicting sources"]),
            ("operation_unresolved", (F.col("state") == "unresolved") | (F.size("gaps") > 0), [key, " is not resolved"]),
        ),
        found(
            first,
            ("parameter_location", is_("param") & ~F.coalesce(F.lower("f.location"), F.lit("")).isin(PARAM_LOCATIONS), parameter),
            ("parameter_conflict", is_("param") & (F.col("n") > 1) & F.col("conflict"), parameter),
            ("request_body_conflict", is_("body") & F.col("conflict"), [key, " request body"]),
            ("response_status", is_("response") & ~F.coalesce(status.between(100, 599), F.lit(False)), response),
            ("response_conflict", is_("response") & F.col("conflict"), response),
        ),
        found(refs.join(known, "__id", "left_anti"), ("schema_reference_missing", F.lit(True), [key, " ", F.col("slot_kind"), " ", F.col("__id")])),
        found(templates.join(given, ["op_key", "slot_key"], "left_anti"), ("path_parameter_missing", F.lit(True), parameter)),
        found(schemas, ("schema_unknown", F.coalesce("unknown", F.lit(False)), [F.col("schema_id"), " is unknown"])),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("message IS NOT NULL").orderBy("code", "message")


def gates(found: DataFrame, operations: DataFrame, fail_on_conflict: bool = False, fail_on_unresolved: bool = False, min_confidence: float = 0.0) -> DataFrame:
    """One row ``gate, failures`` per gate that fails."""
    words = lambda *xs: F.coalesce(F.regexp_like("code", F.lit("|".join(xs))), F.lit(False))
    d = found.agg(F.count_if(words("conflict")).alias("conflict"), F.count_if(words("unresolved", "unknown", "missing")).alias("unresolved"))
    o = operations.agg(F.count_if(F.col("confidence") < min_confidence).alias("low"))
    wanted = F.filter(
        F.array(
            F.struct(F.lit("conflict").alias("gate"), F.when(F.lit(fail_on_conflict), F.col("conflict")).otherwise(0).alias("failures")),
            F.struct(F.lit("unresolved").alias("gate"), F.when(F.lit(fail_on_unresolved), F.col("unresolved")).otherwise(0).alias("failures")),
            F.struct(F.lit("confidence").alias("gate"), F.col("low").alias("failures")),
        ),
        lambda x: x["failures"] > 0,
    )
    return d.crossJoin(o).select(F.explode(wanted).alias("g")).select("g.gate", "g.failures")  # one row each


def guard(facts: int, dropped: int, failed: int, routes: int, operations: int) -> None:
    """Raises if nothing was found but something was dropped, or routes gave no operations."""
    if not facts and (dropped or failed):
        raise ValueError(f"no facts, but {dropped} dropped and {failed} failed")
    if routes and not operations:
        raise ValueError(f"{routes} routes gave no operations")


def evaluation_failures(metrics: dict[str, float], fail_under: float | None = None, max_hallucination: float = 0.01) -> list[str]:
    """Names of the metrics below ``fail_under``, and ``hallucination`` if it is above its bound."""
    low = [k for k, v in metrics.items() if k != "hallucination" and fail_under is not None and v < fail_under]
    return sorted(low) + (["hallucination"] if metrics.get("hallucination", 0.0) > max_hallucination else [])


def mark_states(operations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Operations with a conflicting slot get the state ``conflict``."""
    bad = resolved.where("state = 'conflict'").select("op_key").distinct().withColumn("__c", F.lit(True))
    return operations.join(bad, "op_key", "left").withColumn("state", F.when(F.col("__c"), "conflict").otherwise(F.col("state"))).drop("__c")
