"""Best representative of each duplicate group, field by field (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from factweave.functions.keys import normalize_operation_key, trim_space
from factweave.operators.candidates import SOURCE_PRIORITY, STATUS_PRIORITY, STATUS_RANK, candidate_priority

#: Texts that stand in for no value, in lower case.
STAND_INS = ["", "n/a", "na", "tbd", "unknown", "none", "null", "nil", "-", "–", "—", "?"]


def fills(c: Column, kind: DataType) -> Column:
    """Whether a value says something: not null, blank or a stand-in; for arrays, some element does."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(c, lambda x: fills(x, kind.elementType)), F.lit(False))
    if isinstance(kind, StringType):
        return F.coalesce(~F.lower(trim_space(c)).isin(STAND_INS), F.lit(False))
    return c.isNotNull()


def survivors(rows: DataFrame, group: list[str], fields: dict[str, Column], priority: Column, recency: str, identity: str) -> DataFrame:
    """One row per group: for each field the best (value, identity) or null, in column ``f_<field>``.

    ``fields`` are null where a row does not fill them. A single aggregation takes, per field, the maximum
    of (filled, priority, recency, lowest identity, value), with map-side combine, so that a group of any
    size is one row per task. Null recency comes last. Groups of one identity (repeated rows count once) are
    left out. ``group`` values may be null. Fields nobody fills are null.
    """
    best = []
    for name, c in fields.items():
        pick = F.struct(F.col("__p").alias("p"), F.col(recency).alias("t"), (-F.col(identity)).alias("i"), F.col(f"__v_{name}").alias("v"))
        best.append(F.max(F.when(F.col(f"__v_{name}").isNotNull(), pick)).alias(f"f_{name}"))
    ranked = rows.select("*", priority.alias("__p"), *[c.alias(f"__v_{name}") for name, c in fields.items()])
    grouped = ranked.groupBy(*group).agg(F.min(identity).alias("__lo"), F.max(identity).alias("__hi"), *best)
    return grouped.where("__lo <> __hi").drop("__lo", "__hi")


def slot_survivors(candidates: DataFrame) -> DataFrame:
    """``repo, op_key, slot_kind, slot_key, field_name, cand_id, value``: the surviving fields of each
    slot that two or more candidates describe; ``value`` is text (arrays as JSON).

    Only the struct of a row's slot kind is read. An unknown slot kind has no fields. A group has one kind,
    so the n-th fields of the three structs share a column of the one aggregation, as text.
    """
    named: dict[str, list[str]] = {}
    values: dict[str, list[Column]] = {}
    for slot in ("param", "body", "response"):
        struct = candidates.schema[slot].dataType
        assert isinstance(struct, StructType)
        named[slot] = [f.name for f in struct.fields]
        held = [(F.col(slot)[f.name], f.dataType) for f in struct.fields]
        values[slot] = [F.when(fills(c, kind), F.to_json(c) if isinstance(kind, ArrayType) else c.cast("string")) for c, kind in held]
    width = max(map(len, named.values()))
    of_kind = lambda pick: F.coalesce(*[F.when(F.col("slot_kind") == slot, pick(slot)) for slot in named])
    nth = lambda slot, k: values[slot][k] if k < len(values[slot]) else F.lit(None).cast("string")
    fields = {str(k): of_kind(lambda slot, k=k: nth(slot, k)) for k in range(width)}
    rows = candidates.select(
        "repo",
        normalize_operation_key(F.col("op_key"), templates=True).alias("op_key"),
        "slot_kind",
        F.lower(trim_space(F.col("slot_key"))).alias("slot_key"),
        "cand_id",
        "param",
        "body",
        "response",
        "evidence",
        "confidence",
        "status",
        "recorded_at",
    )
    best = survivors(rows, ["repo", "op_key", "slot_kind", "slot_key"], fields, candidate_priority(F.col("evidence"), F.col("status"), F.col("confidence")), "recorded_at", "cand_id")
    names = of_kind(lambda slot: F.array(*[F.lit(n) for n in named[slot]]))
    long = F.array(*[F.struct(F.get(names, F.lit(k)).alias("field_name"), (-F.col(f"f_{k}.i")).alias("cand_id"), F.col(f"f_{k}.v").alias("value")) for k in range(width)])
    picked = best.select("repo", "op_key", "slot_kind", "slot_key", F.explode(F.filter(long, lambda x: x["cand_id"].isNotNull())).alias("x"))
    return picked.select("repo", "op_key", "slot_kind", "slot_key", "x.field_name", "x.cand_id", "x.value")


def slot_survivors_sql() -> str:
    """The DuckDB twin of ``slot_survivors`` without ``value``."""
    listed = {
        "param": ["name", "param_in", "required", "schema", "type", "format", "items", "enum", "description", "origin"],
        "body": ["content_type", "schema", "envelope", "data_field", "required"],
        "response": ["status", "description", "content_type", "schema", "envelope", "data_field", "map_value_type", "scalar_type", "code", "code_known", "has_body", "raw", "failure", "sink", "err_source"],
    }
    other = {"required", "code", "code_known", "has_body", "raw", "failure"}
    stand_ins = ", ".join(f"'{x}'" for x in STAND_INS)
    case = lambda values, c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"
    parts = []
    for slot, names in listed.items():
        for n in names:
            c = f'{slot}."{n}"'
            said = f"lower(trim({c})) NOT IN ({stand_ins})" if n not in other | {"enum"} else f"{c} IS NOT NULL" if n in other else f"len(list_filter({c}, lambda x: lower(trim(x)) NOT IN ({stand_ins}))) > 0"
            parts.append(f"SELECT repo, op, slot_kind, slot, '{n}' AS field_name, cand_id, prio, recorded_at FROM c WHERE slot_kind = '{slot}' AND coalesce({said}, false)")
    return rf"""WITH k AS (SELECT *, regexp_replace(op_key, '^\s+|\s+$', '', 'g') AS k0, lower(trim(status)) AS st,
  (SELECT max({case(SOURCE_PRIORITY, "lower(trim(e.source))")}) FROM (SELECT unnest(evidence) AS e)) AS src FROM candidates),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(k0, '^\S*\s*(.*)$', 1), ':([^/]*)', '{{\1}}', 'g'), '(^|/)\*([A-Za-z0-9_][^/]*)', '\1{{\2}}', 'g') AS p0 FROM k),
r AS (SELECT *, replace(CASE WHEN starts_with(p0, '/') THEN p0 ELSE '/' || p0 END, '//', '/') AS p1 FROM p),
c AS (SELECT repo, upper(regexp_extract(k0, '^(\S*)', 1)) || ' ' || CASE WHEN p0 = '' THEN '' WHEN length(p1) > 1 THEN regexp_replace(p1, '/+$', '') ELSE p1 END AS op,
  slot_kind, lower(trim(slot_key)) AS slot, cand_id, param, body, response, recorded_at,
  (CASE WHEN coalesce(src, 0) > 0 THEN src ELSE {case(STATUS_PRIORITY, "st")} END) * 10.0::DOUBLE + {case(STATUS_RANK, "st")} + coalesce(confidence, 0) AS prio FROM r),
g AS (SELECT repo, op, slot_kind, slot FROM c GROUP BY ALL HAVING count(DISTINCT cand_id) > 1),
f AS ({" UNION ALL ".join(parts)}),
b AS (SELECT *, row_number() OVER (PARTITION BY repo, op, slot_kind, slot, field_name ORDER BY prio DESC, recorded_at DESC NULLS LAST, cand_id) AS n FROM f)
SELECT b.repo, b.op AS op_key, b.slot_kind, b.slot AS slot_key, field_name, cand_id FROM b JOIN g
 ON b.repo IS NOT DISTINCT FROM g.repo AND b.op IS NOT DISTINCT FROM g.op AND b.slot_kind = g.slot_kind AND b.slot IS NOT DISTINCT FROM g.slot WHERE n = 1"""
