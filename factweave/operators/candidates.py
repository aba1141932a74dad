"""Candidates that several sources claim for one slot: priority, resolution, variants, merging.

The long form is ``op_key, slot_kind, slot_key, seq, value_json, confidence, status, evidence``: one row
per claim, its value as canonical JSON text, its evidence an array of structs with a ``source``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.keys import trim_space

#: Source priority, status priority where no source is known, status rank.
SOURCE_PRIORITY = {"source": 5, "runtime": 4, "openapi": 3, "documentation": 2, "human": 2, "llm": 1}
STATUS_PRIORITY = {"verified": 5, "observed": 4, "declared": 3, "inferred": 1}
STATUS_RANK = {"verified": 5, "declared": 4, "observed": 3, "inferred": 2, "inconclusive": 1, "unresolved": 0}
SLOT = ["op_key", "slot_kind", "slot_key"]


def rank(values: dict[str, int], c: Column) -> Column:
    """The rank of a word, whatever its case and surrounding blanks; 0 if it has none."""
    pairs = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, F.lower(trim_space(c))), F.lit(0))


def candidate_priority(evidence: Column, status: Column, confidence: Column) -> Column:
    """Source * 10 + status rank + confidence; the best source of the evidence, or by status if
    no source is known. Null evidence, status and confidence count as none, unlisted and 0."""
    best = F.coalesce(F.array_max(F.transform(evidence, lambda e: rank(SOURCE_PRIORITY, F.coalesce(e["source"], F.lit(""))))), F.lit(0))
    known = F.coalesce(status, F.lit(""))
    source = F.when(best > 0, best).otherwise(rank(STATUS_PRIORITY, known))
    return source * F.lit(10.0) + rank(STATUS_RANK, known) + F.coalesce(confidence, F.lit(0.0))


def canonical_json(c: Column) -> Column:
    """One spelling of a struct's JSON; equal values give equal text. Null fields are left out."""
    return F.to_json(c)


def resolve(candidates: DataFrame, slot: Sequence[str] = SLOT) -> DataFrame:
    """One row per slot with ``state, value_json, representative, confidence, candidates, different``.

    Equal values have a representative, told by its ``seq``: the one of highest priority (ties: first in
    candidate order), with the greatest confidence; the state is the status of the highest source and status.
    Different values are a conflict and have no winner: ``value_json`` and ``representative`` are null. A null value is a value of its own. One aggregation with map-side
    combine; the number of different values is told by their least and greatest, so no set of values
    is collected.
    """
    c = candidates.withColumn("__p", candidate_priority(F.col("evidence"), F.col("status"), F.col("confidence")))
    value = F.coalesce(F.col("value_json"), F.lit("null"))
    c = c.withColumn("__r", candidate_priority(F.col("evidence"), F.col("status"), F.lit(0.0)))
    first = F.max_by(F.struct("value_json", "seq"), F.struct("__p", (-F.col("seq")).alias("s")))
    g = c.groupBy(*slot).agg(
        F.min(value).alias("__lo"),
        F.max(value).alias("__hi"),
        first.alias("__b"),
        F.max_by("status", F.struct("__r", (-F.col("seq")).alias("s"))).alias("__st"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("candidates"),
    )
    conflict = F.col("__lo") != F.col("__hi")
    return g.select(
        *slot,
        F.when(conflict, "conflict").otherwise(F.coalesce(F.col("__st"), F.lit("unresolved"))).alias("state"),
        F.when(~conflict, F.col("__b.value_json")).alias("value_json"),
        F.when(~conflict, F.col("__b.seq")).alias("representative"),
        "confidence",
        "candidates",
        conflict.alias("different"),
    )


def mark_conflicts(candidates: DataFrame, slot: Sequence[str] = SLOT) -> DataFrame:
    """Every candidate kept, with status ``conflict`` where its slot has different values."""
    value = F.coalesce(F.col("value_json"), F.lit("null"))
    spread = candidates.groupBy(*slot).agg((F.min(value) != F.max(value)).alias("__conflict"))
    return candidates.join(spread, list(slot)).withColumn("status", F.when(F.col("__conflict"), F.lit("conflict")).otherwise(F.col("status"))).drop("__conflict")


def response_class(status: Column, code: Column, code_known: Column, failure: Column, raw: Column) -> Column:
    """D3: ``status|code|code_known|failure|raw``; unset flags are false, an unset code 0."""
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("string")
    return F.concat_ws("|", F.coalesce(status, F.lit("")), F.coalesce(code, F.lit(0)).cast("string"), flag(code_known), flag(failure), flag(raw))


def resolve_variants(candidates: DataFrame, variant: str, slot: Sequence[str] = SLOT) -> DataFrame:
    """Responses of several classes are no conflict. Resolved inside each class first; one
    conflicting class makes the whole slot a conflict, else each class keeps its representative.

    ``slot, state, variants, candidates``; a slot of one class has that class's state, of several
    ``verified``. Classes are pre-aggregated, so a hot slot shuffles one row per class.
    """
    per_class = resolve(candidates, [*slot, variant])
    g = per_class.groupBy(*slot).agg(F.bool_or("different").alias("__c"), F.count("*").alias("variants"), F.sum("candidates").alias("candidates"), F.max("state").alias("__s"))
    state = F.when(F.col("__c"), "conflict").when(F.col("variants") > 1, "verified").otherwise(F.col("__s"))
    return g.select(*slot, state.alias("state"), "variants", "candidates", F.col("__c").alias("different"))


def merge_graphs(*sources: DataFrame) -> DataFrame:
    """Candidates of all sources, those of a later source after those of an earlier one.

    ``seq`` becomes ``(source number, seq)`` in one number, so that first-wins rules stay defined.
    """
    merged = None
    for i, s in enumerate(sources):
        part = s.withColumn("seq", F.lit(i).cast("long") * F.lit(1 << 40) + F.coalesce(F.col("seq"), F.lit(0)).cast("long"))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no sources")
    return merged


def merge_operations(operations: DataFrame) -> DataFrame:
    """Scalars of one operation from several sources: state ``matched`` (``conflict`` if a source
    says so), least confidence with 0 as unset, first non-empty id, summary and description by ``seq``.

    The fold of the reference lets a later 0 win once; no importer gives 0, and here 0 never counts.
    """
    first = lambda c: F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq"))).alias(c)
    return operations.groupBy("op_key").agg(
        F.when(F.bool_or(F.col("state") == "conflict"), "conflict").when(F.count("*") > 1, "matched").otherwise(F.min("state")).alias("state"),
        F.coalesce(F.min(F.nullif(F.col("confidence"), F.lit(0.0))), F.lit(0.0)).alias("confidence"),
        first("operation_id"),
        first("summary"),
        first("description"),
        F.count("*").alias("sources"),
    )


def schema_collisions(schemas: DataFrame) -> DataFrame:
    """``name, source, json, new_name, collides``: of one name the first source keeps it; another
    source with other JSON gets ``source.name``. ``schemas`` has ``name, source, seq, json``."""
    kept = schemas.groupBy("name").agg(F.min_by("json", "seq").alias("__json"))
    collides = ~F.col("json").eqNullSafe(F.col("__json"))
    return schemas.join(kept, "name").select("name", "source", "json", F.when(collides, F.concat_ws(".", "source", "name")).otherwise(F.col("name")).alias("new_name"), collides.alias("collides"))


def collision_diagnostics(collisions: DataFrame) -> DataFrame:
    """``code, message`` of each schema that was renamed because its name was taken, each once."""
    text = F.concat(F.lit("schema "), "name", F.lit(" of "), "source", F.lit(" differs from another of that name and becomes "), "new_name")
    return collisions.where("collides").select(F.lit("schema_name_collision").alias("code"), text.alias("message")).distinct()


def rewrite_references(rows: DataFrame, collisions: DataFrame, reference: str, source: str = "source") -> DataFrame:
    """References of a source to a renamed schema follow it. Parameters keep theirs, as in the
    reference; apply this to bodies and responses only."""
    moved = collisions.where("collides").select(F.col("name").alias("__n"), F.col("source").alias("__s"), F.col("new_name").alias("__new")).distinct()
    joined = rows.join(moved, (F.substring_index(F.col(reference), "/", -1) == F.col("__n")) & (F.col(source) == F.col("__s")), "left")
    return joined.withColumn(reference, F.coalesce(F.col("__new"), F.col(reference))).drop("__n", "__s", "__new")


def graph_statistics(resolved: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row with the numbers of slots, operations, conflicts, and unknown schemas."""
    slots = resolved.agg(F.count("*").alias("slots"), F.count_distinct("op_key").alias("operations"), F.count_if(F.col("state") == "conflict").alias("conflicts"), F.count_if(F.col("state") == "unresolved").alias("unresolved"))
    if schemas is None:
        return slots.withColumn("unknown_schemas", F.lit(0).cast("long"))
    return slots.crossJoin(schemas.agg(F.count_if(F.col("unknown")).alias("unknown_schemas")))  # one row each


def group_responses(responses: DataFrame) -> DataFrame:
    """Per ``op_key, status``: first content type, sorted distinct known codes, distinct variants,
    descriptions in order of first mention, flags joined by or. ``responses`` has ``seq`` for order.

    Texts are made distinct per slot before their order is restored, so a hot status costs its
    different texts only.
    """
    described = responses.where(F.coalesce(F.col("description"), F.lit("")) != "").groupBy("op_key", "status", "description").agg(F.min("seq").alias("seq"))
    texts = described.groupBy("op_key", "status").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"])).alias("descriptions"))
    flags = responses.groupBy("op_key", "status").agg(
        F.min_by("content_type", F.when(F.coalesce(F.col("content_type"), F.lit("")) != "", F.col("seq"))).alias("content_type"),
        F.array_sort(F.collect_set(F.when(F.col("code_known"), F.col("code")))).alias("codes"),
        F.coalesce(F.bool_or("failure"), F.lit(False)).alias("failure"),
        F.coalesce(F.bool_or("raw"), F.lit(False)).alias("raw"),
        F.count("*").alias("candidates"),
    )
    return flags.join(texts, ["op_key", "status"], "left").withColumn("descriptions", F.coalesce("descriptions", F.lit("")))


def operation_confidence(operation: Column, least_parameter: Column) -> Column:
    """The least of the operation's confidence (0 counts as 1) and its parameters'."""
    return F.least(F.when(F.coalesce(operation, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(operation), least_parameter)


def recompute_confidence(old: Column, gaps: Column, cap: Column) -> Column:
    """Raised to the cap only when no gaps remain."""
    return F.when((F.size(gaps) == 0) & (old < cap), cap).otherwise(old)


def verification_cap(verification: Column) -> Column:
    """Typed 0.8, symbol 0.7, text 0.6, else 1."""
    return F.when(verification == "typed", 0.8).when(verification == "symbol", 0.7).when(verification == "text", 0.6).otherwise(1.0)


def stable_counts(rows: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """``k=v, k=v`` in order of the values, per group."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("k"), F.col("__n").alias("n"))))
    return counts.groupBy(*group).agg(F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string"))), ", ").alias("counts"))


def keys_on_every_path(flows: DataFrame, group: Sequence[str], path: str, key: str) -> DataFrame:
    """``group, key, required``: required if the key is present on each of the group's paths."""
    pairs = flows.select(*group, path, key).distinct()
    total = pairs.select(*group, path).distinct().groupBy(*group).agg(F.count("*").alias("__paths"))
    held = pairs.where(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count("*").alias("__held"))
    return held.join(total, list(group)).select(*group, key, (F.col("__held") == F.col("__paths")).alias("required"))


def unique_index(rows: DataFrame, name: str, type_: str) -> DataFrame:
    """Names with one type only."""
    return rows.groupBy(name).agg(F.min(type_).alias("__lo"), F.max(type_).alias("__hi")).where("__lo = __hi").select(name, F.col("__lo").alias(type_))


def enum_values(constants: DataFrame, type_: str, value: str) -> DataFrame:
    """Sorted distinct constants of types that have two or more of them."""
    return constants.select(type_, value).distinct().groupBy(type_).agg(F.array_sort(F.collect_list(value)).alias("values")).where(F.size("values") >= 2)


def response_matrix(hits: DataFrame) -> DataFrame:
    """Sink hits merged by type, code, failure and status, with their different sinks in order."""
    key = ["op_key", "type", "code", "failure", "status"]
    sinks = hits.select(*key, "sink").where("sink IS NOT NULL").distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("sink")), ", ").alias("sinks"))
    counts = hits.groupBy(*key).agg(F.count("*").alias("hits"))
    on = counts["op_key"].eqNullSafe(sinks["op_key"])
    for c in key[1:]:
        on = on & counts[c].eqNullSafe(sinks[c])
    return counts.join(sinks, on, "left").select(*[counts[c] for c in key], "hits", F.coalesce("sinks", F.lit("")).alias("sinks"))


def propagate_confidence(operations: DataFrame, schemas: DataFrame) -> DataFrame:
    """An operation's confidence is at most the least of its schemas', envelopes aside."""
    least = schemas.where(~F.coalesce("envelope", F.lit(False))).groupBy("op_key").agg(F.min("confidence").alias("__least"))
    return operations.join(least, "op_key", "left").withColumn("confidence", F.least("confidence", "__least")).drop("__least")


def operation_evidence(candidates: DataFrame) -> DataFrame:
    """``op_key, evidence``: the different evidence of all of an operation's candidates."""
    each = candidates.select("op_key", F.explode("evidence").alias("e")).distinct()
    return each.groupBy("op_key").agg(F.array_sort(F.collect_list("e")).alias("evidence"))


def usage_counters(entries: DataFrame) -> DataFrame:
    """One row ``answers, exhausted, usage_in, usage_out, reads``: sums over answers; null usage is 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return entries.agg(F.count("*").alias("answers"), F.count_if(F.col("exhausted")).alias("exhausted"), total("usage_in"), total("usage_out"), F.coalesce(F.sum(F.size(F.coalesce("reads", F.array()))), F.lit(0)).cast("long").alias("reads"))
