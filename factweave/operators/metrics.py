"""Accuracy metrics and the set operations below them.

Sets are rows ``key..., value``; all counts come from joins and aggregations, one row per operation at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """G1: distinct rows of ``a`` that ``b`` lacks; null equals null."""
    return a.select(*columns).subtract(b.select(*columns))


def list_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of ``a`` whose value ``b`` lacks, with duplicates; null values stay."""
    return a.join(b.select(column).distinct(), column, "left_anti")


def intersection_count(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row ``n``: rows of ``a``, duplicates counted, whose value is in ``b``."""
    return intersection_rows(a, b, [column]).agg(F.count("*").alias("n"))


def set_counts(spec: DataFrame, truth: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per group ``tp, fp, fn`` on distinct sets."""
    s = spec.select(*group, value).distinct().withColumn("__s", F.lit(True))
    t = truth.select(*group, value).distinct().withColumn("__t", F.lit(True))
    j = s.join(t, [*group, value], "full_outer")
    both = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    return j.groupBy(*group).agg(F.count_if(both).alias("tp"), F.count_if(F.col("__t").isNull()).alias("fp"), F.count_if(F.col("__s").isNull()).alias("fn"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """M9: precision 1 if nothing was generated, recall 1 if nothing was to be found, F1 0 if both are 0."""
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / F.nullif(tp + fp, F.lit(0)))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / F.nullif(tp + fn, F.lit(0)))
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def micro_average(counts: DataFrame) -> DataFrame:
    """One row ``tp, fp, fn, precision, recall, f1`` over all groups."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def route_metrics(spec: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M1, M2: one row ``hits, truth, generated, recall, precision``: recall 1 if the truth is empty,
    precision 0 if nothing was generated."""
    s = spec.select(*keys).distinct().withColumn("__s", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    n = s.join(t, list(keys), "full_outer").agg(F.count_if(F.col("__s").isNotNull() & F.col("__t").isNotNull()).alias("hits"), F.count("__t").alias("truth"), F.count("__s").alias("generated"))
    return n.select("hits", "truth", "generated", F.when(F.col("truth") == 0, 1.0).otherwise(F.col("hits") / F.nullif("truth", F.lit(0))).alias("recall"), F.when(F.col("generated") == 0, 0.0).otherwise(F.col("hits") / F.nullif("generated", F.lit(0))).alias("precision"))


def tolerate_open_objects(spec: DataFrame, truth: DataFrame, opened: DataFrame, group: Sequence[str], path: str, value: str) -> DataFrame:
    """Generated fields without those below an open object of the truth that it does not declare.

    A field's ancestors (before each ``.`` and ``[]``; the empty path is that of all) are listed and joined
    by equality, so the prefix predicate needs no theta join. Declared fields stay, whatever type they have.
    """
    steps = F.split(F.replace(path, F.lit("[]"), F.lit(".[]")), r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.replace(F.array_join(F.slice(steps, 1, i - 1), "."), F.lit(".[]"), F.lit("[]")))
    listed = spec.select(*group, value, path, F.explode(F.array_distinct(ancestors)).alias("__prefix"))
    below = listed.join(opened.select(*group, F.col("prefix").alias("__prefix")).distinct(), [*group, "__prefix"], "left_semi").select(*group, value, path).distinct()
    undeclared = below.join(truth.select(*group, path).distinct(), [*group, path], "left_anti")
    return spec.join(undeclared, [*group, value, path], "left_anti")


def parameter_quad(where: Column, name: Column, required: Column, type_: Column) -> Column:
    """``in|name|required|type``; an unset flag is false, an unset type ``?``, other unset parts empty."""
    return F.concat_ws("|", F.coalesce(where, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(required, F.lit(False)).cast("string"), F.coalesce(type_, F.lit("?")))


def envelope_codes(status: Column, enum: Column, description: Column) -> Column:
    """``status:code`` of a response, sorted: the values of the code's enum; without any, each ``code=N`` of the
    description, and 0 for a status of 200 whose description has no ``code`` at all."""
    text = F.coalesce(description, F.lit(""))
    told = F.filter(F.regexp_extract_all(text, F.lit(r"code=([^ :);,]*)"), F.lit(1)), lambda x: x != "")
    silent = F.when((status == "200") & ~F.contains(text, F.lit("code")), F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))
    values = F.when(F.size(F.coalesce(enum, F.array().cast("array<string>"))) > 0, enum.cast("array<string>")).otherwise(F.concat(told, silent))
    return F.array_sort(F.transform(values, lambda x: F.concat(status, F.lit(":"), x)))


def envelope_counts(spec: DataFrame, truth: DataFrame, group: Sequence[str], pair: str) -> DataFrame:
    """M7: one row ``tp, fn``: generated pairs that the truth has, and true ones that were not generated; pairs
    that a side repeats count each time."""
    on = [*group, pair]
    hit = intersection_rows(spec, truth, on).agg(F.count("*").alias("tp"))
    return hit.crossJoin(truth.join(spec.select(*on).distinct(), on, "left_anti").agg(F.count("*").alias("fn")))  # one row each


def intersection_rows(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a``, repeated ones as often, that ``b`` has."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi")


#: Kinds of values that are compared; ``shape`` is a response field without its requiredness.
COMPARED = ("param", "request", "response", "shape")


def with_shapes(facts: DataFrame) -> DataFrame:
    """Facts and, for each response field, its shape."""
    shape = facts.where("kind = 'response'").select("op_key", F.lit("shape").alias("kind"), F.regexp_replace("value", r"\|[^|]*$", "").alias("value"))
    return facts.select("op_key", "kind", "value").unionByName(shape)


def matched_facts(spec: DataFrame, truth: DataFrame) -> DataFrame:
    """``op_key, kind, value, in_spec, in_truth``: the different facts of operations that both sides have.

    Facts are rows ``op_key, kind, value``; ``kind`` is ``route`` (one row per operation, no value), ``envelope``
    or one of ``COMPARED``. One join of sets over all kinds.
    """
    both = spec.where("kind = 'route'").select("op_key").distinct().join(truth.where("kind = 'route'").select("op_key").distinct(), "op_key", "left_semi")
    side = lambda facts, name: with_shapes(facts).where(F.col("kind") != "route").distinct().withColumn(name, F.lit(True))
    j = side(spec, "in_spec").join(side(truth, "in_truth"), ["op_key", "kind", "value"], "full_outer").join(both, "op_key", "left_semi")
    return j.select("op_key", "kind", "value", F.col("in_spec").isNotNull().alias("in_spec"), F.col("in_truth").isNotNull().alias("in_truth"))


def evaluate(spec: DataFrame, truth: DataFrame) -> DataFrame:
    """M1-M9: one row with all metrics of facts (see ``matched_facts``); generated fields below open objects
    are left out before (``tolerate_open_objects``).

    Operations of one side only count for the routes. ``hallucination`` is spurious response fields over
    all true request and response fields, 0 without any, as the original counts it; it may exceed 1.
    """
    routes = route_metrics(spec.where("kind = 'route'"), truth.where("kind = 'route'"), ["op_key"]).select(F.col("recall").alias("route_recall"), F.col("precision").alias("route_precision"))
    compared = matched_facts(spec, truth)
    counts = {}
    for k in COMPARED:
        here = F.col("kind") == k
        counts |= {f"{k}_tp": F.count_if(here & F.col("in_spec") & F.col("in_truth")), f"{k}_fp": F.count_if(here & ~F.col("in_truth")), f"{k}_fn": F.count_if(here & ~F.col("in_spec"))}
    n = compared.agg(*[c.alias(name) for name, c in counts.items()])
    both = compared.select("op_key").distinct()
    pairs = lambda facts: facts.where("kind = 'envelope'").join(both, "op_key", "left_semi")
    envelopes = envelope_counts(pairs(spec), pairs(truth), ["op_key"], "value")
    columns = ["route_recall", "route_precision"]
    out = routes.crossJoin(n).crossJoin(envelopes)  # one row each
    for k in COMPARED:
        for name, c in zip(("precision", "recall", "f1"), precision_recall_f1(*[F.col(f"{k}_{x}") for x in ("tp", "fp", "fn")]), strict=True):
            out = out.withColumn(f"{k}_{name}", c)
            columns.append(f"{k}_{name}")
    true_fields = F.col("request_tp") + F.col("request_fn") + F.col("response_tp") + F.col("response_fn")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))
    out = out.withColumn("envelope_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("hallucination", ratio(F.col("response_fp"), true_fields))
    return out.select(*columns, "envelope_recall", "hallucination")


def differences(spec: DataFrame, truth: DataFrame) -> DataFrame:
    """``section, entry`` of what is missing or spurious: routes, and facts of operations of both sides as
    ``METHOD /path: value``. Shapes have no section, spurious envelope codes neither."""
    route = lambda facts: facts.where("kind = 'route'").select(F.col("op_key").alias("entry")).distinct()
    section = lambda rows, name: rows.select(F.lit(name).alias("section"), "entry")
    facts = matched_facts(spec, truth).where("kind <> 'shape' AND NOT (in_spec AND in_truth)")
    named = F.concat(F.when(F.col("in_truth"), "missing ").otherwise("spurious "), F.col("kind"))
    rows = facts.where("in_truth OR kind <> 'envelope'").select(named.alias("section"), F.concat("op_key", F.lit(": "), "value").alias("entry"))
    return section(set_difference(route(truth), route(spec), ["entry"]), "missing route").unionByName(section(set_difference(route(spec), route(truth), ["entry"]), "extra route")).unionByName(rows)


#: Lines of the report, by metric.
REPORT = {"Route recall": "route_recall", "Route precision": "route_precision", "Parameter F1": "param_f1", "Request field F1": "request_f1", "Response field F1": "response_f1", "Response shape F1": "shape_f1", "Envelope recall": "envelope_recall", "Hallucination": "hallucination"}


def report_text(metrics: DataFrame, found: DataFrame, entries: int | None = None) -> DataFrame:
    """One row ``report``: the metrics with three digits, then each section's number and, as far as
    ``entries`` says (None: all), its sorted entries. ``metrics`` is the row of ``evaluate``; the report is what the
    driver's reader must hold."""
    head = F.concat_ws("\n", *[F.format_string("%-18s: %.3f", F.lit(k), F.bround(c, 3)) for k, c in REPORT.items()])
    listed = F.array_sort(F.collect_list(F.concat(F.lit("  - "), "entry")))
    shown = listed if entries is None else F.slice(listed, 1, entries)
    parts = found.groupBy("section").agg(F.concat(F.initcap("section"), F.lit(" ("), F.count("*").cast("string"), F.lit("):\n"), F.array_join(shown, "\n")).alias("part"))
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    return metrics.select(head.alias("head")).crossJoin(body).select(F.concat_ws("\n\n", "head", F.when(F.col("body") != "", F.col("body"))).alias("report"))  # one row each


def envelope_recall(spec: DataFrame, truth: DataFrame, group: Sequence[str]) -> DataFrame:
    """M7: recall of ``(status:code)`` pairs; 0 if the truth has none."""
    c = envelope_counts(spec, truth, group, "pair")
    return c.select(F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("envelope_recall"))


def hallucination(response_counts: DataFrame, request_truth: int, response_truth: int) -> DataFrame:
    """M8: spurious response fields over all true request and response fields; may exceed 1; 0 if there
    are none. As the code has it, not as its comment says."""
    total = request_truth + response_truth
    return response_counts.agg((F.coalesce(F.sum("fp"), F.lit(0)) / F.lit(total) if total else F.lit(0.0)).alias("hallucination"))
