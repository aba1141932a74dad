"""Reachability, fixpoints and expansions over edge tables.

Each loop checkpoints its small frontier state to the shared folder, so that lineage stays short and a
lost executor costs one hop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.tables import cut_lineage

REACH, TEXT_REACH, BINDER_ROUNDS = 12, 4, 8
#: What a route for all methods stands for.
ALL_METHODS = ["GET", "PUT", "POST", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE"]


def forward_reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = REACH, source: str = "caller", target: str = "callee", node: str = "node") -> DataFrame:
    """H1-H4: ``node, depth``: all nodes reached from the seeds, with their least depth (seeds 0).

    Cycles and self-loops end by the anti-join with what is known; ``max_depth`` None means no cap.
    Several seeds share one run. Edges are projected to distinct pairs once, hashed by their source;
    a node of high degree is no problem, for the frontier is distinct before it is joined.
    """
    pairs = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).where("__s IS NOT NULL AND __t IS NOT NULL AND __s <> __t").distinct()
    pairs = cut_lineage(pairs)
    known = frontier = cut_lineage(seeds.select(F.col(node).alias("__n")).where("__n IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(pairs, F.col("__n") == F.col("__s")).select(F.col("__t").alias("__n")).distinct()
        frontier = cut_lineage(step.join(known.select("__n"), "__n", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.select(F.col("__n").alias(node), "depth")


def closure_filter(rows: DataFrame, edges: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """H3: rows whose key is in the closure of the seeds; all rows if there are no seeds."""
    if seeds.isEmpty():
        return rows
    reach = forward_reach(edges, seeds, None)
    return rows.join(reach.select(F.col("node").alias(key)), key, "left_semi")


def trace_sinks(edges: DataFrame, seeds: DataFrame, sinks: DataFrame, max_depth: int = REACH) -> DataFrame:
    """Call edges from reached functions to sinks, without those whose caller is a sink itself."""
    reach = forward_reach(edges, seeds, max_depth)
    hit = edges.join(reach.select(F.col("node").alias("caller"), "depth"), "caller").join(sinks.select(F.col("symbol").alias("callee")).distinct(), "callee", "left_semi")
    return hit.join(sinks.select(F.col("symbol").alias("caller")).distinct(), "caller", "left_anti")


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = BINDER_ROUNDS) -> DataFrame:
    """Unites a state of distinct rows with what ``step`` derives, until nothing is new or the
    rounds are used up. ``step`` gets all rows and returns rows of the same columns."""
    state = cut_lineage(state.distinct())
    for _ in range(max_rounds):
        fresh = cut_lineage(step(state).select(*state.columns).distinct().join(state, state.columns, "left_anti"))
        if fresh.isEmpty():
            break
        state = state.unionByName(fresh)
    return state


def propagate_labels(edges: DataFrame, labels: DataFrame, max_depth: int = 8) -> DataFrame:
    """``node, label``: labels flow against def-use edges (``use`` takes what ``def`` has), up to
    ``max_depth`` edges; the sentinels nil, opaque, uncoded and dynamic are labels like others."""
    pairs = edges.select(F.col("use").alias("__u"), F.col("def").alias("__d")).distinct()

    def step(state: DataFrame) -> DataFrame:
        return state.join(pairs, F.col("node") == F.col("__d")).select(F.col("__u").alias("node"), "label")

    return fixpoint(labels.select("node", "label"), step, max_depth)


def two_pass(first: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two ordered passes without a convergence test: what the first derives, the second sees."""
    once = first.unionByName(derive(first)).distinct()
    return once.unionByName(derive(once)).distinct()


def closed_union(rows: DataFrame, group: str, name: str, least: int = 2, most: int = 8) -> DataFrame:
    """``group, alternatives``: sorted names of groups with 2 to 8 different ones, else no row."""
    distinct = rows.select(group, name).where(F.col(name).isNotNull()).distinct()
    sized = distinct.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n").between(least, most)).select(group)
    return distinct.join(sized, group, "left_semi").groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("alternatives"))


def fan_out_methods(routes: DataFrame) -> DataFrame:
    """ALL becomes eight methods and an unsupported CONNECT; other routes stay."""
    every = F.array(*[F.struct(F.lit(m).alias("method"), F.lit("").alias("unresolved")) for m in ALL_METHODS], F.struct(F.lit("CONNECT").alias("method"), F.lit("unsupported method").alias("unresolved")))
    single = F.array(F.struct(F.upper("method").alias("method"), F.lit("").alias("unresolved")))
    return routes.withColumn("__m", F.explode(F.when(F.upper("method").isin("ALL", "ANY"), every).otherwise(single))).withColumn("method", F.col("__m.method")).withColumn("unresolved", F.col("__m.unresolved")).drop("__m")


def expand_wildcards(routes: DataFrame, rules: DataFrame) -> DataFrame:
    """``raw_path, path``: a wildcard path by its rule, else by the only version other routes show in
    its place (``/v*/x`` -> ``/v1/x``), else as ``{wildcard}``; paths without a wildcard stay."""
    wild = routes.where(F.contains("path", F.lit("*"))).select(F.col("path").alias("raw_path")).distinct()
    plain = routes.where(~F.contains("path", F.lit("*"))).select("path").distinct()
    prefix = F.regexp_extract("raw_path", r"^([^*]*)\*", 1)
    heads = wild.withColumn("__head", F.regexp_extract(F.regexp_extract("raw_path", r"^([^*]*)\*", 1), r"^(.*/)[^/]*$", 1))
    shown = plain.select(F.regexp_extract("path", r"^(.*?/)(v\d+)(?:/|$)", 1).alias("__head"), F.regexp_extract("path", r"^(.*?/)(v\d+)(?:/|$)", 2).alias("__v")).where("__v <> ''").groupBy("__head").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).where("lo = hi").select("__head", F.col("lo").alias("__version"))
    ruled = rules.select(F.col("pattern").alias("raw_path"), F.col("expansions"))
    j = heads.join(shown, "__head", "left").join(ruled, "raw_path", "left")
    inferred = F.when(F.endswith(prefix, F.lit("/v")) & F.col("__version").isNotNull(), F.array(F.regexp_replace("raw_path", F.lit(r"v\*"), F.col("__version"))))
    template = F.array(F.replace("raw_path", F.lit("*"), F.lit("{wildcard}")))
    return j.select("raw_path", F.explode(F.coalesce("expansions", inferred, template)).alias("path")).unionByName(plain.select(F.col("path").alias("raw_path"), "path"))


def alternatives(rows: DataFrame, column: str) -> DataFrame:
    """One row per alternative; rows without alternatives stay once."""
    return rows.withColumn(column, F.explode_outer(column))


def unresolved_label(label: Column) -> Column:
    """Codes of the sentinels: unresolved -1, uncoded -2, dynamic -3; others as numbers."""
    return F.when(label == "opaque", -1).when(label == "uncoded", -2).when(label == "dynamic", -3).otherwise(label.try_cast("int"))
