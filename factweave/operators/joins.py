"""Joins the reference realises with maps and loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphans(base: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Observed keys that the base lacks, each once, sorted."""
    return observed.select(key).where(F.col(key).isNotNull()).distinct().join(base.select(key), key, "left_anti").orderBy(key)


def graph_diff(left: DataFrame, right: DataFrame, key: str = "op_key", state: str = "state") -> DataFrame:
    """``key, kind, before, after, breaking``: added, removed and changed rows; removal breaks, and
    so does a change to conflict or unresolved. Keys are unique on each side; null states are equal."""
    a = left.select(key, F.col(state).alias("before"), F.lit(True).alias("__l"))
    b = right.select(key, F.col(state).alias("after"), F.lit(True).alias("__r"))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").otherwise("changed")
    out = j.where(F.col("__l").isNull() | F.col("__r").isNull() | ~F.col("before").eqNullSafe(F.col("after")))
    breaking = (kind == "removed") | (kind == "changed") & F.coalesce(F.col("after"), F.lit("")).isin("conflict", "unresolved")
    return out.select(key, kind.alias("kind"), "before", "after", breaking.alias("breaking"))


def document_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """C4: ``path, kind``: paths added, removed or with another value, of shredded ``path, value`` rows."""
    return graph_diff(left, right, "path", "value").select("path", F.when(F.col("kind") == "changed", "modified").otherwise(F.col("kind")).alias("kind"))


def lookup_code(references: DataFrame, codes: DataFrame) -> DataFrame:
    """``ref, code``: the code of the same symbol, else of the only symbol with that last segment."""
    last = lambda c: F.regexp_extract(c, r"([^./]+)$", 1)
    exact = codes.select(F.col("symbol").alias("ref"), F.col("code").alias("__exact")).dropDuplicates(["ref"])
    by_last = codes.select(last("symbol").alias("__last"), "symbol", "code").groupBy("__last").agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi"), F.min("code").alias("__single")).where("lo = hi").select("__last", "__single")
    return references.select("ref").withColumn("__last", last("ref")).join(exact, "ref", "left").join(by_last, "__last", "left").select("ref", F.coalesce("__exact", "__single").alias("code"))


def point_in_range(points: DataFrame, ranges: DataFrame, group: Sequence[str], point: str, start: str, end: str, pick: str, bin_size: int = 64) -> DataFrame:
    """Each point with the first range (by ``pick``) of its group that holds it.

    A binned join: a range is repeated once per bin it touches and a point belongs to one bin, so the
    join is an equi-join on (group, bin) with the exact bounds as a filter; no pairs of a whole group
    are formed. Points outside every range, null bounds and ranges that end before they start give no
    row. Choose ``bin_size`` near the usual length of a range.
    """
    binned = ranges.where(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    p = points.withColumn("__bin", F.floor(F.col(point) / bin_size))
    hit = p.join(binned, [*group, "__bin"]).where(F.col(point).between(F.col(start), F.col(end)))
    return hit.groupBy(*points.columns).agg(F.min(pick).alias(pick))


def semi_in_range(points: DataFrame, ranges: DataFrame, group: Sequence[str], point: str, start: str, end: str, bin_size: int = 64) -> DataFrame:
    """C11: points that lie in some range of their group, each row kept as it is."""
    binned = ranges.where(F.col(start) <= F.col(end)).select(*group, start, end).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    p = points.withColumn("__bin", F.floor(F.col(point) / bin_size))
    on = (p["__bin"] == binned["__bin"]) & p[point].between(binned[start], binned[end])
    for g in group:
        on = on & (p[g] == binned[g])
    return p.join(binned, on, "left_semi").drop("__bin")


def implementations(calls: DataFrame, implements: DataFrame) -> DataFrame:
    """C14: ``interface, implementation``: test doubles only where there is nothing else."""
    real = implements.groupBy("interface").agg(F.max(~F.col("is_double")).alias("__real"))
    j = implements.join(real, "interface").where(~F.col("__real") | ~F.col("is_double"))
    return calls.select("interface").distinct().join(j, "interface").select("interface", "implementation")


def replay_valid(reads: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``key, valid``: all of a row's reads still have their digest; true without reads.

    ``reads`` has ``key, reads array<struct<tool, args, digest>>``, ``current`` ``tool, args, digest``.
    """
    e = reads.select(key, F.explode_outer("reads").alias("r"))
    cur = current.select(F.col("tool").alias("__t"), F.col("args").alias("__a"), F.col("digest").alias("__d"))
    j = e.join(cur, (F.col("r.tool") == F.col("__t")) & (F.col("r.args") == F.col("__a")), "left")
    ok = F.col("r").isNull() | F.coalesce(F.col("r.digest") == F.col("__d"), F.lit(False))
    return j.groupBy(key).agg(F.bool_and(ok).alias("valid"))


def resolve_names(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """``file, name, def_file``: the definition in the same file, else the only one, else null."""
    same = definitions.select("file", "name").distinct().withColumn("__same", F.lit(True))
    single = definitions.groupBy("name").agg(F.min("file").alias("lo"), F.max("file").alias("hi")).where("lo = hi").select("name", F.col("lo").alias("__single"))
    j = uses.select("file", "name").distinct().join(same, ["file", "name"], "left").join(single, "name", "left")
    return j.select("file", "name", F.when(F.col("__same"), F.col("file")).otherwise(F.col("__single")).alias("def_file"))


def rename(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """The serialised name where there is one."""
    a = aliases.select(F.col("source_name").alias("__s"), F.col("serialised").alias("__to")).dropDuplicates(["__s"])
    return rows.join(a, F.col(column) == F.col("__s"), "left").withColumn(column, F.coalesce("__to", column)).drop("__s", "__to")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``, by aggregation instead of a sort of each group."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*order, *[F.col(c).alias(f"__{i}") for i, c in enumerate(others)])).alias("__b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.__{i}").alias(c) for i, c in enumerate(others)])


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` latest rows of each key; ties in ``order`` are broken by its later columns."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def attach_enrichment(operations: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Summary and description of ``fact_id:enrich`` rows where the operation has none."""
    e = enrichment.select(F.regexp_replace("fact_id", ":enrich$", "").alias("__id"), F.col("summary").alias("__s"), F.col("description").alias("__d")).dropDuplicates(["__id"])
    j = operations.join(e, F.col("fact_id") == F.col("__id"), "left")
    filled = lambda own, new: F.coalesce(F.when(F.col(own) != "", F.col(own)), F.col(new))
    return j.withColumn("summary", filled("summary", "__s")).withColumn("description", filled("description", "__d")).drop("__id", "__s", "__d")


def resolve_references(rows: DataFrame, schemas: DataFrame, reference: str) -> DataFrame:
    """Rows with ``unknown``: their reference names no schema. Rows without a reference are known."""
    known = schemas.select(F.col("schema_id").alias("__id")).distinct()
    last = F.substring_index(F.col(reference), "/", -1)
    return rows.join(known, last == F.col("__id"), "left").withColumn("unknown", (F.coalesce(F.col(reference), F.lit("")) != "") & F.col("__id").isNull()).drop("__id")


def catalog_subset(catalog: DataFrame, slices: DataFrame) -> DataFrame:
    """Catalog rows whose constant name is a token of some slice; slices are reduced to distinct
    tokens first, so no text is compared with every name."""
    tokens = slices.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("__t")).distinct()
    return catalog.join(tokens, F.regexp_extract("symbol", r"([^./]+)$", 1) == F.col("__t"), "left_semi")


def security_of(routes: DataFrame, mapping: DataFrame) -> DataFrame:
    """C17: ``op_key, schemes``: the security schemes of a route's middleware, each once, in its order."""
    m = routes.select("op_key", F.posexplode("middleware").alias("pos", "middleware"))
    first = m.join(mapping.select("middleware", "scheme").distinct(), "middleware").groupBy("op_key", "scheme").agg(F.min("pos").alias("pos"))
    return first.groupBy("op_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "scheme"))), lambda x: x["scheme"]).alias("schemes"))
