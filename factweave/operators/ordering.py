"""Window, ranking, packing and naming computations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions.keys import last_segment, short_hash

PACK_CAPACITY, PACK_TRUNCATE = 24_000, 6_000


def running_total(rows: DataFrame, order: Sequence[str], amount: Column, name: str = "running", buckets: int = 0) -> DataFrame:
    """A global running sum without a global window.

    Rows are range-partitioned by ``order`` and sorted; each partition's total comes from one small
    aggregation (one row per partition), and a row's sum is its partition's offset plus the sum within.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from factweave.tables import cut_lineage

    parted = cut_lineage(rows.withColumn("__a", amount).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    totals = parted.groupBy("__p").agg(F.sum("__a").alias("__t"))
    before = totals.withColumn("__off", F.coalesce(F.sum("__t").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__off")  # n rows
    within = F.sum("__a").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return parted.withColumn("__w", within).join(F.broadcast(before), "__p").withColumn(name, F.col("__off") + F.col("__w")).drop("__a", "__p", "__w", "__off")


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The place of each row in its group by ``order``, from 1; ``group`` and ``order`` together are total.

    A group of any size is numbered by many tasks: a running count over all groups, less the count before
    the group. Null groups are one.
    """
    counted = running_total(rows, [*group, *order], F.lit(1).cast("long"), "__c")
    start = counted.groupBy(*group).agg(F.min("__c").alias("__s")).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__s")
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & counted[g].eqNullSafe(start[f"__g{i}"])
    return counted.join(start, same).withColumn(name, F.col("__c") - F.col("__s") + 1).select(*rows.columns, name)


def select_within_budget(rows: DataFrame, free: Column, order: Sequence[str], budget: int) -> DataFrame:
    """Free rows all, paid rows in order until the budget is used; 0 means no limit. ``order``
    must be total."""
    if budget == 0:
        return rows
    paid = running_total(rows.withColumn("__free", free), order, F.when(free, 0).otherwise(1).cast("long"), "__cum")
    return paid.where(F.col("__free") | (F.col("__cum") <= budget)).drop("__free", "__cum")


def _fold(capacity: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by group and key: those taken (``last``), or those that can be taken at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started, used = None, False, 0
        sums: dict[int, int] = {}  # a binary indexed tree: sizes so far, by size
        for b in batches:
            keep = []
            for n, (g, size) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if not started or g != current:
                    current, started, used, sums = g, True, 0, {}
                if last:
                    if used + size <= capacity:
                        used += size
                        keep.append(n)
                    continue
                smaller, i = 0, size
                while i:
                    smaller += sums.get(i, 0)
                    i &= i - 1
                if smaller + size <= capacity:
                    keep.append(n)
                    i = size
                    while i <= capacity:
                        sums[i] = sums.get(i, 0) + size
                        i += i & -i
            yield b.take(pa.array(keep, pa.int64()))

    return run


def pack(rows: DataFrame, group: str, key: str, text: str, capacity: int = PACK_CAPACITY, truncate: int = PACK_TRUNCATE) -> DataFrame:
    """``group, key, size`` of the snippets that fit: each is cut to ``truncate`` bytes and taken, in order of
    ``key``, while the group's total stays within ``capacity``; one that doesn't fit is skipped and the next tried.

    Null and empty texts take no room and are all taken. Keys are unique and not null; a null group is one.

    Skipping makes this a fold over each group, but few rows reach it: when a snippet is taken, all earlier
    ones of its size or less were, for there was room for them; so one whose earlier ones of no greater size
    exceed the capacity together with it never is. Each task drops those among its own rows, without a
    shuffle, which leaves of a group of any size some hundreds per task; these are folded in a stream.
    """
    size = F.least(F.octet_length(F.coalesce(F.col(text), F.lit(""))), F.lit(truncate))
    sized = rows.select(group, key, size.alias("size"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields)
    some = sized.where("size > 0").sortWithinPartitions(group, key).mapInArrow(_fold(capacity, False), kind)
    taken = some.repartition(F.col(group)).sortWithinPartitions(group, key).mapInArrow(_fold(capacity, True), kind)
    return taken.unionByName(sized.where("size = 0"))


def component_names(schemas: DataFrame, type_id: str = "type_id") -> DataFrame:
    """``type_id, name``: the last segment, else ``package.last``, else ``last-hash``, in id order.

    A name is taken by the first id that asks for it. Ids sharing a last segment are the only ones
    that compete, so the rule is a rank per last segment: the first keeps ``last``; the first id of
    each other package gets ``package.last``; the rest get the hash form.
    """
    t = schemas.select(type_id).distinct().withColumn("last", last_segment(F.col(type_id))).withColumn("package", F.regexp_extract(type_id, r"([^/.]+)\.[^./]+$", 1))
    first = t.groupBy("last").agg(F.min(type_id).alias("__first"))
    of_package = t.join(first, "last").where(F.col(type_id) != F.col("__first")).groupBy("last", "package").agg(F.min(type_id).alias("__second"))
    j = t.join(first, "last").join(of_package, ["last", "package"], "left")
    name = F.when(F.col(type_id) == F.col("__first"), F.col("last")).when((F.col(type_id) == F.col("__second")) & (F.col("package") != ""), F.concat_ws(".", "package", "last")).otherwise(F.concat_ws("-", F.col("last"), short_hash(F.col(type_id))))
    return j.select(type_id, name.alias("name"))


def clipped_windows(sites: DataFrame, functions: DataFrame, reach: int = 20, limit: int = 8) -> DataFrame:
    """``func_id, line, first, last``: up to ``limit`` windows of ``reach`` lines around the sites of
    a function, clipped to its bounds, in line order."""
    j = sites.join(functions, "func_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    w = W.partitionBy("func_id").orderBy("line")
    return j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("func_id", "line", F.greatest(F.col("line") - reach, F.col("start_line")).alias("first"), F.least(F.col("line") + reach, F.col("end_line")).alias("last"))


def blocks(hits: DataFrame, group: Sequence[str], order: Sequence[str], size: int = 80) -> DataFrame:
    """Hits numbered into blocks of ``size`` per group."""
    return numbered(hits, group, order, "__n").withColumn("block", F.floor((F.col("__n") - 1) / size)).drop("__n")


def constant_before(lines: DataFrame, pattern: str) -> DataFrame:
    """Each line with the constant that the line right before it sets; null if none does."""
    w = W.partitionBy("file").orderBy("line_no")
    previous = F.when(F.lag("line_no").over(w) == F.col("line_no") - 1, F.regexp_extract(F.lag("text").over(w), pattern, 1))
    return lines.withColumn("constant", F.when(previous != "", previous))


def numbered_gaps(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``s0, s1, ...`` per group in order."""
    w = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn("gap_id", F.concat(F.lit("s"), (F.row_number().over(w) - 1).cast("string")))


def response_order(enveloped: Column, code: Column, failure: Column, sink: Column) -> Column:
    """sort key of response rows: enveloped first, then success, business, dynamic, uncoded and
    unresolved codes, the code, success before failure, the sink."""
    rank = F.when(code == 0, 0).when(code > 0, 1).when(code == -3, 2).when(code == -2, 3).otherwise(4)
    return F.struct((~enveloped).alias("e"), rank.alias("r"), code.alias("c"), failure.alias("f"), sink.alias("s"))


def gap_priority(gaps: Column) -> Column:
    """F8: 0 for missing responses, 1 for missing bodies or parameters, 2 for the rest."""
    starts = lambda p: F.coalesce(F.exists(gaps, lambda g: F.startswith(g, F.lit(p))), F.lit(False))
    return F.when(starts("response"), 0).when(starts("body") | starts("param"), 1).otherwise(2)


def top_slices(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 9) -> DataFrame:
    """the first ``n`` rows of each group by (priority, depth, id)."""
    w = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
