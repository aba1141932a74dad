"""Evidence gates, verification predicates, and text windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions.text import PARAM_LOCATIONS, SCALAR_TYPES, name_in_source, template_names, token_set
from factweave.tables import cut_lineage

#: Formats that proposals may use.
FORMATS = ["date-time", "date", "int64", "int32", "double", "float", "byte", "binary", "uuid"]
MAX_SHAPE_DEPTH = 4


def source_lines(files: DataFrame, path: str = "file", text: str = "text") -> DataFrame:
    """``file, line_no, text`` of every line, counted from 1 and split at ``\\n``."""
    return files.select(F.col(path).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of every file."""
    return lines.where(F.col("line_no").between(first, last))


def evidence_gate(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1, B2: facts with the evidence that still holds, and the ids of facts that lost all of it.

    Evidence holds if its file is known, its hash (if given) is the file's, and its line exists.
    ``facts``: ``fact_id, evidence array<struct<file, start_line, blob_sha>>``; ``files``: ``file,
    blob_sha, n_lines``. Facts without evidence are dropped and reported like those that lost it.
    """
    e = facts.select("fact_id", F.posexplode("evidence").alias("pos", "e"))
    current = files.select(F.col("file").alias("__f"), F.col("blob_sha").alias("__sha"), "n_lines")
    ok = (F.coalesce(F.col("e.file"), F.lit("")) != "") & ((F.coalesce(F.col("e.blob_sha"), F.lit("")) == "") | F.col("e.blob_sha").eqNullSafe(F.col("__sha"))) & F.col("e.start_line").between(1, F.col("n_lines"))
    held = e.join(current, F.col("e.file") == F.col("__f")).where(ok)
    kept = held.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("evidence"))
    valid = facts.drop("evidence").join(kept, "fact_id")
    return valid, facts.select("fact_id").join(kept.select("fact_id"), "fact_id", "left_anti")


def valid_proposal(where: Column, type_: Column, format_: Column, status: Column) -> Column:
    """Location, scalar type, format and status lie in the closed sets; null counts as absent, and so
    does an empty format."""
    format_ = F.nullif(format_, F.lit(""))
    return (where.isNull() | where.isin(PARAM_LOCATIONS)) & (type_.isNull() | type_.isin(SCALAR_TYPES)) & (format_.isNull() | format_.isin(FORMATS)) & (status.isNull() | status.between(100, 599))


def verified_shapes(nodes: DataFrame, tree: str = "tree_id") -> DataFrame:
    """Trees all of whose nodes are valid: ``named`` in source, type in the set, depth at most 4."""
    ok = F.col("named") & (F.col("type").isin([*SCALAR_TYPES, "object", "array"])) & (F.col("depth") <= MAX_SHAPE_DEPTH)
    return nodes.groupBy(tree).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).where("ok").select(tree)


def verified_enum(values: Column, tokens: Column) -> Column:
    """B12, hard part: every enum value occurs in the source; an empty enum passes."""
    return F.coalesce(F.forall(values, lambda v: F.array_contains(tokens, v)), F.lit(True))


def verified_bound(bound: Column, numbers: Column) -> Column:
    """B12, soft part: a bound that the source lacks is dropped."""
    return F.when(F.array_contains(numbers, bound), bound)


def prefiltered_files(lines: DataFrame, patterns: Sequence[str], limit: int = 200) -> DataFrame:
    """The first ``limit`` files (by name) with a line that matches all patterns."""
    match = F.lit(True)
    for p in patterns:
        match = match & F.col("text").rlike(p)
    return lines.where(match).select("file").distinct().orderBy("file").limit(limit)


def missed_lines(lines: DataFrame, hint: str, accepted: DataFrame) -> DataFrame:
    """Lines that match the hint and are not among the accepted ``(file, line_no)``."""
    return lines.where(F.col("text").rlike(hint)).join(accepted.select("file", "line_no").distinct(), ["file", "line_no"], "left_anti")


def line_windows(lines: DataFrame, reach: int = 2) -> DataFrame:
    """E5: each line with the text of the lines up to ``reach`` before and after, in order.

    The lag form sorts each file once and holds 2 * reach + 1 lines, not a whole file.
    """
    w = W.partitionBy("file").orderBy("line_no")
    around = [F.lag("text", k).over(w) for k in range(reach, 0, -1)] + [F.col("text")] + [F.lead("text", k).over(w) for k in range(1, reach + 1)]
    return lines.withColumn("window", F.concat_ws("\n", *around))


def verify_routes(routes: DataFrame, lines: DataFrame, methods: Sequence[str] = ("GET", "PUT", "POST", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE")) -> DataFrame:
    """Routes whose method is allowed and whose line exists, with a literal within two lines of it
    that is a suffix of the path; what is before it (mounts, groups) stands in literals of any lines.

    The handler's last name stands within the two lines; an inline or unnamed one needs no name.
    """
    w = line_windows(lines).select(F.col("file").alias("__f"), F.col("line_no").alias("__l"), "window").distinct()
    name = F.trim(F.coalesce("handler", F.lit("")))
    short = F.regexp_extract(name, r"([^.:]*)$", 1)
    named = (F.lower(name).isin("", "inline")) | name_in_source(short, F.col("window"), token_set(F.col("window")))
    j = routes.join(w, (F.col("file") == F.col("__f")) & (F.col("line") == F.col("__l")))
    # cut, for the optimizer loses the path when it infers filters of the lambda below the join
    j = cut_lineage(j.where(F.upper(F.trim("method")).isin(list(methods)) & F.startswith("path", F.lit("/")) & named))
    j = cut_lineage(j.withColumn("__lit", longest_suffix_literal(F.col("window"), F.col("path")))).where("__lit IS NOT NULL")
    j = j.withColumn("__prefix", F.expr("left(path, length(path) - length(__lit))"))
    alone = F.col("__prefix").isin("", "/")
    mounted = prefixes_in_literals(j.where(~alone).select(F.col("__prefix").alias("prefix")), lines)
    kept = j.where(alone).unionByName(j.where(~alone).join(mounted.withColumnRenamed("prefix", "__prefix"), "__prefix", "left_semi"))
    return kept.select(*routes.columns)


def string_literals(text: Column) -> Column:
    """The contents of the quoted literals of a text, in order."""
    quoted = F.regexp_extract_all(text, F.lit("\"[^\"]*\"|'[^']*'|`[^`]*`"), F.lit(0))
    return F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def longest_suffix_literal(window: Column, path: Column) -> Column:
    """The longest quoted literal that is a suffix of the path at a segment boundary; null if none."""
    boundary = lambda x: (x == path) | F.startswith(x, F.lit("/")) | F.endswith(path, F.concat(F.lit("/"), x))
    fit = F.filter(string_literals(window), lambda x: (x != "") & F.endswith(path, x) & boundary(x))
    return F.array_max(F.transform(fit, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def prefixes_in_literals(prefixes: DataFrame, lines: DataFrame) -> DataFrame:
    """The distinct ``prefix`` that are a row of literals starting with ``/``, each anywhere in the lines.

    Each round takes a literal off the end of what remains; a slash at the end of either is ignored.
    Remainders get shorter in every round, so that the loop ends.
    """
    literals = lines.select(F.explode(string_literals(F.col("text"))).alias("__lit")).select(F.regexp_replace("__lit", "/$", "").alias("__lit")).where(F.startswith("__lit", F.lit("/"))).distinct()
    literals = cut_lineage(literals)
    rest = cut_lineage(prefixes.where("prefix IS NOT NULL").distinct().withColumn("rest", F.col("prefix")))
    found = prefixes.sparkSession.createDataFrame([], "prefix string")
    while not rest.isEmpty():
        cut = rest.withColumn("rest", F.regexp_replace("rest", "/$", "")).where("rest <> ''").withColumn("__at", F.explode(F.expr("filter(sequence(1, length(rest)), i -> substring(rest, i, 1) = '/')")))
        cut = cut.withColumn("__lit", F.expr("substring(rest, __at)")).join(literals, "__lit", "left_semi")
        cut = cut_lineage(cut.select("prefix", F.expr("left(rest, __at - 1)").alias("rest")).distinct())
        found = found.unionByName(cut.where("rest = ''").select("prefix"))
        rest = cut.where("rest <> ''")
    return found.distinct()


def first_match(lines: DataFrame, keys: DataFrame, needle: str) -> DataFrame:
    """C20: per row of ``keys`` (with its ``file``) the first line of the file whose text has the needle as a
    whole token or in quotes (B9); keys that no line has give no row.

    Lines are taken apart into tokens and quoted literals, each with its first line, and looked up by
    equality; no file's keys are paired with its lines.
    """
    between = lambda q: F.slice(F.split("text", q), 2, F.greatest(F.size(F.split("text", q)) - 2, F.lit(0)))
    words = lines.select("file", "line_no", F.explode(F.array_distinct(F.concat(token_set(F.col("text")), between('"'), between("'")))).alias("__w")).where("__w <> ''")
    first = words.groupBy("file", "__w").agg(F.min("line_no").alias("line_no"))
    return keys.distinct().join(first.withColumnRenamed("__w", needle), ["file", needle]).select(*keys.columns, "line_no")


def first_rule(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """``symbol, rule``: the first rule that names a symbol exactly, or by package suffix and last
    segment. Rules are configuration; both ways are equi-joins on the last segment, no cross join."""
    last = lambda c: F.regexp_extract(c, r"([^./]+)$", 1)
    s = symbols.select("symbol", last("symbol").alias("__last"))
    r = rules.select("rule", "pos", F.col("pattern"), last("pattern").alias("__last"))
    hit = s.join(r, "__last").where((F.col("symbol") == F.col("pattern")) | F.endswith("symbol", F.concat(F.lit("/"), F.col("pattern"))))
    return hit.groupBy("symbol").agg(F.min_by("rule", "pos").alias("rule"))


def path_parameters(operations: DataFrame, parameters: DataFrame) -> DataFrame:
    """``op_key, name, state``: template names without a path parameter are ``added``, path
    parameters outside the template ``removed``, the others ``kept``."""
    wanted = operations.select("op_key", F.explode(template_names(F.col("path"))).alias("name")).distinct()
    given = parameters.where(F.col("location") == "path").join(operations.select("op_key"), "op_key").select("op_key", "name").distinct()
    both = wanted.withColumn("w", F.lit(True)).join(given.withColumn("g", F.lit(True)), ["op_key", "name"], "full_outer")
    return both.select("op_key", "name", F.when(F.col("g").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("kept").alias("state"))


def list_operations(operations: DataFrame, low_confidence: float | None = None, has_gaps: bool = False, conflicts: bool = False, state: str | None = None) -> DataFrame:
    """Optional filters over operations; without any, all."""
    if low_confidence is not None:
        operations = operations.where(F.col("confidence") < low_confidence)
    if has_gaps:
        operations = operations.where(F.size("gaps") > 0)
    if conflicts:
        operations = operations.where("state = 'conflict'")
    return operations.where(F.col("state") == state) if state else operations


def find_operation(operations: DataFrame, key: str, suggestions: int = 5) -> tuple[DataFrame, DataFrame]:
    """The operation of a key, and keys that end with its path, for when there is none."""
    path = key.split(" ", 1)[-1]
    return operations.where(F.col("op_key") == key), operations.where(F.endswith("op_key", F.lit(path)) & (F.col("op_key") != key)).orderBy("op_key").limit(suggestions).select("op_key")


def gap_rows(operations: DataFrame) -> DataFrame:
    """``METHOD /path: g1; g2`` of operations with gaps, sorted."""
    return operations.where(F.size("gaps") > 0).select(F.concat(F.col("op_key"), F.lit(": "), F.concat_ws("; ", "gaps")).alias("gap")).orderBy("gap")


def drop_gaps(gaps: Column, prefix: str) -> Column:
    """The gaps that do not start with the prefix."""
    return F.filter(gaps, lambda g: ~F.startswith(g, F.lit(prefix)))


def has_gap(gaps: Column, prefix: str) -> Column:
    """Whether a gap starts with the prefix."""
    return F.coalesce(F.exists(gaps, lambda g: F.startswith(g, F.lit(prefix))), F.lit(False))


def redacted(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Metadata only: columns outside ``keep`` (bodies, headers) are never selected."""
    return rows.select(*[c for c in keep if c in rows.columns])


def error_catalog(constants: DataFrame, package_suffix: str) -> DataFrame:
    """Constants of the packages that end with the suffix at a segment boundary."""
    return constants.where((F.col("kind") == "const") & ((F.col("package") == package_suffix) | F.endswith("package", F.lit(f"/{package_suffix}"))))


def accepted_findings(findings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings whose name occurs in the source of their operation and whose location, type, format
    and status are in the closed sets; and the others."""
    j = findings.join(sources.select("op_key", "text", "tokens"), "op_key", "left")
    ok = F.coalesce(name_in_source(F.col("name"), F.col("text"), F.col("tokens")) & valid_proposal(F.col("location"), F.col("type"), F.col("format"), F.col("status")), F.lit(False))
    judged = j.withColumn("__ok", ok).drop("text", "tokens")
    return judged.where("__ok").drop("__ok"), judged.where("NOT __ok").drop("__ok")
