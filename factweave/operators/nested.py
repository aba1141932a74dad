"""Deeply nested semi-structured records as related flat tables (problem 4).

``relate`` handles records whose merged schema is finite: the schema is inferred in one aggregation
over all rows, then every array or map level is exploded into a child table that carries the
surrogate key of its parent row and the ordinal within it. ``tree_nodes`` handles recursive trees. Their
property names are data, so that a struct of all names would grow with the corpus; the merged schema is
that of the node type: which keys hold named, ordered or single children (``merged_edges``, one
aggregation). Each level is one explode, many levels are one pass, and every node has a surrogate key, its
parent's, and its ordinal.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from factweave.tables import cut_lineage

#: The child edges of a schema node, by the key that holds them (two spellings).
SCHEMA_EDGES = {
    "properties": ("properties", "map"),
    "items": ("items", "one"),
    "not": ("not", "one"),
    "all_of": ("all_of", "list"),
    "one_of": ("one_of", "list"),
    "any_of": ("any_of", "list"),
    "allOf": ("all_of", "list"),
    "oneOf": ("one_of", "list"),
    "anyOf": ("any_of", "list"),
}


#: Levels that one pass explodes before what is deeper is looked at again.
LEVELS = 6


def with_object(rows: DataFrame, text: str, name: str = "node") -> DataFrame:
    """The rows whose text starts like a JSON object, with it as VARIANT; null if the text is unreadable, cut
    short or followed by other text. Each text is parsed once.

    Readers of single values stop at the end of the value; wrapped in an array, whatever follows
    makes the whole text unreadable or a second element.
    """
    wrapped = rows.where(F.regexp_like(text, F.lit(r"^[ \t\r\n]*\{"))).withColumn("__w", F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit("]"))))
    alone = F.try_variant_get("__w", "$[1]", "variant").isNull()
    return wrapped.withColumn(name, F.when(alone, F.try_variant_get("__w", "$[0]", "variant"))).drop("__w")


def members(v: F.Column) -> F.Column:
    """The members of a JSON object; null for null, scalars and arrays."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def latest_documents(rows: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """``key, node``: of each key the readable object with the greatest ``order``.

    Each text is parsed once; the parsed value travels with its order through one aggregation with
    map-side combine. Rows tied in the whole order are settled by the text's hash. Rows with a null key
    are left out.
    """
    parsed = with_object(rows.select(key, text, *order).where(F.col(key).isNotNull()), text)
    readable = F.when(F.col("node").isNotNull(), F.struct(*order, F.xxhash64(text)))
    return parsed.groupBy(key).agg(F.max_by("node", readable).alias("node")).where("node IS NOT NULL")


def merged_edges(roots: DataFrame, node: str = "node", edges: Mapping[str, tuple[str, str]] = SCHEMA_EDGES) -> dict[str, tuple[str, str]]:
    """The part of ``edges`` that the merged schema of all trees has: one aggregation over the keys of all
    objects at any depth, of which at most two rows per edge reach the driver. A key counts if it holds
    an object (``map``, ``one``) or an array (``list``) anywhere; types that don't merge hide nothing."""
    names = "|".join(map(re.escape, edges))
    seen = F.regexp_extract_all(F.to_json(node), F.lit(f'(?<=[{{,])"((?:{names})":[{{\\[])'), F.lit(1))
    found = {r.e for r in roots.select(F.explode(F.array_distinct(seen)).alias("e")).distinct().collect()}
    return {k: (edge, kind) for k, (edge, kind) in edges.items() if f'{k}":' + ("[" if kind == "list" else "{") in found}


def tree_nodes(roots: DataFrame, key: str, node: str = "node", edges: Mapping[str, tuple[str, str]] = SCHEMA_EDGES) -> DataFrame:
    """``key, node_key, parent_key, node_path, parent_path, edge, ordinal, name`` of every node below the roots.

    ``edges`` maps a JSON key to (edge name, kind): ``map`` holds named children, ``list`` ordered
    ones, ``one`` a single child. Children that are not objects are no nodes, but keep their place
    in the numbering of a list. A path is the parent's plus ``/edge``, and ``/NAME`` or ``/I``, with
    ``~`` and ``/`` of a name written ``~0`` and ``~1``. ``node_key`` is a surrogate: the root's key and the
    places of the nodes on the way. Roots without children and empty inputs give no rows.

    A node is replaced by itself, done, and its children; those with edges of their own are pending.
    ``LEVELS`` such steps are one narrow pass without a shuffle. What is pending then, at any depth, is
    written and goes through another. Only the edges of a node travel with it, and of its parent only how
    much of the path and of the key is the parent's.
    """
    held = merged_edges(roots, node, edges)
    spark = roots.sparkSession
    kind = roots.schema[key].dataType.simpleString()
    if not held:
        return spark.createDataFrame([], f"`{key}` {kind}, node_key string, parent_key string, node_path string, parent_path string, edge string, ordinal int, name string")
    of = lambda way: [k for k, (_, x) in held.items() if x == way]
    names = F.create_map(*[F.lit(x) for k, (edge, _) in held.items() for x in (k, edge)])
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    below = lambda v: F.filter(F.map_entries(members(v)), lambda e: e["key"].isin(list(held)))

    def children(e: F.Column, slot: F.Column) -> F.Column:
        """The rows of the children under one edge of the node."""
        child = lambda name, ordinal, v: F.struct(name.alias("name"), ordinal.alias("ordinal"), below(v).alias("below"))
        found = (
            F.when(e["key"].isin(of("map")), F.transform(F.map_entries(members(e["value"])), lambda x: child(x["key"], none_number, x["value"])))
            .when(e["key"].isin(of("list")), F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda v, i: child(none_text, i, v)))
            .when(e["key"].isin(of("one")), F.array(child(none_text, none_number, e["value"])))
        )
        edge = names[e["key"]]
        step = lambda c: F.coalesce(F.concat(F.lit("/"), F.replace(F.replace(c["name"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), F.concat(F.lit("/"), c["ordinal"].cast("string")), F.lit(""))
        row = lambda c, i: F.struct(
            F.concat("node_key", F.lit("."), slot.cast("string"), F.lit("-"), i.cast("string")).alias("node_key"),
            F.length("node_key").alias("key_cut"),
            F.concat("node_path", F.lit("/"), edge, step(c)).alias("node_path"),
            F.length("node_path").alias("path_cut"),
            edge.alias("edge"),
            c["ordinal"].alias("ordinal"),
            c["below"].alias("below"),
        )
        return F.transform(F.filter(found, lambda c: c["below"].isNotNull()), row)

    fields = ["node_key", "key_cut", "node_path", "path_cut", "edge", "ordinal"]
    itself = F.array(F.struct(*fields, F.array().cast("array<struct<key:string,value:variant>>").alias("below")))
    pending = F.size("below") > 0
    under = F.flatten(F.filter(F.transform("below", children), lambda x: x.isNotNull()))
    step = F.when(pending, F.concat(itself, under)).otherwise(itself)
    rows = roots.select(key, F.col(key).cast("string").alias("node_key"), F.lit(0).alias("key_cut"), F.lit("").alias("node_path"), F.lit(0).alias("path_cut"), none_text.alias("edge"), none_number.alias("ordinal"), below(F.col(node)).alias("below"))
    found = None
    while True:
        for _ in range(LEVELS):
            rows = rows.select(key, F.explode(step).alias("n")).select(key, "n.*")
        rows = cut_lineage(rows)
        done = rows.where(~pending & F.col("edge").isNotNull()).drop("below")
        found = done if found is None else found.unionByName(done)
        rows = rows.where(pending)
        if rows.isEmpty():
            break
    name = F.replace(F.replace(F.expr("substring(node_path, path_cut + length(edge) + 3)"), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    named = F.col("edge").isin([edge for edge, way in held.values() if way == "map"])
    return found.select(key, "node_key", F.expr("left(node_key, key_cut)").alias("parent_key"), "node_path", F.expr("left(node_path, path_cut)").alias("parent_path"), "edge", "ordinal", F.when(named, name).alias("name"))


def schema_nodes(raw: DataFrame) -> DataFrame:
    """The ``tree_nodes`` of each schema's newest readable version."""
    return tree_nodes(cut_lineage(latest_documents(raw, "schema_id", "schema_json", ["received_at", "raw_id"])), "schema_id")


def merged_schema(rows: DataFrame, text: str) -> str:
    """DDL of the schema that fits every readable text, merged by one aggregation on the executors."""
    ddl = rows.select(F.schema_of_variant_agg(F.try_parse_json(F.col(text))).alias("s")).first()["s"]
    types = {"OBJECT<": "STRUCT<", "VOID": "STRING"}  # names stand in backticks or before a colon
    return re.sub(r"`(?:[^`]|``)*`|\bOBJECT<|\bVOID\b(?!:)", lambda m: types.get(m[0], m[0]), ddl)


def relate(rows: DataFrame, key: str, column: str, root: str = "root") -> dict[str, DataFrame]:
    """Related flat tables of a nested column: name -> table.

    Each table has ``row_key`` (surrogate, unique and the same in every run) and, below the root,
    ``parent_key``, ``ordinal`` (place in the array, from 0) and, for maps, ``map_key``. Structs are
    flattened into ``outer_inner`` columns (``__2`` and so on where two names meet); null or empty
    arrays give no child rows, null elements give a row of nulls. Rows with a null key are left out.
    """
    tables: dict[str, DataFrame] = {}

    def build(df: DataFrame, kind: DataType, name: str, links: list[str]) -> None:
        flat: list[tuple[str, F.Column]] = []
        nested: list[tuple[str, DataType, F.Column]] = []

        def walk(t: DataType, prefix: str, c: F.Column) -> None:
            if isinstance(t, StructType):
                for f in t.fields:
                    walk(f.dataType, f"{prefix}_{f.name}" if prefix else f.name, c.getField(f.name))
            elif isinstance(t, (ArrayType, MapType)):
                nested.append((prefix or "values", t, c))
            else:
                flat.append((prefix or "value", c))

        walk(kind, "", F.col("__v"))
        taken: set[str] = {x.lower() for x in links}
        columns = []
        for label, c in flat:
            unique, n = label, 1
            while unique.lower() in taken:
                n += 1
                unique = f"{label}__{n}"
            taken.add(unique.lower())
            columns.append(c.alias(unique))
        tables[name] = df.select(*links, *columns)
        for label, t, c in nested:
            base = df.select(F.col("row_key").alias("parent_key"), c.alias("__a"))
            if isinstance(t, ArrayType):
                child = base.select("parent_key", F.posexplode("__a").alias("ordinal", "__v"))
                extra, inner = ["ordinal"], t.elementType
            else:
                child = base.select("parent_key", F.posexplode(F.map_entries("__a")).alias("ordinal", "__e")).select("parent_key", "ordinal", F.col("__e.key").cast("string").alias("map_key"), F.col("__e.value").alias("__v"))
                extra, inner = ["ordinal", "map_key"], t.valueType
            keyed = child.withColumn("row_key", F.concat_ws("/", "parent_key", F.lit(label), F.col("ordinal").cast("string")))
            build(keyed, inner, f"{name}_{label}", ["row_key", "parent_key", *extra])

    start = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("__v"))
    build(start, rows.schema[column].dataType, root, ["row_key"])
    return tables
