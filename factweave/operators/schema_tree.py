"""Flattening, comparing and editing of schema trees.

``flatten`` reads whole trees, one row each with the components that its references mean, and gives the
fields of every tree in one narrow pass: a tree is bounded by its document, and its merge rules (a later
branch overrides an earlier one, up to a depth) are a recursion that no fixed number of joins expresses.
The other operators work on node rows ``schema_id, path, parent_path, edge, name, type, required, open``; the
root's path is empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLATTEN_DEPTH, SHAPE_DEPTH = 8, 24


class Tree:
    """One schema node in either spelling (``allOf`` or ``all_of``, ``type`` or ``types``, ``$ref`` or ``ref``)."""

    def __init__(self, node: object, components: dict | None = None):
        self.node = node if isinstance(node, dict) else {}
        self.components = components or {}

    def _child(self, node: object) -> Tree:
        return Tree(node, self.components)

    def _list(self, *words: str) -> list[Tree]:
        return [self._child(x) for w in words if isinstance(self.node.get(w), list) for x in self.node[w] if isinstance(x, dict)]

    @property
    def reference(self) -> str | None:
        """The last segment of the reference, if the node is one."""
        ref = self.node.get("$ref") or self.node.get("ref")
        return ref.rsplit("/", 1)[-1] if isinstance(ref, str) else None

    @property
    def target(self) -> Tree | None:
        """What the reference means; None if it is missing."""
        found = self.components.get(self.reference)
        return self._child(found) if isinstance(found, dict) else None

    @property
    def properties(self) -> dict[str, Tree]:
        held = self.node.get("properties")
        return {k: self._child(v) for k, v in held.items()} if isinstance(held, dict) else {}

    @property
    def items(self) -> Tree | None:
        held = self.node.get("items")
        return self._child(held) if isinstance(held, dict) else None

    @property
    def all_of(self) -> list[Tree]:
        return self._list("all_of", "allOf")

    @property
    def variants(self) -> list[Tree]:
        return self._list("one_of", "oneOf") + self._list("any_of", "anyOf")

    @property
    def required(self) -> set[str]:
        held = self.node.get("required")
        return {x for x in held if isinstance(x, str)} if isinstance(held, list) else set()

    @property
    def open(self) -> bool:
        """Further properties are allowed."""
        extra = self.node.get("additionalProperties", self.node.get("additional_properties"))
        return extra is True or isinstance(extra, dict)

    def layers(self, depth: int) -> Iterator[Tree]:
        """H6: the node and, up to the depth, its ``all_of`` branches in order, each before its own branches.
        A branch that is a reference stands for its target; a later layer overrides an earlier one."""
        yield self
        if depth <= FLATTEN_DEPTH:
            for part in self.all_of:
                yield from (part.target or part).layers(depth + 1)

    def merged(self, depth: int) -> tuple[dict[str, Tree], set[str]]:
        """Properties and required names of all layers."""
        properties: dict[str, Tree] = {}
        required: set[str] = set()
        for layer in self.layers(depth):
            properties |= layer.properties
            required |= layer.required
        return properties, required

    def type_text(self) -> str:
        """I16: the type of a field, that of its target if it is a reference; formats of numbers and null in a
        list of types play no part, no type with a structure is an object, and ``?`` says nothing."""
        node = self
        for _ in range(FLATTEN_DEPTH + 1):
            if node.reference is None or node.target is None:
                break
            node = node.target
        if node.reference is not None:
            return "$ref"
        kind = node.node.get("type", node.node.get("types"))
        if node.all_of or kind is None and (node.properties or node.variants):
            return "object"
        if isinstance(kind, list):
            return "|".join(x for x in kind if isinstance(x, str) and x != "null")
        if not isinstance(kind, str):
            return "?"
        form = node.node.get("format")
        return f"{kind}/{form}" if form and isinstance(form, str) and kind not in ("integer", "number") else kind

    def fields(self, prefix: str = "", depth: int = 0) -> Iterator[str]:
        """H5: ``path|type|required`` of every field; ``[]`` stands for items.

        Variants add a level and stand for the whole node; a reference adds none, and one whose target is
        missing gives ``path:$ref:name``. Nine levels are read. Fields may come twice.
        """
        if depth > FLATTEN_DEPTH:
            return
        node = self
        if self.reference is not None:
            if self.target is None:
                yield f"{prefix}:$ref:{self.reference}"
                return
            node = self.target
        if node.variants:
            for v in node.variants:
                yield from v.fields(prefix, depth + 1)
            return
        properties, required = node.merged(depth)
        for name, p in properties.items():
            path = f"{prefix}.{name}" if prefix else name
            yield f"{path}|{p.type_text()}|{'true' if name in required else 'false'}"
            if p.properties or p.reference is not None or p.all_of or p.variants:
                yield from p.fields(path, depth + 1)
            if p.items:
                yield from p.items.fields(f"{path}[]", depth + 1)
        if node.items:
            yield from node.items.fields(f"{prefix}[]", depth + 1)

    def open_paths(self, prefix: str = "", depth: int = 0, hops: int = 0) -> Iterator[str]:
        """H7: the paths of open objects; variants add to what the node itself has. References that only
        lead to each other have none."""
        if depth > FLATTEN_DEPTH:
            return
        if self.reference is not None:
            if self.target is not None and hops <= len(self.components):
                yield from self.target.open_paths(prefix, depth, hops + 1)
            return
        for v in self.variants:
            yield from v.open_paths(prefix, depth + 1)
        if self.open:
            yield prefix
        for name, p in self.merged(depth)[0].items():
            yield from p.open_paths(f"{prefix}.{name}" if prefix else name, depth + 1)
        if self.items:
            yield from self.items.open_paths(f"{prefix}[]", depth + 1)


def flatten(trees: DataFrame, key: str, tree: str = "node", components: str | None = None) -> DataFrame:
    """H5-H7: ``key, kind, entry``: each ``field`` (``path|type|required``) and ``open`` path of every tree, once.

    ``tree`` and ``components`` are VARIANT columns: a schema, and an object of the schemas that its
    references name by their last segment. Null trees and trees that are no object have no entries; rows
    are not merged.
    """
    kind = trees.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, entries = [], [], []
            for n, (t, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                root = Tree(json.loads(t) if t else None, json.loads(c) if c else None)
                for name, found in (("field", root.fields()), ("open", root.open_paths())):
                    different = dict.fromkeys(found)
                    rows += [n] * len(different)
                    kinds += [name] * len(different)
                    entries += different
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(entries, pa.string())], names=[key, "kind", "entry"])

    text = F.lit(None).cast("string") if components is None else F.to_json(components)
    return trees.select(key, F.to_json(tree).alias("t"), text.alias("c")).mapInArrow(run, f"`{key}` {kind}, kind string, entry string")


def unknown_paths(nodes: DataFrame) -> DataFrame:
    """H8: paths of nodes marked unknown; nothing below an open object is listed, references stay closed.

    The ancestors of an unknown node are listed and joined by equality, so that no tree is paired with itself.
    """
    opened = nodes.where("open").select("schema_id", F.col("path").alias("__open")).distinct()
    unknown = nodes.where("unknown").select("schema_id", "path")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    listed = unknown.where(F.contains("path", F.lit("/"))).select("schema_id", "path", F.explode(above).alias("__open"))
    below = listed.join(opened, ["schema_id", "__open"], "left_semi").select("schema_id", "path").distinct()
    return unknown.join(below, ["schema_id", "path"], "left_anti")


def canonical_shapes(nodes: DataFrame, depth: int = SHAPE_DEPTH) -> DataFrame:
    """H9: ``schema_id, shape``: SHA-256 of a tree's node signatures, the same for trees that differ in
    names and order of their schemas only. Nodes are hashed first, so a tree is one hash per node."""
    level = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    signature = F.sha2(F.concat_ws("|", "path", F.coalesce("type", F.lit("")), F.coalesce(F.col("required").cast("string"), F.lit("")), F.coalesce(F.col("open").cast("string"), F.lit(""))), 256)
    return nodes.where(level <= 2 * depth).groupBy("schema_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(signature)), "\n"), 256).alias("shape"))


def replace_subtree(nodes: DataFrame, schema_id: str, path: str, replacement: DataFrame) -> DataFrame:
    """The tree with the subtree at ``path`` replaced by the tree ``replacement`` (paths from its root)."""
    inside = (F.col("schema_id") == schema_id) & ((F.col("path") == path) | F.startswith("path", F.lit(path + "/")))
    old = nodes.where((F.col("schema_id") == schema_id) & (F.col("path") == path)).select(F.col("parent_path").alias("__pp"), F.col("edge").alias("__e"), F.col("name").alias("__n"), F.col("required").alias("__r"))
    root = F.col("path") == ""
    new = replacement.crossJoin(F.broadcast(old)).withColumn("schema_id", F.lit(schema_id))  # one row
    new = new.withColumn("parent_path", F.when(root, F.col("__pp")).otherwise(F.concat(F.lit(path), "parent_path"))).withColumn("edge", F.when(root, F.col("__e")).otherwise(F.col("edge"))).withColumn("name", F.when(root, F.col("__n")).otherwise(F.col("name"))).withColumn("required", F.when(root, F.col("__r")).otherwise(F.col("required"))).withColumn("path", F.concat(F.lit(path), "path"))
    return nodes.where(~inside).unionByName(new.select(*nodes.columns))
