"""Scalar functions over names, schemas, tags and source text (I5-I32): Column -> Column, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scalar types and formats that proposals may use.
PARAM_LOCATIONS = ["path", "query", "header", "cookie"]
SCALAR_TYPES = ["string", "integer", "number", "boolean"]
METHOD_RANK = ["get", "put", "post", "delete", "patch", "head", "options", "trace"]
STATUS_TEXT = {200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found", 304: "Not Modified", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 409: "Conflict", 422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}


def _lookup(values: dict, c: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, c), default)


def generic_template(path: Column) -> Column:
    """``:id``, ``{id:int}`` and ``<int:id>`` become ``{id}``."""
    p = F.regexp_replace(path, r"<(?:[A-Za-z_]\w*:)?([A-Za-z_]\w*)>", r"{$1}")
    p = F.regexp_replace(p, r"\{([A-Za-z_]\w*)(?::[^{}]*)?\}", r"{$1}")
    return F.regexp_replace(p, r":([A-Za-z_]\w*)", r"{$1}")


def template_names(path: Column) -> Column:
    """The parameter names of a templated path in order, each once."""
    return F.array_distinct(F.regexp_extract_all(path, F.lit(r"\{([^{}/]+)\}"), F.lit(1)))


def method_of_pattern(pattern: Column) -> Column:
    """The method of ``GET /x``; empty if the pattern is a path only."""
    return F.regexp_extract(F.trim(pattern), r"^([A-Z]+)\s+\S", 1)


def path_of_pattern(pattern: Column) -> Column:
    """The path of ``GET /x``."""
    return F.regexp_replace(F.trim(pattern), r"^[A-Z]+\s+", "")


def component_safe(name: Column) -> Column:
    """I8: byte-wise; each byte outside ``[A-Za-z0-9._-]`` becomes ``_``, so ``é`` gives two."""
    def one(c: Column) -> Column:
        return F.when(F.regexp_like(c, F.lit(r"^[A-Za-z0-9._-]$")), c).otherwise(F.repeat(F.lit("_"), F.octet_length(c)))

    return F.array_join(F.transform(F.split(name, ""), lambda c: F.when(c == "", F.lit("")).otherwise(one(c))), "")


def token_set(text: Column) -> Column:
    """Distinct identifiers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))


def number_set(text: Column) -> Column:
    """Distinct numeric literals of a text, sorted as text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))))


def whole_word(text: Column, word: Column) -> Column:
    """The word occurs with no letter, digit or underscore on either side; regex signs are literal."""
    quoted = F.concat(F.lit("(?<![\\p{L}\\p{Nd}_])\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{L}\\p{Nd}_])"))
    return (word != "") & F.regexp_like(text, quoted)


def is_identifier(c: Column) -> Column:
    """Letters, digits and underscores, not starting with a digit."""
    return F.regexp_like(c, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*$"))


def name_in_source(name: Column, text: Column, tokens: Column) -> Column:
    """A whole token, or the name in single or double quotes; an empty name is in no source."""
    quoted = [F.contains(text, F.concat(F.lit(q), name, F.lit(q))) for q in ('"', "'")]
    return (name != "") & (F.array_contains(tokens, name) | quoted[0] | quoted[1])


def gap_text(kind: Column, detail: Column) -> Column:
    """``kind: detail``."""
    return F.concat(kind, F.lit(": "), detail)


def gap_detail(gap: Column) -> Column:
    """What follows the last ``: ``; the whole text if there is none."""
    return F.regexp_extract(gap, r"(?s)^(?:.*: )?(.*)$", 1)


def site_expression(site: Column) -> Column:
    """What follows the first blank of ``file:line expr``."""
    return F.regexp_extract(site, r"^\S+\s+(.*)$", 1)


def site_file(site: Column) -> Column:
    """The file of ``file:line expr``."""
    return F.regexp_extract(site, r"^([^\s:]+):\d+", 1)


def site_line(site: Column) -> Column:
    """The line of ``file:line expr``; null without one."""
    return F.regexp_extract(site, r"^[^\s:]+:(\d+)", 1).try_cast("int")


def type_string(types: Column, format_: Column) -> Column:
    """I16: types without null joined by ``|``, ``object`` if none; a format follows in parentheses
    unless the type is numeric."""
    named = F.array_join(F.array_remove(types, "null"), "|")
    base = F.when(F.coalesce(named, F.lit("")) == "", F.lit("object")).otherwise(named)
    return F.when(F.coalesce(format_, F.lit("")).isin("") | base.isin("integer", "number"), base).otherwise(F.concat(base, F.lit("("), format_, F.lit(")")))


def drop_required(triple: Column) -> Column:
    """``path|type|required`` without its last part."""
    return F.regexp_replace(triple, r"\|[^|]*$", "")


def truncate_characters(c: Column, n: int) -> Column:
    """At most ``n`` code points, an ellipsis after a cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def first_line(c: Column) -> Column:
    """Up to the first line break."""
    return F.trim(F.substring_index(c, "\n", 1))


def first_paragraph(c: Column) -> Column:
    """Up to the first blank line, on one line."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, r"(?s)^\s*(.*?)(?:\n[ \t]*\n|$)", 1), r"\s+", " "))


def struct_tag(tag: Column, key: str) -> Column:
    """The value of ``key:"..."`` in a struct tag; null if the tag lacks it."""
    found = F.regexp_extract(tag, rf'(?:^|\s){key}:"([^"]*)"', 1)
    return F.when(F.regexp_like(tag, F.lit(rf'(?:^|\s){key}:"')), found)


def json_name(tag: Column, field: Column) -> Column:
    """The serialised name: that of the json tag, else the field's; ``-`` is null (left out)."""
    named = F.substring_index(F.coalesce(struct_tag(tag, "json"), F.lit("")), ",", 1)
    return F.when(named == "-", F.lit(None)).when(named == "", field).otherwise(named)


def required_by_tag(tag: Column) -> Column:
    """``binding`` or ``validate`` holds ``required``, or json lacks ``omitempty`` and neither exists."""
    rules = F.concat_ws(",", struct_tag(tag, "binding"), struct_tag(tag, "validate"))
    omits = F.array_contains(F.split(F.coalesce(struct_tag(tag, "json"), F.lit("")), ","), "omitempty")
    return F.when(rules != "", F.array_contains(F.split(rules, ","), "required")).otherwise(~omits)


def human_bytes(n: Column) -> Column:
    """1024-based sizes with one decimal, halves to the even digit."""
    size = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n.cast("double") / unit, 1))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, size(1 << 10, "KiB")).when(n < 1 << 30, size(1 << 20, "MiB")).otherwise(size(1 << 30, "GiB"))


def evidence_label(quote: Column) -> Column:
    """The label of a quote ``llm:label ← source line``; of other quotes ``route``."""
    return F.when(F.startswith(quote, F.lit("llm:")), F.substring_index(quote, " ← ", 1)).otherwise(F.lit("route"))


def tag_constraints(tag: Column, type_: Column) -> Column:
    """``minimum, maximum, enum`` of the rules in ``binding``, else ``validate``; of strings and arrays (by
    their schema type) they bound the length. Later rules win, unreadable numbers count for nothing.

    ``min``, ``len`` and ``minlength`` bound a length from below, ``max``, ``len`` and ``maxlength`` from above; ``min`` or
    ``gte``, and ``max`` or ``lte``, bound a number; ``oneof`` lists the values.
    """
    rules = F.split(F.coalesce(F.nullif(struct_tag(tag, "binding"), F.lit("")), struct_tag(tag, "validate"), F.lit("")), ",")
    pairs = F.transform(F.filter(rules, lambda r: F.contains(r, F.lit("="))), lambda r: F.struct(F.substring_index(r, "=", 1).alias("rule"), F.regexp_replace(r, r"^[^=]*=", "").alias("value")))
    length = type_.isin("string", "array")

    def last(of_length: list[str], of_number: list[str]) -> Column:
        held = F.filter(pairs, lambda p: F.when(length, p["rule"].isin(of_length)).otherwise(p["rule"].isin(of_number)) & p["value"].try_cast("double").isNotNull())
        found = F.try_element_at(held, F.lit(-1))["value"].try_cast("double")
        return F.when(length, F.floor(found).cast("double")).otherwise(found)

    values = F.flatten(F.transform(F.filter(pairs, lambda p: p["rule"] == "oneof"), lambda p: F.filter(F.split(p["value"], r"\s+"), lambda x: x != "")))
    return F.struct(last(["min", "len", "minlength"], ["min", "gte"]).alias("minimum"), last(["max", "len", "maxlength"], ["max", "lte"]).alias("maximum"), values.alias("enum"))


def status_number(c: Column) -> Column:
    """The status as a number; 0 if it is anything but digits."""
    return F.when(F.regexp_like(c, F.lit(r"^\d{1,9}$")), c.try_cast("int")).otherwise(F.lit(0))


def status_text(n: Column) -> Column:
    """The reason phrase; ``Response`` for others."""
    return _lookup(STATUS_TEXT, n, F.lit("Response"))


def operation_id(method: Column, path: Column) -> Column:
    """``get`` + the words of the path in capitals, ``ByName`` for parameters."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    def camel(s: Column) -> Column:
        words = F.regexp_extract_all(F.regexp_replace(s, "[{}]", ""), F.lit("[A-Za-z0-9]+"), F.lit(0))
        joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))), "")
        return F.when(F.startswith(s, F.lit("{")), F.concat(F.lit("By"), joined)).otherwise(joined)

    return F.concat(F.lower(method), F.array_join(F.transform(parts, camel), ""))


def relative_path(path: Column, root: Column) -> Column:
    """The path below ``root``; unchanged if it lies elsewhere."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def map_value_type(type_: Column) -> Column:
    """I32: the value type of ``map[K]V``; null for other types."""
    found = F.regexp_extract(type_, r"^\*?map\[[^\]]+\](.+)$", 1)
    return F.when(found != "", found)


def scalar_type(type_: Column) -> Column:
    """I32: the schema type of a Go scalar; null for other types."""
    t = F.regexp_replace(type_, r"^\*", "")
    return (
        F.when(t.isin("string", "error"), "string").when(F.regexp_like(t, F.lit(r"^u?int(8|16|32|64)?$|^byte$|^rune$")), "integer")
        .when(F.regexp_like(t, F.lit(r"^float(32|64)$")), "number").when(t == "bool", "boolean")
    )


def is_any_type(type_: Column) -> Column:
    """I32: the open type in either spelling."""
    return F.trim(type_).isin("any", "interface{}", "*any", "*interface{}")


def path_order(path: Column) -> Column:
    """sort key that compares paths segment by segment, shorter first."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def method_order(method: Column) -> Column:
    """rank of a method; others come last."""
    return _lookup({m: i for i, m in enumerate(METHOD_RANK)}, F.lower(method), F.lit(len(METHOD_RANK)))


def location_order(where: Column) -> Column:
    """path, query, header, cookie, others."""
    return _lookup({m: i for i, m in enumerate(PARAM_LOCATIONS)}, where, F.lit(len(PARAM_LOCATIONS)))


def strip_literals(line: Column) -> Column:
    """String literals of one line emptied and its comment cut, so that braces can be counted."""
    bare = F.regexp_replace(line, r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'|`[^`]*`", '""')
    return F.regexp_replace(bare, r"//.*$|#.*$", "")


def brace_balance(line: Column) -> Column:
    """Opening less closing braces outside literals and comments."""
    bare = strip_literals(line)
    return F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))


def indentation(line: Column) -> Column:
    """Leading blanks and tabs, each as one."""
    return F.length(F.regexp_extract(line, r"^([ \t]*)", 1))
