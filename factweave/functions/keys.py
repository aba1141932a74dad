"""Normalisation of operation keys, paths and hashes (I1-I7): Column -> Column, JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_space(c: Column) -> Column:
    """Strips white space of any kind on both ends (plain ``trim`` strips blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_method(c: Column) -> Column:
    """Trimmed, upper case; null stays null."""
    return F.upper(trim_space(c))


def normalize_path(c: Column) -> Column:
    """Trim; empty stays empty; leading ``/`` added; one single pass ``//`` -> ``/``; trailing
    ``/`` cut if longer than one character. ``////`` therefore becomes the empty string."""
    p = trim_space(c)
    rooted = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    once = F.replace(rooted, F.lit("//"), F.lit("/"))
    cut = F.when(F.length(once) > 1, F.regexp_replace(once, "/+$", "")).otherwise(once)
    return F.when(p == "", p).otherwise(cut)


def template_path(c: Column) -> Column:
    """I4: ``:name`` -> ``{name}`` and ``*name`` at a segment start -> ``{name}``; a bare ``*`` stays."""
    colon = F.regexp_replace(c, r":([^/]*)", r"{$1}")
    return F.regexp_replace(colon, r"(^|/)\*([A-Za-z0-9_][^/]*)", r"$1{$2}")


def has_wildcard(c: Column) -> Column:
    """I4: an optional ``?`` or an anonymous ``*`` is left in the path."""
    return F.contains(c, F.lit("?")) | F.contains(template_path(c), F.lit("*"))


def operation_key(method: Column, path: Column) -> Column:
    """``METHOD /path``."""
    return F.concat(normalize_method(method), F.lit(" "), normalize_path(path))


def split_operation_key(key: Column) -> tuple[Column, Column]:
    """The method and the path of a key written as ``method path`` with any white space."""
    k = trim_space(key)
    return F.regexp_extract(k, r"^(\S*)", 1), F.regexp_extract(k, r"(?s)^\S*\s*(.*)$", 1)


def normalize_operation_key(key: Column, templates: bool = False) -> Column:
    """I1-I3 applied to a stored key, with I4 as well if ``templates``."""
    method, path = split_operation_key(key)
    return operation_key(method, template_path(path) if templates else path)


def normalize_file_path(c: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", "")


def normalize_hash(c: Column) -> Column:
    """Lower case without an algorithm prefix such as ``sha256:``; null stays null."""
    return F.regexp_replace(F.lower(trim_space(c)), r"^[a-z0-9_-]+:", "")


def schema_ref(c: Column) -> Column:
    """The last segment of a schema reference."""
    return F.substring_index(trim_space(c), "/", -1)


def last_segment(c: Column) -> Column:
    """What follows the last dot of the last path segment."""
    return F.substring_index(F.substring_index(c, "/", -1), ".", -1)


def short_hash(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, low 24 bits, six hex digits (the fold is modulo 2^24)."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(c), F.lit(1))), lambda i: F.conv(F.substring(F.hex(c), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    octets = F.filter(pairs, lambda b: b.isNotNull() & (F.octet_length(c) > 0))
    value = F.aggregate(octets, F.lit(0x222325).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 435).bitwiseAND(0xFFFFFF))
    return F.lpad(F.lower(F.hex(value)), 6, "0")
