"""Profiles and adapter specifications as configuration tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from factweave.sources.documents import parse_text
from factweave.tables import hadoop_path


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # one configuration file


class Profile:
    """What a project says about itself: response sinks in the order of their rules, security schemes of its
    middleware, expansions of its wildcard paths. Everything is optional."""

    def __init__(self, value: dict | None = None):
        value = value or {}
        self.framework = str(value.get("framework") or "unknown")
        self.sinks: list[dict] = [s for s in value.get("response_sinks") or [] if s.get("symbol")]
        self.security: dict[str, dict] = value.get("auth_middleware") or {}
        self.wildcards: dict[str, list[str]] = (value.get("path_conventions") or {}).get("wildcard_expansion") or {}

    @staticmethod
    def load(spark: SparkSession, path: str) -> Profile:
        """The profile of a file (JSON, or YAML where it can be read); a missing file is the default one,
        an unreadable one raises."""
        text = _read(spark, path)
        return Profile() if text is None else Profile(parse_text(text))

    def sink_rules(self, spark: SparkSession) -> DataFrame:
        """K4: ``rule, pattern, pos`` for ``evidence.first_rule``."""
        return spark.createDataFrame([(s["symbol"], s["symbol"], n) for n, s in enumerate(self.sinks)], "rule string, pattern string, pos int")

    def security_mapping(self, spark: SparkSession) -> DataFrame:
        """K4: ``middleware, scheme`` for ``joins.security_of``."""
        return spark.createDataFrame([(m, str(s.get("scheme") or s.get("type") or m)) for m, s in self.security.items()], "middleware string, scheme string")

    def wildcard_rules(self, spark: SparkSession) -> DataFrame:
        """K4: ``pattern, expansions`` for ``graph.expand_wildcards``."""
        return spark.createDataFrame([(p, list(x)) for p, x in self.wildcards.items()], "pattern string, expansions array<string>")


def save_spec(spark: SparkSession, folder: str, name: str, spec: dict) -> None:
    """A specification as ``<name>.json`` with sorted keys, written by a rename."""
    from factweave.operators.compile import write_artifacts

    write_artifacts(spark, folder, {f"{name}.json": json.dumps(spec, indent=2, sort_keys=True, ensure_ascii=False) + "\n"})


def load_specs(spark: SparkSession, folder: str) -> list[tuple[str, dict]]:
    """Name and specification of every ``.json`` file of a folder in name order; a missing folder has none,
    an unreadable file raises."""
    fs, p = hadoop_path(spark, folder)
    if not fs.exists(p):
        return []
    names = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))
    return [(n[: -len(".json")], parse_text(_read(spark, f"{folder}/{n}") or "")) for n in names]
