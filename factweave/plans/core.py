"""Queries of the general problems: incremental processing (p1) and nested records (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.operators.incremental import changed_records
from factweave.operators.nested import schema_nodes
from factweave.plans.registry import Registry
from factweave.tables import table

CORE = Registry()

#: DuckDB spelling of I1-I3 over a stored key ``k``.
_KEY = r"""upper(regexp_extract(k, '^(\S*)', 1)) || ' ' ||
 CASE WHEN p = '' THEN '' WHEN length(replace(r, '//', '/')) > 1 THEN regexp_replace(replace(r, '//', '/'), '/+$', '') ELSE replace(r, '//', '/') END"""


@CORE.add(
    rf"""WITH keyed AS (SELECT *, regexp_replace(operation_key, '^\s+|\s+$', '', 'g') AS k FROM operation_dependencies),
pathed AS (SELECT *, regexp_replace(regexp_extract(k, '(?s)^\S*\s*(.*)$', 1), '^\s+|\s+$', '', 'g') AS p FROM keyed),
rooted AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS r FROM pathed),
owner AS (SELECT DISTINCT fingerprint, engine_version, repo FROM contract_graph_cache WHERE repo IS NOT NULL),
log AS (SELECT o.repo, {_KEY} AS operation_key, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS file_path,
  regexp_replace(lower(trim(file_hash)), '^[a-z0-9_-]+:', '') AS file_hash, recorded_at, dep_seq, ingested_at
  FROM rooted JOIN owner o USING (fingerprint, engine_version)),
success AS (SELECT repo, max(started_at) AS started_at FROM run_log WHERE lower(trim(outcome)) = 'succeeded' GROUP BY repo),
listing AS (SELECT * FROM (SELECT repo, operation_key, file_path, file_hash, row_number() OVER (PARTITION BY repo, operation_key, file_path ORDER BY recorded_at DESC, dep_seq DESC) AS n FROM log) WHERE n = 1),
manifest AS (SELECT * FROM (SELECT l.repo, operation_key, file_path, file_hash, row_number() OVER (PARTITION BY l.repo, operation_key, file_path ORDER BY recorded_at DESC, dep_seq DESC) AS n
  FROM log l JOIN success s ON l.repo = s.repo AND ingested_at <= started_at) WHERE n = 1)
SELECT repo, operation_key, file_path FROM listing l WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.repo = l.repo
  AND m.operation_key = l.operation_key AND m.file_path = l.file_path AND m.file_hash IS NOT DISTINCT FROM l.file_hash)"""
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that are new or changed since their repo's last successful run."""
    log, snapshots, runs = (table(spark, d, t) for t in ("operation_dependencies", "contract_graph_cache", "run_log"))
    return changed_records(log, snapshots, runs).select("repo", "operation_key", "file_path")


@CORE.add(
    """WITH RECURSIVE newest AS (SELECT schema_id, schema_json::JSON AS node FROM (SELECT schema_id, schema_json,
   row_number() OVER (PARTITION BY schema_id ORDER BY received_at DESC, raw_id DESC) AS n
   FROM raw_schemas WHERE json_valid(schema_json) AND json_type(CASE WHEN json_valid(schema_json) THEN schema_json END) = 'OBJECT') WHERE n = 1),
 nodes AS (
  SELECT schema_id, '' AS node_path, CAST(NULL AS VARCHAR) AS parent_path, CAST(NULL AS VARCHAR) AS edge, node FROM newest
  UNION ALL
  SELECT schema_id, node_path || '/' || edge || coalesce('/' || step, ''), node_path, edge, child FROM (
   SELECT n.schema_id, n.node_path, m.edge, CASE WHEN m.kind = 'map' THEN replace(replace(c.key, '~', '~0'), '/', '~1') WHEN m.kind = 'list' THEN c.key END AS step, c.value AS child
   FROM nodes n, json_each(n.node) k JOIN (VALUES ('properties', 'properties', 'map'), ('items', 'items', 'one'), ('not', 'not', 'one'),
     ('all_of', 'all_of', 'list'), ('one_of', 'one_of', 'list'), ('any_of', 'any_of', 'list'), ('allOf', 'all_of', 'list'), ('oneOf', 'one_of', 'list'), ('anyOf', 'any_of', 'list')) m(word, edge, kind) ON m.word = k.key,
    json_each(CASE WHEN m.kind = 'one' THEN json_array(k.value) WHEN m.kind = 'map' AND k.type = 'OBJECT' OR m.kind = 'list' AND k.type = 'ARRAY' THEN k.value ELSE '[]'::JSON END) c
   WHERE json_type(c.value) = 'OBJECT')
 )
SELECT schema_id, node_path, parent_path, edge FROM nodes WHERE edge IS NOT NULL"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every schema node below properties, items, all_of and the like, with its parent."""
    return schema_nodes(table(spark, d, "raw_schemas")).select("schema_id", "node_path", "parent_path", "edge")
