"""The DuckDB twin of flattening, as common table expressions over raw_schemas.

``doc`` has the readable trees, ``flat_fields`` (raw_id, entry) their fields, ``flat_open`` (raw_id, prefix) their
open objects. Nodes are listed by path first; per node and number of merge levels the winning layer of each
property is an aggregate; then flattening is a recursion over paths. References are dangling in that table.
"""

FLAT_TREES = r"""doc AS (SELECT DISTINCT raw_id, schema_id, received_at, schema_json::JSON AS node FROM raw_schemas
  WHERE json_valid(schema_json) AND json_type(CASE WHEN json_valid(schema_json) THEN schema_json END) = 'OBJECT'),
 word(word, edge, kind, rank) AS (VALUES ('properties', 'p', 'map', 0), ('items', 'i', 'one', 0), ('all_of', 'a', 'list', 0), ('allOf', 'a', 'list', 1000),
  ('one_of', 'v', 'list', 0), ('oneOf', 'v', 'list', 1000), ('any_of', 'v', 'list', 2000), ('anyOf', 'v', 'list', 3000)),
 n AS (
  SELECT raw_id, '' AS path, '' AS parent, '' AS edge, '' AS name, 0 AS pos, node FROM doc
  UNION ALL
  SELECT raw_id, path || '/' || word || '/' || name, path, edge, name, pos, CASE WHEN json_type(child) = 'OBJECT' THEN child ELSE '{}'::JSON END FROM (
   SELECT n.raw_id, n.path, m.word, m.edge, m.kind, coalesce(c.key, '') AS name, CASE WHEN m.kind = 'list' THEN m.rank + CAST(c.key AS INT) ELSE 0 END AS pos, c.value AS child
   FROM n, json_each(n.node) k JOIN word m ON m.word = k.key,
    json_each(CASE WHEN m.kind = 'one' THEN json_array(k.value) WHEN m.kind = 'map' AND k.type = 'OBJECT' OR m.kind = 'list' AND k.type = 'ARRAY' THEN k.value ELSE '[]'::JSON END) c
   WHERE m.kind = 'map' OR json_type(c.value) = 'OBJECT')
 ),
 fact AS (SELECT n.raw_id, path, parent, edge, name, pos, node,
   regexp_extract(CASE WHEN json_type(node, '$."$ref"') = 'VARCHAR' AND json_extract_string(node, '$."$ref"') <> '' THEN json_extract_string(node, '$."$ref"') WHEN json_type(node, '$.ref') = 'VARCHAR' THEN json_extract_string(node, '$.ref') END, '([^/]*)$', 1) AS ref,
   CASE WHEN json_type(node, '$.additionalProperties') IS NULL THEN json_type(node, '$.additional_properties') ELSE json_type(node, '$.additionalProperties') END AS extra,
   coalesce(json_extract(node, '$.type'), json_extract(node, '$.types')) AS t, json_extract_string(node, '$.format') AS format,
   has.p, has.a, has.v, has.i FROM n LEFT JOIN (SELECT raw_id, parent AS path, bool_or(edge = 'p') AS p, bool_or(edge = 'a') AS a, bool_or(edge = 'v') AS v, max(CASE WHEN edge = 'i' THEN path END) AS i FROM n WHERE edge <> '' GROUP BY ALL) has USING (raw_id, path)),
 layer AS (
  SELECT raw_id, path AS owner, path, [-1] AS rank, 0 AS level FROM fact
  UNION ALL
  SELECT l.raw_id, l.owner, c.path, list_append(l.rank, c.pos), level + 1 FROM layer l JOIN n c ON c.raw_id = l.raw_id AND c.parent = l.path AND c.edge = 'a' WHERE level < 9),
 cap AS (SELECT unnest(range(1, 10)) AS cap),
 winner AS (SELECT l.raw_id, owner, cap, c.name, arg_max(c.path, l.rank) AS path FROM layer l JOIN cap ON level <= cap JOIN n c ON c.raw_id = l.raw_id AND c.parent = l.path AND c.edge = 'p' GROUP BY ALL),
 must AS (SELECT DISTINCT l.raw_id, owner, cap, r.name FROM layer l JOIN cap ON level <= cap JOIN (SELECT raw_id, path, unnest(from_json(json_extract(node, '$.required'), '["VARCHAR"]')) AS name FROM n WHERE json_type(node, '$.required') = 'ARRAY') r ON r.raw_id = l.raw_id AND r.path = l.path),
 flat AS (
  SELECT raw_id, '' AS prefix, '' AS path, 0 AS depth FROM doc
  UNION
  SELECT s.raw_id, s.prefix, s.path, s.depth FROM (
   SELECT f.raw_id, f.prefix, c.path, f.depth + 1 AS depth FROM flat f JOIN fact o USING (raw_id, path) JOIN n c ON c.raw_id = f.raw_id AND c.parent = f.path AND c.edge = 'v' WHERE o.ref IS NULL
   UNION ALL
   SELECT f.raw_id, CASE WHEN f.prefix = '' THEN w.name ELSE f.prefix || '.' || w.name END, w.path, f.depth + 1 FROM flat f JOIN fact o USING (raw_id, path) JOIN winner w ON w.raw_id = f.raw_id AND w.owner = f.path AND w.cap = 9 - f.depth JOIN fact x ON x.raw_id = f.raw_id AND x.path = w.path
    WHERE o.ref IS NULL AND o.v IS NOT TRUE AND (x.p OR x.a OR x.v OR x.ref IS NOT NULL)
   UNION ALL
   SELECT f.raw_id, CASE WHEN f.prefix = '' THEN w.name ELSE f.prefix || '.' || w.name END || '[]', x.i, f.depth + 1 FROM flat f JOIN fact o USING (raw_id, path) JOIN winner w ON w.raw_id = f.raw_id AND w.owner = f.path AND w.cap = 9 - f.depth JOIN fact x ON x.raw_id = f.raw_id AND x.path = w.path
    WHERE o.ref IS NULL AND o.v IS NOT TRUE AND x.i IS NOT NULL
   UNION ALL
   SELECT f.raw_id, f.prefix || '[]', o.i, f.depth + 1 FROM flat f JOIN fact o USING (raw_id, path) WHERE o.ref IS NULL AND o.v IS NOT TRUE AND o.i IS NOT NULL
  ) s WHERE s.depth <= 8),
 flat_fields AS (
  SELECT DISTINCT f.raw_id, f.prefix || ':$ref:' || o.ref AS entry FROM flat f JOIN fact o USING (raw_id, path) WHERE o.ref IS NOT NULL
  UNION
  SELECT f.raw_id, CASE WHEN f.prefix = '' THEN w.name ELSE f.prefix || '.' || w.name END || '|' ||
    CASE WHEN x.ref IS NOT NULL THEN '$ref' WHEN x.a OR x.t IS NULL AND (x.p OR x.v) THEN 'object'
     WHEN json_type(x.t) = 'ARRAY' THEN coalesce(array_to_string(list_filter(from_json(x.t, '["VARCHAR"]'), lambda y: y IS NOT NULL AND y <> 'null'), '|'), '')
     WHEN json_type(x.t) IS DISTINCT FROM 'VARCHAR' THEN '?'
     WHEN coalesce(x.format, '') <> '' AND (x.t->>'$') NOT IN ('integer', 'number') THEN (x.t->>'$') || '/' || x.format ELSE x.t->>'$' END
    || '|' || CASE WHEN q.name IS NULL THEN 'false' ELSE 'true' END
  FROM flat f JOIN fact o USING (raw_id, path) JOIN winner w ON w.raw_id = f.raw_id AND w.owner = f.path AND w.cap = 9 - f.depth JOIN fact x ON x.raw_id = f.raw_id AND x.path = w.path
   LEFT JOIN must q ON q.raw_id = f.raw_id AND q.owner = f.path AND q.cap = 9 - f.depth AND q.name = w.name
  WHERE o.ref IS NULL AND o.v IS NOT TRUE)"""
