"""Queries on nested records."""

from __future__ import annotations

from siftline.operators import nested
from siftline.plans.registry import Registry
from siftline.session import table

R = Registry()


# a schema's entries, its items and its alternatives, level by level; an entry is given when it is reached
PARAMETERS_SQL = """WITH RECURSIVE j0 AS (SELECT tool_id, CASE WHEN parameters <> '' AND json_valid(parameters) THEN parameters::JSON END AS j FROM tool_catalog),
    j1 AS (SELECT tool_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM j0),
    t AS (SELECT tool_id, j, '' AS node_path, '' AS around, false AS entry, '' AS parent_path FROM j1 WHERE json_type(j) = 'OBJECT' AND (json_type(j, '$.type') IS NULL OR (json_type(j, '$.type') = 'VARCHAR' AND j->>'$.type' = 'object'))
      UNION ALL SELECT t.tool_id, x.v, t.node_path || x.step, CASE WHEN x.entry THEN t.node_path || x.step ELSE t.around END, x.entry, t.around FROM t, LATERAL (
        SELECT '/' || key AS step, value AS v, true AS entry FROM json_each(CASE WHEN json_type(t.j, '$.properties') = 'OBJECT' THEN json_extract(t.j, '$.properties') ELSE '{}'::JSON END)
        UNION ALL SELECT '[]', json_extract(t.j, '$.items'), false WHERE json_type(t.j, '$.items') = 'OBJECT'
        UNION ALL SELECT '|' || key, value, false FROM json_each(CASE WHEN json_type(t.j, '$.anyOf') = 'ARRAY' THEN json_extract(t.j, '$.anyOf') ELSE '[]'::JSON END) WHERE json_type(value) = 'OBJECT'
        UNION ALL SELECT '|' || key, value, false FROM json_each(CASE WHEN json_type(t.j, '$.oneOf') = 'ARRAY' THEN json_extract(t.j, '$.oneOf') ELSE '[]'::JSON END) WHERE json_type(value) = 'OBJECT'
        UNION ALL SELECT '|' || key, value, false FROM json_each(CASE WHEN json_type(t.j, '$.allOf') = 'ARRAY' THEN json_extract(t.j, '$.allOf') ELSE '[]'::JSON END) WHERE json_type(value) = 'OBJECT') x
      WHERE json_type(t.j) = 'OBJECT')
    SELECT DISTINCT tool_id, node_path, parent_path FROM t WHERE entry"""


@R.add("p5_found", PARAMETERS_SQL)
def p5_found(spark, d):
    return nested.schema_parameters(table(spark, d, "tool_catalog"), "tool_id", "parameters", first_only=True, details=False).select("tool_id", "node_path", "parent_path")


@R.add("p5_nodes")
def p5_nodes(spark, d):
    return nested.nodes(table(spark, d, "tool_catalog"), "tool_id", "parameters")


@R.add("p5_tables")
def p5_tables(spark, d):
    return nested.tables(nested.nodes(table(spark, d, "tool_catalog"), "tool_id", "parameters"), "tool_id")


@R.add("p5_parameters")
def p5_parameters(spark, d):
    """The flat table of all parameters, with typed columns."""
    return nested.schema_parameters(table(spark, d, "tool_catalog"), "tool_id", "parameters")


@R.add("p5_records")
def p5_records(spark, d):
    """The rows of the flat tables of all schema paths, linked to the rows around them."""
    return nested.records(table(spark, d, "tool_catalog"), "tool_id", "parameters")
