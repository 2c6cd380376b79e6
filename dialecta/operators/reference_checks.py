"""Queries over the catalog: references to tables that are not there (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialecta.operators import orphans
from dialecta.registry import query
from dialecta.tables import read_table

_ORPHANS_SQL = r"""
WITH t AS (SELECT DISTINCT table_id, database_name AS db, schema_name, name, registered_at, dropped_at FROM ir_tables),
b AS (SELECT DISTINCT fk_id, table_id, declared_at, ref_table, ref_schema FROM ir_foreign_keys),
p AS (SELECT *, string_split(regexp_replace(ref_table, '[\[\]"`]', '', 'g'), '.') AS x FROM b),
k AS (SELECT p.fk_id, p.table_id, p.declared_at, t.db,
        nullif(lower(trim(x[-1])), '') AS n,
        coalesce(CASE WHEN len(x) > 1 THEN nullif(lower(trim(x[-2])), '') END,
                 nullif(lower(trim(regexp_replace(ref_schema, '[\[\]"`]', '', 'g'))), ''),
                 nullif(lower(trim(regexp_replace(t.schema_name, '[\[\]"`]', '', 'g'))), '')) AS s
      FROM p LEFT JOIN t USING (table_id)),
c AS (SELECT db, nullif(lower(trim(schema_name)), '') AS s, lower(trim(name)) AS n, registered_at, dropped_at FROM t),
m AS (SELECT k.fk_id, c.registered_at, c.dropped_at FROM k JOIN c ON k.db = c.db AND k.s IS NOT DISTINCT FROM c.s AND k.n = c.n
      UNION ALL
      SELECT k.fk_id, h.registered_at, h.dropped_at FROM k JOIN shared_tables h ON lower(h.schema_name) = k.s AND lower(h.name) = k.n),
g AS (SELECT k.fk_id, any_value(k.table_id) AS table_id, any_value(k.declared_at) AS declared_at,
        count(m.fk_id) AS n_known,
        coalesce(bool_or(m.registered_at <= k.declared_at AND (m.dropped_at IS NULL OR m.dropped_at > k.declared_at)), false) AS existed,
        coalesce(bool_or(m.fk_id IS NOT NULL AND m.dropped_at IS NULL), false) AS alive
      FROM k LEFT JOIN m ON k.fk_id = m.fk_id GROUP BY k.fk_id),
f AS (SELECT *, CASE WHEN n_known = 0 THEN 'missing' WHEN NOT existed THEN 'late' ELSE 'dropped' END AS reason
      FROM g WHERE NOT (existed AND alive))
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(read_table(spark, d, t) for t in ("ir_foreign_keys", "ir_tables", "shared_tables")))


@query(_ORPHANS_SQL + "SELECT fk_id FROM f")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("fk_id")


@query(_ORPHANS_SQL + "SELECT table_id, strftime(declared_at, '%Y-%m') AS period, reason, count(*) AS n_orphans FROM f GROUP BY ALL")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))
