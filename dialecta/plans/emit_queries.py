"""Round trips of the emitter: a question in one dialect, said in each of the nine, read back and run.

Each has one twin in DuckDB, so a target's wording is right where its result is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialecta.plans.dialect_queries import with_views
from dialecta.registry import query
from dialecta.sqlfront.dialects import DIALECTS
from dialecta.sqlfront.front import run
from dialecta.sqlfront.speak import query_text

#: name -> (source dialect, question, DuckDB's question)
QUESTIONS = {
    "top": (
        "sqlserver", "SELECT TOP 5 c_custkey, c_name + ' top 5 of ''x'' limit 1' AS k FROM (SELECT TOP (50) * FROM customer ORDER BY c_custkey) c ORDER BY c_acctbal DESC, c_custkey",
        "SELECT c_custkey, c_name || ' top 5 of ''x'' limit 1' AS k FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
    ),
    "functions": (
        "snowflake",
        "SELECT c_custkey, IFF(c_acctbal > 0, 'plus', 'minus') AS sgn, ZEROIFNULL(NULLIF(c_nationkey, 3)) AS z, NVL2(NULLIF(c_nationkey, 4), 'y', 'n') AS v, DECODE(c_mktsegment, 'BUILDING', 'a minus b', 'MACHINERY', 'x nulls first', 'none') AS d, CHARINDEX('#', c_name) AS p, SUBSTR(c_name, 2, 3) AS s, LENGTH(c_name) AS n, NVL(NULLIF(c_mktsegment, 'FURNITURE'), '?') AS m, CEIL(c_acctbal) AS up FROM customer",
        "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS sgn, coalesce(nullif(c_nationkey, 3), 0) AS z, CASE WHEN nullif(c_nationkey, 4) IS NOT NULL THEN 'y' ELSE 'n' END AS v, CASE c_mktsegment WHEN 'BUILDING' THEN 'a minus b' WHEN 'MACHINERY' THEN 'x nulls first' ELSE 'none' END AS d, instr(c_name, '#') AS p, substr(c_name, 2, 3) AS s, length(c_name) AS n, coalesce(nullif(c_mktsegment, 'FURNITURE'), '?') AS m, ceil(c_acctbal)::BIGINT AS up FROM customer",
    ),
    "dates": (
        "redshift",
        "SELECT o_orderkey, TO_CHAR(DATEADD(month, 2, o_orderdate), 'YYYY-MM-DD') AS later, TO_CHAR(DATEADD(day, 3, o_orderdate), 'YYYY-MM-DD') AS soon, DATEDIFF(month, '1992-01-31'::DATE, o_orderdate) AS m, DATEDIFF(year, '1992-12-31'::DATE, o_orderdate) AS yy, TO_CHAR(DATE_TRUNC('month', o_orderdate), 'YYYY/MM/DD') AS mon, TO_CHAR(LAST_DAY(o_orderdate), 'DD.MM.YYYY') AS eom, EXTRACT(year FROM o_orderdate) AS y, DATE_PART(month, o_orderdate) AS mm, TO_CHAR(o_orderdate, 'YYYY-MM-DD') AS iso FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS later, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS soon, date_diff('month', DATE '1992-01-31', o_orderdate) AS m, date_diff('year', DATE '1992-12-31', o_orderdate) AS yy, strftime(date_trunc('month', o_orderdate), '%Y/%m/%d') AS mon, strftime(last_day(o_orderdate), '%d.%m.%Y') AS eom, year(o_orderdate) AS y, month(o_orderdate) AS mm, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    ),
    "listagg": (
        "redshift", "SELECT c_nationkey, LISTAGG(c_mktsegment, ', ') WITHIN GROUP (ORDER BY c_custkey) AS l, COUNT(DISTINCT c_mktsegment) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 2",
        "SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY c_custkey) AS l, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1 HAVING count(*) > 2",
    ),
    "qualify": (
        "snowflake", "SELECT c_nationkey, c_custkey AS id FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2",
        "SELECT c_nationkey, c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2",
    ),
    "sets": (
        "oracle", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000 UNION SELECT 77 FROM dual ORDER BY k",
        "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000 UNION SELECT 77",
    ),
    "zones": ("redshift", "SELECT o_orderkey, CONVERT_TIMEZONE('UTC', 'Asia/Dubai', o_orderdate) AS t FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 4 HOUR AS t FROM orders"),
    "recursive": (
        "sqlserver", "WITH n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 9) SELECT i, COUNT(r_regionkey) AS regions FROM n LEFT JOIN region ON r_regionkey < i GROUP BY i",
        "WITH RECURSIVE n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 9) SELECT i, count(r_regionkey) AS regions FROM n LEFT JOIN region ON r_regionkey < i GROUP BY i",
    ),
}


def _register(name: str, target: str) -> None:
    source, text, twin = QUESTIONS[name]

    def f(spark: SparkSession, d: str) -> DataFrame:
        return run(with_views(spark, d), query_text(text, source, target)[0], target)

    f.__name__ = f"emit_{target}_{name}"
    f.__doc__ = f"{source} to {target}: {text}"
    query(twin)(f)


for _target in DIALECTS:
    for _name in QUESTIONS:
        _register(_name, _target)
