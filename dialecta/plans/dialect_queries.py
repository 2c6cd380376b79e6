"""The same questions in the words of nine dialects, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialecta.registry import query
from dialecta.sqlfront.front import run
from dialecta.tables import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(spark: SparkSession, d: str) -> SparkSession:
    """The data directory's tables as views of the session."""
    for t in TABLES:
        read_table(spark, d, t).createOrReplaceTempView(t)
    return spark


def _dialect(name: str, source: str, text: str, twin: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return run(with_views(spark, d), text, source)

    f.__name__ = name
    f.__doc__ = f"{source}: {text}"
    query(twin)(f)


FLAGSHIP = """SELECT n_name, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
QUALIFY ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) <= 3"""

_dialect("snowflake_qualify", "snowflake", FLAGSHIP, FLAGSHIP)
_dialect("snowflake_qualify_alias", "snowflake", "SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer QUALIFY rk = 1",
         "SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer QUALIFY rk = 1")
_dialect("snowflake_functions", "snowflake", "SELECT c_custkey, IFF(c_acctbal > 0, 'plus', 'minus') AS sgn, ZEROIFNULL(NULLIF(c_nationkey, 3)) AS z, NVL2(NULLIF(c_nationkey, 4), 'y', 'n') AS v, c_acctbal::INT AS whole FROM customer",
         "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS sgn, coalesce(nullif(c_nationkey, 3), 0) AS z, CASE WHEN nullif(c_nationkey, 4) IS NOT NULL THEN 'y' ELSE 'n' END AS v, trunc(c_acctbal)::INT AS whole FROM customer")
_dialect("snowflake_null_order", "snowflake", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderstatus, 'F'), o_orderkey) AS rn FROM orders",
         "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') NULLS LAST, o_orderkey) AS rn FROM orders")
_dialect("snowflake_datediff", "snowflake", "SELECT o_orderkey, DATEDIFF('month', '1992-01-31'::DATE, o_orderdate) AS m, DATEDIFF(year, '1992-12-31'::DATE, o_orderdate) AS y, DATEADD('day', 10, o_orderdate)::DATE AS later FROM orders",
         "SELECT o_orderkey, date_diff('month', DATE '1992-01-31', o_orderdate) AS m, date_diff('year', DATE '1992-12-31', o_orderdate) AS y, (o_orderdate + INTERVAL 10 DAY)::DATE AS later FROM orders")
_dialect("snowflake_greatest", "snowflake", "SELECT p_partkey, GREATEST(p_size, NULLIF(p_size, 10), 5) AS g FROM part",
         "SELECT p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE greatest(p_size, 5) END AS g FROM part")
_dialect("tsql_top", "sqlserver", "SELECT TOP (25) [o_orderkey], [o_totalprice] FROM [orders] WITH (NOLOCK) ORDER BY [o_totalprice] DESC, [o_orderkey]",
         "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_dialect("tsql_strings", "synapse", "SELECT c_custkey, c_name + '/' + c_mktsegment AS k, LEN(c_name + '  ') AS n, CHARINDEX('#', c_name) AS at_, ISNULL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, CONCAT(c_mktsegment, NULL, '!') AS bang FROM customer",
         "SELECT c_custkey, c_name || '/' || c_mktsegment AS k, length(rtrim(c_name || '  ')) AS n, instr(c_name, '#') AS at_, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, concat(c_mktsegment, '!') AS bang FROM customer")
_dialect("tsql_dates", "fabric_dw", "SELECT o_orderkey, CONVERT(VARCHAR(8), o_orderdate, 112) AS ymd, DATEPART(month, o_orderdate) AS m, EOMONTH(o_orderdate) AS eom, DATEDIFF(day, '1992-01-01', o_orderdate) AS n FROM orders",
         "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ymd, month(o_orderdate) AS m, last_day(o_orderdate) AS eom, date_diff('day', DATE '1992-01-01', o_orderdate) AS n FROM orders")
_dialect("tsql_int_division", "sqlserver", "SELECT p_partkey, p_size / 7 AS q FROM part", "SELECT p_partkey, p_size // 7 AS q FROM part")
_dialect("tsql_apply", "sqlserver", "SELECT n.n_name, t.o_orderkey FROM nation n CROSS APPLY (SELECT MIN(o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n.n_nationkey) t",
         "SELECT n_name, min(o_orderkey) AS o_orderkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_dialect("tsql_string_split", "sqlserver", "SELECT o.o_orderkey, s.value AS word FROM orders o CROSS APPLY STRING_SPLIT(o.o_orderpriority, '-') s",
         "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word FROM orders")
_dialect("tsql_offset_fetch", "sqlserver", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY",
         "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 10")
_dialect("tsql_recursive", "sqlserver", "WITH n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 20) SELECT i, i * i AS sq FROM n",
         "WITH RECURSIVE n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 20) SELECT i, i * i AS sq FROM n")
_dialect("tsql_week_diff", "sqlserver", "SELECT o_orderkey, DATEDIFF(week, '1992-01-01', o_orderdate) AS w FROM orders",
         "SELECT o_orderkey, date_diff('day', date_trunc('week', DATE '1992-01-02'), date_trunc('week', o_orderdate + INTERVAL 1 DAY)) // 7 AS w FROM orders")
_dialect("redshift_listagg", "redshift", "SELECT n_regionkey, LISTAGG(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY 1",
         "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
_dialect("redshift_functions", "redshift", "SELECT p_partkey, NVL(NULLIF(p_brand, 'Brand#11'), p_type, 'none') AS b, SPLIT_PART(p_type, ' ', 1) AS head, p_retailprice::VARCHAR(4) AS cut, DECODE(p_size, 1, 'one', 2, 'two', 'many') AS d FROM part",
         "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), p_type, 'none') AS b, split_part(p_type, ' ', 1) AS head, left(p_retailprice::VARCHAR, 4) AS cut, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS d FROM part")
_dialect("redshift_quoted", "redshift", 'SELECT "c_custkey", "c_acctbal" AS "Balance" FROM "customer" WHERE "c_mktsegment" = \'BUILDING\'',
         'SELECT c_custkey, c_acctbal AS "Balance" FROM customer WHERE c_mktsegment = \'BUILDING\'')
_dialect("redshift_similar", "redshift", "SELECT p_partkey FROM part WHERE p_type SIMILAR TO '%(PROMO|SMALL)%'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^(.*(PROMO|SMALL).*)$')")
_dialect("redshift_minus", "oracle", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
         "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
_dialect("oracle_rownum_dates", "oracle", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'YYYY-MM-DD') AS d, TRUNC(o_orderdate, 'MM') AS m, MONTHS_BETWEEN(o_orderdate, o_orderdate) AS z FROM orders WHERE NVL(o_orderstatus, 'X') = 'F'",
         "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, date_trunc('month', o_orderdate) AS m, 0.0::DOUBLE AS z FROM orders WHERE o_orderstatus = 'F'")
_dialect("oracle_connect_by", "oracle", "SELECT n_nationkey, LEVEL AS depth FROM nation START WITH n_nationkey = 1 CONNECT BY PRIOR n_nationkey = n_nationkey - 5",
         "WITH RECURSIVE t AS (SELECT n_nationkey, 1 AS depth FROM nation WHERE n_nationkey = 1 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN t ON n.n_nationkey - 5 = t.n_nationkey) SELECT n_nationkey, depth FROM t")
_dialect("oracle_dual", "oracle", "SELECT n_nationkey, k.b, k.c FROM nation CROSS JOIN (SELECT DECODE(2, 1, 'one', 2, 'two') AS b, INSTR('abcabc', 'c') AS c FROM DUAL) k", "SELECT n_nationkey, 'two' AS b, 3 AS c FROM nation")
_dialect("bigquery_functions", "bigquery", "SELECT c_nationkey, COUNTIF(c_acctbal < 0) AS debts, ROUND(SAFE_DIVIDE(SUM(c_acctbal), COUNTIF(c_acctbal < 0)), 4) AS per, STRING_AGG(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS segs FROM `customer` GROUP BY c_nationkey",
         "SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 0) AS debts, round(sum(c_acctbal) / nullif(count(*) FILTER (WHERE c_acctbal < 0), 0), 4) AS per, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY 1")
_dialect("bigquery_dates", "bigquery", "SELECT o_orderkey, DATE_TRUNC(o_orderdate, MONTH) AS m, DATE_DIFF(o_orderdate, DATE '1992-01-15', MONTH) AS n, DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 3 DAY) AS d, FORMAT_DATE('%Y/%m', o_orderdate) AS f FROM orders",
         "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_diff('month', DATE '1992-01-15', o_orderdate) AS n, (o_orderdate + INTERVAL 3 DAY)::DATE AS d, strftime(o_orderdate, '%Y/%m') AS f FROM orders")
_dialect("bigquery_unnest", "bigquery", "SELECT r_name, x FROM region, UNNEST(GENERATE_ARRAY(1, 3)) AS x", "SELECT r_name, x FROM region, (SELECT unnest([1, 2, 3]) AS x)")
_dialect("databricks_native", "databricks", "SELECT c_mktsegment, count_if(c_acctbal > 0) AS n, round(percentile(c_acctbal, 0.5), 4) AS med FROM customer GROUP BY ALL",
         "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) AS n, round(quantile_cont(c_acctbal, 0.5), 4) AS med FROM customer GROUP BY 1")
_dialect("databricks_qualify", "databricks", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1",
         "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1")
_dialect("lakehouse_lateral", "fabric_lakehouse", "SELECT o_orderkey, w FROM orders LATERAL VIEW explode(split(o_orderpriority, '-')) t AS w", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders")
_dialect("tsql_convert_timezone", "redshift", "SELECT o_orderkey, CONVERT_TIMEZONE('UTC', 'Asia/Dubai', o_orderdate) AS local_ FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 4 HOUR AS local_ FROM orders")
_dialect("tsql_rollup", "sqlserver", "SELECT o_orderstatus, COUNT_BIG(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
_dialect("tsql_pivot", "sqlserver", "SELECT l_returnflag, [O] AS o_, [F] AS f_ FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) s PIVOT (SUM(l_quantity) FOR l_linestatus IN ([O], [F])) AS p",
         "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o_, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f_ FROM lineitem GROUP BY 1")
_dialect("redshift_ratio", "redshift", "SELECT c_custkey, ROUND(RATIO_TO_REPORT(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM customer",
         "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM customer")
_dialect("redshift_window_ignore_nulls", "redshift", "SELECT o_orderkey, LAST_VALUE(NULLIF(o_orderstatus, 'O') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_done FROM orders",
         "SELECT o_orderkey, last_value(nullif(o_orderstatus, 'O') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_done FROM orders")
_dialect("redshift_recursive", "redshift", "WITH RECURSIVE d(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM d WHERE n < 12) SELECT n, COUNT(o_orderkey) AS orders FROM d LEFT JOIN orders ON EXTRACT(month FROM o_orderdate) = n GROUP BY n",
         "WITH RECURSIVE d(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM d WHERE n < 12) SELECT n, count(o_orderkey) AS orders FROM d LEFT JOIN orders ON month(o_orderdate) = n GROUP BY n")
_dialect("redshift_fnv", "redshift", "SELECT c_custkey, FNV_HASH(c_name) AS h FROM customer",
         """SELECT c_custkey, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS h
FROM (SELECT c_custkey, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM customer)""")  # fmt: skip
_dialect("snowflake_variant", "snowflake", "SELECT e.event_id, PARSE_JSON(e.props):k::INT AS k, e.value::INT AS v FROM events e", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, trunc(value)::INT AS v FROM events")
_dialect("redshift_json", "redshift", "SELECT event_id, JSON_EXTRACT_PATH_TEXT(props, 'k') AS k FROM events WHERE event_type ILIKE 'CLICK'", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type ILIKE 'CLICK'")
_dialect("redshift_not_in", "redshift", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s_nationkey)",
         "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
_dialect("tsql_case_expression", "synapse", "SELECT o.[o_orderkey], CASE WHEN DATEDIFF(hour, o.[o_orderdate], DATEADD(day, 2, o.[o_orderdate])) = 48 THEN N'two' ELSE N'other' END AS k, TRY_CAST('x' AS INT) AS bad, IIF(o.o_totalprice > 100000, 1, 0) AS big FROM [orders] AS o",
         "SELECT o_orderkey, 'two' AS k, NULL::INT AS bad, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS big FROM orders")
_dialect("oracle_fetch_first", "oracle", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey FETCH FIRST 7 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
_dialect("bigquery_star_except", "bigquery", "SELECT * EXCEPT (c_acctbal, c_name) FROM customer WHERE c_mktsegment IN (\"BUILDING\", \"MACHINERY\")", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_dialect("snowflake_union_minus", "snowflake", "SELECT n_nationkey FROM nation MINUS (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000 UNION SELECT 3)", "SELECT n_nationkey FROM nation EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000 UNION SELECT 3)")


# --- forms that need more than a new name

_dialect("tsql_eomonth_shift", "sqlserver", "SELECT o_orderkey, EOMONTH(o_orderdate, 2) AS eom, EOMONTH(o_orderdate, -1) AS before_ FROM orders",
         "SELECT o_orderkey, last_day(o_orderdate + INTERVAL 2 MONTH) AS eom, last_day(o_orderdate - INTERVAL 1 MONTH) AS before_ FROM orders")
_dialect("snowflake_flatten", "snowflake", "SELECT o.o_orderkey, f.value::STRING AS word FROM orders o, LATERAL FLATTEN(INPUT => SPLIT(o.o_orderpriority, '-')) f",
         "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word FROM orders")
_dialect("tsql_unpivot", "sqlserver", "SELECT u.c_custkey, u.what, u.amount FROM (SELECT c_custkey, c_acctbal AS balance, c_acctbal * 2 AS twice FROM customer) s UNPIVOT (amount FOR what IN (balance, twice)) u",
         "SELECT c_custkey, 'balance' AS what, c_acctbal AS amount FROM customer UNION ALL SELECT c_custkey, 'twice', c_acctbal * 2 FROM customer")
_dialect("snowflake_count_distinct_over", "snowflake", "SELECT c_custkey, COUNT(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS n FROM customer",
         "SELECT c_custkey, n FROM customer JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) g USING (c_nationkey)")
_dialect("bigquery_array_agg", "bigquery", "SELECT c_nationkey, ARRAY_AGG(NULLIF(c_mktsegment, 'BUILDING') IGNORE NULLS ORDER BY c_custkey DESC) AS segs FROM customer GROUP BY c_nationkey",
         "SELECT c_nationkey, coalesce(list(c_mktsegment ORDER BY c_custkey DESC) FILTER (WHERE c_mktsegment <> 'BUILDING'), []) AS segs FROM customer GROUP BY 1")
_dialect("tsql_top_percent", "sqlserver", "SELECT TOP (3) PERCENT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
         "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT (SELECT ceil(count(*) * 0.03)::BIGINT FROM customer)")
_dialect("tsql_like_class", "sqlserver", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '[PS]%' AND p_brand NOT LIKE '%[^1-3]'",
         "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[PS]') AND NOT regexp_matches(p_brand, '[^1-3]$')")
_dialect("oracle_empty_string", "oracle", "SELECT c_custkey, NVL('', c_name) AS a, CASE WHEN '' IS NULL THEN 1 ELSE 0 END AS b, c_name || '' AS c FROM customer",
         "SELECT c_custkey, c_name AS a, 1 AS b, c_name AS c FROM customer")
_dialect("tsql_at_time_zone", "sqlserver", "SELECT o_orderkey, o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'Arabian Standard Time' AS dubai FROM orders",
         "SELECT o_orderkey, o_orderdate + INTERVAL 4 HOUR AS dubai FROM orders")
_dialect("oracle_rownum_before_order", "oracle", "SELECT n_nationkey FROM nation n WHERE n.n_nationkey > 3 AND ROWNUM <= 100 ORDER BY n_nationkey DESC",
         "SELECT n_nationkey FROM nation WHERE n_nationkey > 3 ORDER BY 1 DESC")
_dialect("tsql_outer_apply", "sqlserver", "SELECT c.c_custkey, t.top_price FROM customer c OUTER APPLY (SELECT MAX(o.o_totalprice) AS top_price FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') t",
         "SELECT c_custkey, max(o_totalprice) AS top_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
_dialect("join_using", "snowflake", "SELECT k, a.c_name, b.n FROM (SELECT c_custkey AS k, c_name FROM customer) a JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) b USING (k)",
         "SELECT c_custkey AS k, c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
_dialect("join_natural", "redshift", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b",
         "SELECT n_nationkey AS k, n_name AS x, s_name AS y FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_dialect("tsql_count_big", "synapse", "SELECT c_mktsegment, COUNT_BIG(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1")
_dialect("redshift_alias_reuse", "redshift", "SELECT c_custkey, c_acctbal * 2 AS twice, twice + 1 AS more FROM customer", "SELECT c_custkey, c_acctbal * 2 AS twice, c_acctbal * 2 + 1 AS more FROM customer")
_dialect("oracle_listagg_distinct", "oracle", "SELECT c_nationkey, LISTAGG(DISTINCT c_mktsegment, ';') WITHIN GROUP (ORDER BY c_mktsegment) AS segs FROM customer GROUP BY c_nationkey",
         "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY 1")
