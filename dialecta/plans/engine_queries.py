"""Queries over the engine's own products: changes of data, catalogs, conversions and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialecta import streaming
from dialecta.plans.dialect_queries import with_views
from dialecta.registry import query
from dialecta.sqlfront import catalog, convert, ddl, dml
from dialecta.sqlfront.front import run
from dialecta.tables import read_table


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 5 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    return dml.changed(with_views(spark, d), "UPDATE supplier SET s_acctbal = ROUND(s_acctbal * 2, 2) WHERE s_nationkey < 5", "sqlserver")[1]


@query("SELECT s.s_suppkey, coalesce(upper(n.n_name), s.s_name) AS s_name, s.s_nationkey, s.s_acctbal FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey = 1")
def dml_update_from(spark: SparkSession, d: str) -> DataFrame:
    return dml.changed(with_views(spark, d), "UPDATE supplier SET s_name = UPPER(n.n_name) FROM nation n WHERE supplier.s_nationkey = n.n_nationkey AND n.n_regionkey = 1", "redshift")[1]


@query("SELECT * FROM customer WHERE NOT (c_acctbal < 0)")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return dml.changed(with_views(spark, d), "DELETE FROM customer WHERE c_acctbal < 0", "snowflake")[1]


_MERGE = """MERGE INTO nation t USING (SELECT n_nationkey + 20 AS k, n_name, n_regionkey FROM nation) s ON t.n_nationkey = s.k
WHEN MATCHED AND s.n_regionkey = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET n_name = s.n_name || '!'
WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name, n_regionkey) VALUES (s.k, s.n_name, s.n_regionkey)"""


@query("""WITH s AS (SELECT n_nationkey + 20 AS k, n_name, n_regionkey FROM nation)
SELECT t.n_nationkey, coalesce(s.n_name || '!', t.n_name) AS n_name, t.n_regionkey FROM nation t LEFT JOIN s ON t.n_nationkey = s.k WHERE s.k IS NULL OR s.n_regionkey <> 0
UNION ALL SELECT k, n_name, n_regionkey FROM s WHERE k NOT IN (SELECT n_nationkey FROM nation)""")
def dml_merge(spark: SparkSession, d: str) -> DataFrame:
    return dml.changed(with_views(spark, d), _MERGE, "snowflake")[1]


@query("SELECT * FROM region UNION ALL SELECT 10 + n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    return dml.changed(with_views(spark, d), "INSERT INTO region (r_regionkey, r_name) SELECT 10 + n_nationkey, n_name FROM nation WHERE n_regionkey = 2", "oracle")[1]


_ORDERS_DDL = """CREATE TABLE orders (o_orderkey BIGINT NOT NULL PRIMARY KEY, o_custkey BIGINT REFERENCES customer(c_custkey), o_totalprice DECIMAL(12,2) NOT NULL,
o_orderstatus CHAR(1) CHECK (o_orderstatus IN ('O', 'F')), UNIQUE (o_custkey, o_orderdate)) DISTKEY(o_custkey) SORTKEY(o_orderdate)"""


@query("""SELECT * FROM (VALUES ('not_null(o_orderkey)'), ('not_null(o_totalprice)')) v("constraint") CROSS JOIN (SELECT 0 AS n_violations)
UNION ALL SELECT 'primary_key(o_orderkey)', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'unique(o_custkey, o_orderdate)', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
UNION ALL SELECT 'foreign_key(o_custkey)', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'check(o_orderstatus)', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def ddl_constraints(spark: SparkSession, d: str) -> DataFrame:
    spec = ddl.parse_script(_ORDERS_DDL, "redshift")[0][1]
    return catalog.violations(with_views(spark, d), spec, read_table(spark, d, "orders"))


def convert_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every stored script to all dialects, to its own target with the schema and text length it asks for, on the executors."""
    columns = dict(target_col="target_dialect", schema_col="target_schema", length_col="default_text_length")
    return convert.convert_all(read_table(spark, d, "transpile_requests"), "request_id", "sql", "source_dialect", **columns)


query()(convert_requests)


def convert_findings(spark: SparkSession, d: str) -> DataFrame:
    return convert.finding_counts(convert_requests(spark, d))


query()(convert_findings)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = streaming.tumbling(read_table(spark, d, "events"), "ts", "event_type", "value", "1 hour", "2 hours")
    return w.withColumn("total", F.round("total", 4))


@query("""SELECT b AS start, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY 1, 2""")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streaming.sliding(read_table(spark, d, "events"), "ts", "event_type", "1 hour", "30 minutes", "2 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    return streaming.sessions(read_table(spark, d, "events"), "ts", "user_id", "6 hours", "1 day")


@query("SELECT c_custkey, upper(left(c_mktsegment, 3)) || (c_nationkey + 1)::VARCHAR AS code FROM customer")
def python_function(spark: SparkSession, d: str) -> DataFrame:
    """A scalar function declared with a Python body, called from SQL."""
    text = "CREATE FUNCTION code_of(s VARCHAR, k INT) RETURNS VARCHAR IMMUTABLE AS $$\n  return s[:3].upper() + str(k + 1)\n$$ LANGUAGE plpythonu"
    spec = ddl.parse_script(text, "redshift")[0][1]
    catalog.register_function(with_views(spark, d), spec, "redshift")
    return run(spark, "SELECT c_custkey, code_of(c_mktsegment, c_nationkey) AS code FROM customer", "redshift")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE upper(c_mktsegment) END AS label FROM customer")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    """A scalar function declared in T-SQL, called from T-SQL."""
    spec = ddl.parse_script("CREATE FUNCTION label_of(@b FLOAT, @s VARCHAR(20)) RETURNS VARCHAR(20) AS BEGIN RETURN CASE WHEN @b < 0 THEN 'debt' ELSE UPPER(@s) END END", "sqlserver")[0][1]
    catalog.register_function(with_views(spark, d), spec, "sqlserver")
    return run(spark, "SELECT c_custkey, label_of(c_acctbal, c_mktsegment) AS label FROM customer", "sqlserver")
