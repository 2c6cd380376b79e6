"""What a target cannot keep, as a table; and what the service can tell about itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from dialecta.sqlfront.dialects import DIALECTS, SPARKISH, TSQL

#: feature, level, targets, sources (empty: all), words of the script that make it matter (empty: always), what happens.
_KNOWN = (
    ("ROUTINE_BODY", "warn", tuple(DIALECTS), (), ("PROCEDURE", "FUNCTION"), "routine bodies are carried over for review"),
    ("TRIGGER", "error", tuple(x for x in DIALECTS if x not in ("oracle", "sqlserver")), (), ("TRIGGER",), "there are no triggers"),
    ("DISTRIBUTION", "info", tuple(x for x in DIALECTS if x not in ("redshift", "synapse")), ("redshift", "synapse"), ("DISTKEY", "DISTSTYLE", "DISTRIBUTION"), "data distribution is automatic"),
    ("SORT_KEY", "info", tuple(x for x in DIALECTS if x != "redshift"), ("redshift",), ("SORTKEY",), "sort keys become clustering, partitioning, or nothing"),
    ("IDENTITY", "warn", ("fabric_dw", "fabric_lakehouse", "bigquery"), (), ("IDENTITY", "AUTOINCREMENT"), "identity columns are not supported"),
    ("DEFAULT", "warn", ("fabric_dw",), (), ("DEFAULT",), "column defaults are not supported"),
    ("CHECK", "warn", tuple(x for x in DIALECTS if x not in ("oracle", "sqlserver", "databricks")), (), ("CHECK",), "check constraints become validation queries"),
    ("NOT_ENFORCED", "info", ("redshift", "snowflake", "synapse", "fabric_dw", "databricks", "bigquery"), (), ("PRIMARY", "UNIQUE", "FOREIGN", "REFERENCES"), "keys are declared, not enforced"),
    ("QUALIFY", "warn", (*TSQL, "oracle", "redshift"), ("snowflake", "bigquery", "databricks"), ("QUALIFY",), "QUALIFY must become a filter over a subquery"),
    ("CONNECT_BY", "warn", tuple(x for x in DIALECTS if x not in ("oracle", "snowflake")), ("oracle", "snowflake"), ("CONNECT",), "hierarchical queries become recursive ones"),
    ("MATCH_RECOGNIZE", "error", tuple(x for x in DIALECTS if x not in ("oracle", "snowflake")), ("oracle", "snowflake"), ("MATCH_RECOGNIZE",), "row patterns are not supported"),
    ("REGULAR_EXPRESSIONS", "warn", TSQL, (), ("REGEXP_REPLACE", "REGEXP_SUBSTR", "REGEXP_LIKE", "RLIKE"), "there are no regular expressions"),
    ("NULL_ORDER", "info", TSQL, ("redshift", "snowflake", "oracle"), ("NULLS",), "NULLS FIRST and LAST are dropped"),
    ("SEMI_STRUCTURED", "warn", (*TSQL, "oracle"), ("redshift", "snowflake", "bigquery", *SPARKISH), ("VARIANT", "SUPER", "STRUCT", "ARRAY", "MAP"), "nested data is kept as text"),
    ("TIME_ZONE", "warn", ("fabric_dw",), (), ("TIMESTAMPTZ", "TIMESTAMP_TZ", "DATETIMEOFFSET"), "time zones are lost"),
    ("SEQUENCE", "error", tuple(x for x in DIALECTS if x not in ("oracle", "snowflake", "sqlserver")), ("oracle", "snowflake", "sqlserver"), ("NEXTVAL", "SEQUENCE"), "there are no sequences"),
    ("MATERIALIZED_VIEW", "warn", ("fabric_dw", "sqlserver"), (), ("MATERIALIZED",), "materialized views become tables or indexed views"),
    ("CLUSTER_LIMIT", "info", ("fabric_dw", "bigquery"), (), ("CLUSTER", "SORTKEY"), "at most four cluster columns"),
)
_SCHEMA = "target string, feature string, level string, message string, sources array<string>, words array<string>"


def limitations(spark: SparkSession) -> DataFrame:
    """(target, feature, level, message, sources, words): every known limit of every target."""
    rows = [(t, f, level, message, list(sources), list(words)) for f, level, targets, sources, words, message in _KNOWN for t in targets]
    return spark.createDataFrame(rows, _SCHEMA)


def limitations_for(target: str, source: str | None = None, sql: str | None = None) -> list[dict]:
    """Limits of a target that matter for a source and a script."""
    words = set(re.findall(r"\w+", (sql or "").upper()))
    return [
        {"feature": f, "level": level, "message": message}
        for f, level, targets, sources, needed, message in _KNOWN
        if target in targets and (source is None or not sources or source in sources) and (sql is None or not needed or words & set(needed))
    ]


def dialects() -> list[dict]:
    """Every dialect with its way of quoting and ordering."""
    return [{"name": d.name, "quote": d.quote, "nulls": "last" if d.nulls_high else "first"} for d in DIALECTS.values()]
