"""DDL applied to a Spark session, and declared constraints as queries."""

from __future__ import annotations

import inspect
import re
import textwrap
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialecta.sqlfront.ddl import RoutineSpec, TableSpec, TriggerSpec, ViewSpec, parse_script
from dialecta.sqlfront.dialects import dialect
from dialecta.sqlfront.front import Finding, run, to_spark_sql
from dialecta.sqlfront.types import parse_type, to_spark

_FINDING = "object string, code string, severity string, message string"


def apply_ddl(spark: SparkSession, sql: str, source: str, location: str) -> DataFrame:
    """Creates the script's tables as parquet under ``location`` with a view each, and its views; returns findings.

    Partition columns partition the files; a CREATE TABLE AS runs its query with the source's meaning.
    """
    out: list[tuple[str, str, str, str]] = []
    for s, spec, notes in parse_script(sql, source):
        label = spec.name[-1] if spec is not None and spec.name else s.kind
        out += [(label, f.code, f.severity, f.message) for f in notes]
        if isinstance(spec, TableSpec):
            path = f"{location}/{'.'.join(spec.name)}"
            df = run(spark, spec.query, source) if spec.query else spark.createDataFrame([], spec.schema())
            parts = [c for c in spec.partition_by if c in df.columns]
            df.write.mode("overwrite" if spec.or_replace else "error").partitionBy(*parts).parquet(path)
            spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(label)
        elif isinstance(spec, ViewSpec) and spec.materialized:
            refresh(spark, spec, source, location)
        elif isinstance(spec, ViewSpec):
            text, findings = to_spark_sql(spec.query, source)
            out += [(label, f.code, f.severity, f.message) for f in findings]
            view = spark.sql(text)
            (view.toDF(*spec.columns) if spec.columns else view).createOrReplaceTempView(label)
        elif isinstance(spec, TriggerSpec):
            out.append((label, "TRIGGER_UNSUPPORTED", "error", "there are no triggers"))
        elif isinstance(spec, RoutineSpec):
            made = spec.kind == "function" and register_function(spark, spec, source)
            if not made:
                out.append((label, f"{spec.kind.upper()}_UNSUPPORTED", "error", "routine bodies are not executed"))
    return spark.createDataFrame(out, _FINDING)


def refresh(spark: SparkSession, spec: ViewSpec, source: str, location: str) -> DataFrame:
    """(Re)builds a materialized view: its query's result as parquet, swapped in as a view of its name."""
    import uuid

    df = run(spark, spec.query, source)
    df = df.toDF(*spec.columns) if spec.columns else df
    path = f"{location}/{'.'.join(spec.name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fresh = spark.read.schema(df.schema).parquet(path)
    fresh.createOrReplaceTempView(spec.name[-1])
    return fresh


def register_function(spark: SparkSession, spec: RoutineSpec, source: str) -> bool:
    """A scalar SQL function whose body is one expression or query, as a temporary SQL function; False for others."""
    d = dialect(source)
    if (spec.language or "").lower() in ("python", "plpythonu", "plpython3u"):
        return _register_python(spark, spec, source)
    if (spec.language or "sql").lower() not in ("sql", "plpgsql") or re.search(r"(?i)\b(declare|loop|if\s+.*then|while|insert|update|delete)\b", spec.body):
        return False
    m = re.match(r"(?is)^\s*(?:begin\s+)?(?:return\s+)?(.+?)\s*;?\s*(?:end\s*;?)?\s*$", spec.body)
    if not m:
        return False
    body = m.group(1)
    params = []
    for p in filter(None, (x.strip() for x in re.split(r",(?![^(]*\))", spec.parameters))):
        word, _, kind = p.partition(" ")
        clean = re.sub(r"(?i)^in\s+", "", kind.strip())
        params.append(f"{word.lstrip('@')} {to_spark(parse_type(clean, d)).simpleString()}")
        body = body.replace(word, word.lstrip("@"))
    is_query = re.match(r"(?i)\s*(select|with)\b", body)
    text = to_spark_sql(body if is_query else f"select {body}", source)[0]
    expression = f"({text})" if is_query else text[len("SELECT") :].strip()
    returns = re.sub(r"(?i)\s+(deterministic|immutable|stable|volatile)\s*$", "", spec.returns or "")
    if returns.lower().startswith("table"):
        columns = re.sub(r"(?i)^table\s*", "", returns).strip("() ")
        shape = f"TABLE ({', '.join(f'{c.split()[0]} {to_spark(parse_type(c.split(maxsplit=1)[1], d)).simpleString()}' for c in re.split(r',(?![^(]*[)])', columns))})"
        expression = text
    else:
        shape = to_spark(parse_type(returns, d)).simpleString()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {spec.name[-1]}({', '.join(params)}) RETURNS {shape} RETURN {expression}")
    return True


def _parameters(spec: RoutineSpec, source: str) -> list[tuple[str, T.DataType]]:
    out = []
    for p in filter(None, (x.strip() for x in re.split(r",(?![^(]*\))", spec.parameters))):
        word, _, kind = p.partition(" ")
        out.append((word.lstrip("@"), to_spark(parse_type(re.sub(r"(?i)^in\s+", "", kind.strip()), dialect(source)))))
    return out


def _register_python(spark: SparkSession, spec: RoutineSpec, source: str) -> bool:
    """A scalar function in Python, run over Arrow batches: a body of statements, or one that defines its handler last.

    Nulls are passed as None. The code is the script's own; whoever registers it runs it.
    """
    params = _parameters(spec, source)
    body = inspect.cleandoc(spec.body)
    defined = re.findall(r"(?m)^def\s+(\w+)", body)
    code = body if defined else f"def handler({', '.join(n for n, _ in params)}):\n" + textwrap.indent(body.strip(), "    ")
    name, whole = defined[-1] if defined else "handler", [isinstance(t, T.IntegralType) for _, t in params]

    def run(*columns: pd.Series) -> pd.Series:
        scope: dict = {}
        exec(code, scope)  # noqa: S102 - the function's declared body
        plain = lambda v, w: None if v is None or v != v else int(v) if w else v
        return pd.Series([scope[name](*(plain(v, w) for v, w in zip(row, whole))) for row in zip(*columns)], dtype=object)

    returns = to_spark(parse_type(re.sub(r"(?i)\s+(deterministic|immutable|stable|volatile)\s*$", "", spec.returns or ""), dialect(source)))
    spark.udf.register(spec.name[-1], F.pandas_udf(run, returns))
    return True


def violations(spark: SparkSession, spec: TableSpec, data: DataFrame) -> DataFrame:
    """(constraint, n_violations) of every declared constraint over the data: one scan for all NOT NULL and CHECK, one aggregate or anti join for each other."""
    found: list[DataFrame] = []
    per_row = [(f"not_null({c.name})", F.col(c.name).isNull()) for c in spec.columns if not c.nullable]
    per_row += [(f"check({', '.join(k.columns) or k.expression})", F.expr(f"not coalesce({k.expression}, true)")) for k in spec.constraints if k.kind == "check"]
    if per_row:
        counts = data.agg(*(F.count_if(broken).alias(f"c{i}") for i, (_, broken) in enumerate(per_row)))
        found.append(counts.select(F.inline(F.array(*(F.struct(F.lit(label).alias("constraint"), F.col(f"c{i}").alias("n_violations")) for i, (label, _) in enumerate(per_row))))))

    def add(label: str, df: DataFrame) -> None:
        found.append(df.agg(F.count("*").alias("n_violations")).select(F.lit(label).alias("constraint"), "n_violations"))

    for k in spec.constraints:
        label = f"{k.kind}({', '.join(k.columns) or k.expression})"
        if k.kind in ("primary_key", "unique"):
            full = data.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in k.columns)))
            add(label, full.groupBy(*k.columns).agg(F.count("*").alias("n")).where("n > 1"))
        elif k.kind == "foreign_key" and k.ref_table and spark.catalog.tableExists(k.ref_table[-1]):
            ref = spark.table(k.ref_table[-1]).select(*(F.col(r).alias(f"__{i}") for i, r in enumerate(k.ref_columns or k.columns))).distinct()
            on = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(k.columns)]
            full = data.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in k.columns)))
            add(label, full.join(ref, on, "left_anti"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "constraint string, n_violations long")


def findings_table(spark: SparkSession, findings: list[Finding], label: str) -> DataFrame:
    return spark.createDataFrame([(label, f.code, f.severity, f.message) for f in findings], _FINDING)
