"""Reading and writing scripts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, sql) of SQL files, each file one row."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("sql"))


def write_scripts(df: DataFrame, path: str, kind_col: str, sql_col: str) -> None:
    """Texts to files, one folder per kind of object."""
    df.select(F.col(kind_col).alias("object_type"), F.col(sql_col).alias("value")).write.mode("overwrite").partitionBy("object_type").text(path)


def read_data(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Data of a built-in format: parquet, orc, csv, json or text. A schema spares the inference pass."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def write_data(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Data to a built-in format. ``partition_by`` columns are brought together first, so each folder gets few files;
    ``sort_by`` sorts within files for statistics-based skipping."""
    out = df.repartition(*partition_by) if partition_by else df
    out = out.sortWithinPartitions(*(partition_by or []), *(sort_by or [])) if sort_by else out
    w = out.write.mode(mode).format(kind)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
