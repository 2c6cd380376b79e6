"""Queries of the training-data operators, by name: ``pN_...`` belongs to problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialecta.llm import copies, frequency, garbled, lookalike, mixing, near_dup, packing, parse_check
from dialecta.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

SIMILARITY = 0.7  # stated for problem 2

_COLUMN_ENTRY = "transform(columns, c -> concat(coalesce(lower(c.name), ''), '\\u0001', coalesce(c.data_type.generic_type, '')))"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "transpile_requests")


# --- problem 1

RARE_BELOW, COMMON_ABOVE = 5, 0.2  # stated for problem 1


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "warning_details").select("request_id", "warning_id", "feature", "severity")
    return frequency.frequencies(w, "request_id", "warning_id", ["feature", "severity"], RARE_BELOW, COMMON_ABOVE)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequencies(spark, d).where("mark is not null").select("field_name", "field_value")


_P1_SQL = """
WITH w AS (SELECT DISTINCT warning_id, request_id, feature, severity FROM warning_details),
t AS (SELECT 'feature' AS field_name, upper(trim(feature, ' ' || chr(9))) AS field_value, request_id FROM w
      UNION ALL SELECT 'severity', upper(trim(severity, ' ' || chr(9))), request_id FROM w),
c AS (SELECT field_name, field_value, count(*) AS n_occurrences, count(DISTINCT request_id) AS n_records
      FROM t WHERE field_value <> '' GROUP BY 1, 2)
SELECT field_name, field_value, n_occurrences, n_records,
       CASE WHEN n_records < 5 THEN 'rare'
            WHEN n_records > 0.2 * (SELECT count(DISTINCT request_id) FROM warning_details) THEN 'common' END AS mark
FROM c"""


# --- problem 2


def _request_features(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.text_features(_requests(spark, d), "request_id", "sql")


def _table_features(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.entry_features(read_table(spark, d, "ir_tables"), "table_id", F.expr(_COLUMN_ENTRY))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    requests = near_dup.near_duplicate_pairs(_request_features(spark, d), SIMILARITY)
    tables = near_dup.near_duplicate_pairs(_table_features(spark, d), SIMILARITY)
    kind = lambda df, name: df.select(F.lit(name).alias("record_kind"), "id_a", "id_b")
    return kind(requests, "request").unionByName(kind(tables, "ir_table"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    requests = near_dup.near_duplicate_groups(_request_features(spark, d), SIMILARITY)
    tables = near_dup.near_duplicate_groups(_table_features(spark, d), SIMILARITY)
    return requests.withColumn("record_kind", F.lit("request")).unionByName(tables.withColumn("record_kind", F.lit("ir_table")))


# --- problem 4


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_check.unparsable(_requests(spark, d), "request_id", "sql", "source_dialect").select(F.col("rid").alias("request_id"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_check.parse_rates(_requests(spark, d), "request_id", "sql", "source_dialect", "repo")


# --- problem 5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.lookalike_pairs(_requests(spark, d), "request_id", "sql")
    return pairs.select(F.col("id_a").alias("request_id_a"), F.col("id_b").alias("request_id_b"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_table(_requests(spark, d), "request_id", "sql")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(_requests(spark, d), "request_id", "sql")


# --- problem 6


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = copies.copy_groups(_requests(spark, d), "request_id", "sql")
    return rows.select(F.col("id_first").alias("request_id_first"), F.col("id_copy").alias("request_id_copy"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    rows = copies.collapsed(_requests(spark, d), "request_id", "sql")
    return rows.select(F.col("id_first").alias("request_id"), "n_copies")


# --- problem 7


def _capacity(spark: SparkSession, d: str) -> int:
    return read_table(spark, d, "container_specs").orderBy("spec_id").first()["capacity_tokens"]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    rows = packing.packed(read_table(spark, d, "documents"), "doc_id", "text", _capacity(spark, d))
    return rows.select(F.col("rid").alias("doc_id"), "piece_no", F.col("length").alias("n_tokens"), "container_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_containers(spark, d).where("piece_no = 1").select("doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d).withColumnRenamed("n_tokens", "length"), _capacity(spark, d))


# --- problem 8


def _mix_sizes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = read_table(spark, d, "mix_targets")
    return mixing.sized(read_table(spark, d, "documents"), "doc_id", "text", "lang", "source", targets), targets


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix_sizes(spark, d)).where("short").select("source")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix_sizes(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(*_mix_sizes(spark, d)).withColumnRenamed("rid", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _mix_sizes(spark, d)
    return mixing.shares(mixing.mixed(sizes, targets), targets)


# --- problem 9


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    rows = garbled.garbled(read_table(spark, d, "documents"), "doc_id", "text", "lang", "source")
    return rows.select(F.col("rid").alias("doc_id"), "swap", "n_words", "restored", "lost")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_restored(spark, d).select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_frequencies, p2_found, p2_groups, p4_found, p4_rates, p5_found, p5_canonical, p5_classes, p6_found,
        p6_collapsed, p7_found, p7_containers, p7_fill, p8_found, p8_report, p8_mix, p8_shares, p9_found, p9_restored,
    )
}

#: Sizes in SQL are bytes by four: whether a document exceeds a container or a source its share is the same for any usual tokenizer.
_P7_SQL = "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 4 * (SELECT capacity_tokens FROM container_specs ORDER BY spec_id LIMIT 1)"
_P8_SQL = """
WITH s AS (SELECT t.source, any_value(t.target_share) AS share, any_value(t.max_repeats) AS repeats, coalesce(sum(octet_length(encode(d.text))), 0) AS n
           FROM mix_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY t.source)
SELECT source FROM s WHERE repeats * n < share * (SELECT sum(n) FROM s) OR n = 0"""

#: The other queries have no SQL: DuckDB cannot express them; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "p1_frequencies": _P1_SQL,
    "p1_found": f"SELECT field_name, field_value FROM ({_P1_SQL}) WHERE mark IS NOT NULL",
    "p7_found": _P7_SQL,
    "p8_found": _P8_SQL,
}
