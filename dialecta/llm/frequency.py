"""Problem 1: frequency of every distinct value or term.

(term, record, delivery) triples are range-partitioned and sorted with spill
(an external sort over the cluster); every partition is scanned once for runs,
which gives occurrences and distinct records without any hash table of terms.
A term that holds a third of all rows spreads over many ranges, as the record
is part of the key; the few runs cut by a range border are joined afterwards.

The total number of records comes from the same scan: every row also emits the
term of the pseudo field ``*``.

Defined results: null and blank values are no terms, but their rows count for
the total; null record ids count as occurrences, never as records; a row
delivered twice (same delivery id) counts once, rows without delivery id count
one each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialecta.tables import shipped, written

_RUNS = "part int, field string, term string, lo long, hi long, lo_row long, hi_row long, n_rows long, n_records long"
_SCHEMA = pa.schema([("part", pa.int32()), ("field", pa.string()), ("term", pa.string())] + [(c, pa.int64()) for c in ("lo", "hi", "lo_row", "hi_row", "n_rows", "n_records")])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (part, field, term, rec, row): one line per term and partition."""
    run: dict | None = None
    last: tuple | None = None
    out = []
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        part, field, term = b.column(0)[0].as_py(), b.column(1), b.column(2)
        rec, row = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
        same = lambda c: pc.equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_term = np.concatenate(([True], ~(same(field) & same(term)))) if n > 1 else np.array([True])
        new_rec = np.concatenate(([True], rec[1:] != rec[:-1])) | new_term
        new_row = np.concatenate(([True], row[1:] != row[:-1])) | new_rec
        starts = np.flatnonzero(new_term)
        ends = np.append(starts[1:], n)
        for s, e in zip(starts.tolist(), ends.tolist()):
            key = field[s].as_py(), term[s].as_py()
            rows, recs = int(new_row[s:e].sum()), int((new_rec[s:e] & (rec[s:e] >= 0)).sum())
            if run is not None and (run["field"], run["term"]) == key:
                if last[0] == rec[s]:  # the run goes on over the border of batches
                    recs -= int(rec[s] >= 0)
                    rows -= int(last[1] == row[s])
            else:
                if run is not None:
                    out.append(run)
                run = {"part": part, "field": key[0], "term": key[1], "lo": int(rec[s]), "lo_row": int(row[s]), "n_rows": 0, "n_records": 0}
            run["n_rows"] += rows
            run["n_records"] += recs
            run["hi"], run["hi_row"] = int(rec[e - 1]), int(row[e - 1])
            last = rec[e - 1], row[e - 1]
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
            out = []
    if run is not None:
        out.append(run)
    if out:
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def term_of(column: str):
    """Upper case without leading and trailing blanks and tabs; null where nothing is left."""
    v = F.upper(F.trim(F.col(column), F.lit(" \t")))
    return F.when(v != "", v)


def frequencies(df: DataFrame, record_col: str, row_col: str, fields: list[str], rare_below: int, common_above: float) -> DataFrame:
    """(field_name, field_value, n_occurrences, n_records, mark) of every term.

    mark is ``rare`` for terms in fewer than ``rare_below`` records, ``common``
    for terms in more than the share ``common_above`` of all records, else null.
    """
    rec = F.coalesce(F.col(record_col).cast("long"), F.lit(-1))
    row = F.coalesce(F.col(row_col).cast("long"), F.monotonically_increasing_id() + F.lit(1 << 60))
    terms = F.array(F.struct(F.lit("*").alias("field"), F.lit("").alias("term")), *(F.struct(F.lit(f).alias("field"), term_of(f).alias("term")) for f in fields))
    triples = (
        shipped(df).select(rec.alias("rec"), row.alias("row"), F.explode(terms).alias("t"))
        .select(F.col("t.field").alias("field"), F.col("t.term").alias("term"), "rec", "row").where("term is not null")
        .repartitionByRange("field", "term", "rec", "row").sortWithinPartitions("field", "term", "rec", "row")
    )
    runs = triples.select(F.spark_partition_id().alias("part"), "field", "term", "rec", "row").mapInArrow(_scan, _RUNS)
    # a record cut by a border between ranges was counted on both sides
    w = Window.partitionBy("field", "term").orderBy("part")
    cut = F.lag("hi").over(w) == F.col("lo")
    joined = runs.withColumn("twice", (cut & (F.col("lo") >= 0)).cast("long"))
    sums = joined.groupBy("field", "term").agg(F.sum("n_rows").alias("n_occurrences"), (F.sum("n_records") - F.coalesce(F.sum("twice"), F.lit(0))).alias("n_records"))
    sums = written(sums, "term-counts")  # one scan of the runs gives the terms and the total
    total = sums.where("field = '*'").agg(F.coalesce(F.max("n_records"), F.lit(0))).first()[0]
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(total * common_above), "common")
    counted = sums.where("field <> '*'")
    return counted.select(F.col("field").alias("field_name"), F.col("term").alias("field_value"), "n_occurrences", "n_records", mark.alias("mark"))
