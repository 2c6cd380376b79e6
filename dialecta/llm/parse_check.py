"""Problem 4: source files that do not parse.

Every text is cut into chunks of ``sqlgrammar.CHUNK`` characters. A chunk
becomes a map of lexer states with a bracket summary; maps are reduced in order
(composition is associative), first over the chunks that one task holds (a
*run*), then over the runs of a text. With the entry state that the reduction
gives, a run is cut at its statement ends, and the statements are parsed one by
one with local grammars.

A text of up to ``run`` characters is one run, so its reduction ends in the
batch that reads it. The runs of a longer text go to different tasks; their
maps, a few bytes each, are reduced per text. Both go through
``sqlgrammar.Run``, ``statement`` and the rule of ``script_ok``; the verdict
does not depend on ``chunk`` or ``run``.

Defined results: a null text is no case and counts in no rate; an empty or
comment-only text is valid; an unknown or null dialect allows every kind of
quoting; a record delivered twice (same id) counts once; columns beside those
named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from dialecta.llm import sqlgrammar as g
from dialecta.llm.textforms import canonical_glyphs
from dialecta.tables import written

#: Characters of a text that one task maps and reduces.
RUN = 1 << 20

_READ = "rid long, ok boolean, family string, run_no int, run string"
_READ_ARROW = pa.schema([("rid", pa.int64()), ("ok", pa.bool_()), ("family", pa.string()), ("run_no", pa.int32()), ("run", pa.string())])
_MAP = "exits string, ends array<int>, net array<int>, low array<int>"
_MAPPED_ARROW = pa.schema([("rid", pa.int64()), ("run_no", pa.int32()), ("exits", pa.string())] + [(n, pa.list_(pa.int32())) for n in ("ends", "net", "low")])


def _read(chunk: int, run: int):
    """Verdicts on texts of one run; the runs of longer texts as they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, text, dialect in zip(*(c.to_pylist() for c in b.columns)):
                family, shown = g.family_of(dialect), canonical_glyphs(text)
                runs = g.chunks(shown, run)
                if len(runs) < 2:
                    r = g.Run(shown, family, True, chunk)
                    ok = g.closed(r.map) and g.script_ok([g.statement(p, family) for p in r.pieces()])
                    rows.append({"rid": rid, "ok": ok})
                    continue
                for i, part in enumerate(runs):
                    yield pa.RecordBatch.from_pylist([{"rid": rid, "family": family, "run_no": i, "run": part}], _READ_ARROW)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)

    return read


def _maps(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"rid": i, "run_no": k} | g.Run(t, f, k == 0, chunk).map for i, k, f, t in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _MAPPED_ARROW)

    return run


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry state and first statement number of each run of one text, from the maps of its runs."""
    pdf = pdf.sort_values("run_no")
    done = g.identity("C")
    entry, first = [], []
    for m in pdf[["exits", "ends", "net", "low"]].to_dict("records"):
        entry.append(done["exits"][0])
        first.append(int(done["ends"][0]))
        done = g.compose(done, m) if len(entry) > 1 else m
    return pd.DataFrame({"rid": pdf["rid"], "run_no": pdf["run_no"], "entry": entry, "first": first, "balanced": g.closed(done)})


def _statement_pieces(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                pieces = g.Run(r.run, r.family, r.run_no == 0, chunk).pieces(r.entry)
                out += [(r.rid, r.family, r.balanced, r.first + k, r.run_no, p) for k, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["rid", "family", "balanced", "stmt_no", "run_no", "piece"])

    return run


@F.pandas_udf(StructType([StructField(n, IntegerType() if n == "blocks" else BooleanType()) for n in g.Judged._fields]))
def _statement(text: pd.Series, family: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([g.statement(t, f) for t, f in zip(text, family)], columns=list(g.Judged._fields))


def parse_verdicts(df: DataFrame, id_col: str, text_col: str, dialect_col: str, chunk: int = g.CHUNK, run: int = RUN) -> DataFrame:
    """(rid, ok): whether each record's text can be parsed in its dialect."""
    base = df.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("txt"), F.col(dialect_col).alias("dia"))
    read = written(base.where("rid is not null and txt is not null").mapInArrow(_read(chunk, run), _READ), "parsed")
    short = read.where("run is null").groupBy("rid").agg(F.min("ok").alias("ok"))
    runs = read.where("run is not null").dropDuplicates(["rid", "run_no"]).select("rid", "run_no", "family", "run")
    maps = runs.mapInArrow(_maps(chunk), f"rid long, run_no int, {_MAP}")
    entries = maps.groupBy("rid").applyInPandas(_entries, "rid long, run_no int, entry string, first int, balanced boolean")
    pieces = runs.join(entries, ["rid", "run_no"]).mapInPandas(_statement_pieces(chunk), "rid long, family string, balanced boolean, stmt_no int, run_no int, piece string")
    statements = pieces.groupBy("rid", "stmt_no").agg(
        F.first("family").alias("family"), F.first("balanced").alias("balanced"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "piece"))), lambda x: x["piece"]), "").alias("txt"),
    )
    judged = written(statements.select("rid", "stmt_no", "balanced", _statement("txt", "family").alias("s")).select("rid", "stmt_no", "balanced", "s.*"), "statements")
    # script_ok, over the statements of a text
    first = judged.groupBy("rid").agg(F.coalesce(F.min(F.when(F.col("routine"), F.col("stmt_no"))), F.lit((1 << 31) - 1)).alias("first"))
    body, head = F.col("stmt_no") >= F.col("first"), F.col("stmt_no") <= F.col("first")
    long = judged.join(first, "rid").groupBy("rid").agg(
        (F.every(F.col("balanced") & (F.col("ok") | ~head) & (F.col("clean") | ~body)) & (F.sum(F.when(body, F.col("blocks")).otherwise(0)) == 0)).alias("ok")
    )
    return short.unionByName(long)


def unparsable(df: DataFrame, id_col: str, text_col: str, dialect_col: str) -> DataFrame:
    """(rid) of every record whose text cannot be parsed."""
    return parse_verdicts(df, id_col, text_col, dialect_col).where("not ok").select("rid")


def parse_rates(df: DataFrame, id_col: str, text_col: str, dialect_col: str, repo_col: str) -> DataFrame:
    """(repo, dialect, n_files, n_invalid, invalid_rate) over all records; null repos and dialects are groups of their own."""
    verdicts = parse_verdicts(df, id_col, text_col, dialect_col)
    labels = df.select(F.col(id_col).cast("long").alias("rid"), F.col(repo_col).alias("repo"), F.lower(F.trim(F.col(dialect_col))).alias("dialect"))
    return (
        verdicts.join(labels.distinct(), "rid").groupBy("repo", "dialect")
        .agg(F.count("*").alias("n_files"), F.count_if(~F.col("ok")).alias("n_invalid"))
        .withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
