"""Problem 6: duplicates hidden by formatting differences.

Every record gets the digest of its copy form (``textforms.copy_form``).
Hot keys are detected first, exactly, from counts that are combined on the map
side; their list has at most ``MAX_HOT`` rows and is broadcast. Hot keys are
aggregated in two levels over salts and their records find the representative
by the broadcast, all other keys take one shuffle. The representative is the
smallest id.

Defined results: a null text belongs to no group; texts without any word (the
empty text among them) are one group; a record delivered twice (same id)
counts once; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from dialecta.llm.textforms import copy_form, digest
from dialecta.tables import shipped, written

MAX_HOT = 1_000

_KEYED = StructType([StructField("rid", LongType()), StructField("ckey", BinaryType())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [digest(copy_form(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], ["rid", "ckey"])


def copy_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, ckey) for every record with a text."""
    base = shipped(df).select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("txt"))
    return base.where("rid is not null and txt is not null").mapInArrow(_digests, _KEYED)


def _marked(keyed: DataFrame, hot: int) -> DataFrame:
    """``keyed`` with ``is_hot``: exact counts per key from partial ones tell the keys of more than ``hot`` records.

    The limit rises with the number of records, so at most ``MAX_HOT`` keys are hot and their list can be broadcast;
    no record is shuffled.
    """
    limit = max(hot, keyed.count() // MAX_HOT)
    hot_keys = keyed.groupBy("ckey").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("ckey", F.lit(True).alias("is_hot"))
    return keyed.join(F.broadcast(hot_keys), "ckey", "left").na.fill(False, ["is_hot"])


def _firsts(marked: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(ckey, id_first, n) of the hot keys, in two levels over salts, and of all others, in one."""
    salt = F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("salt")
    part = marked.where("is_hot").groupBy("ckey", salt).agg(F.count("*").alias("c"), F.min("rid").alias("m"))
    hot = part.groupBy("ckey").agg(F.min("m").alias("id_first"), F.sum("c").alias("n"))
    return hot, marked.where("not is_hot").groupBy("ckey").agg(F.min("rid").alias("id_first"), F.count("*").alias("n"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return written(copy_keys(df, id_col, text_col).distinct(), "copy-keys")  # the texts are lexed once


def copy_groups(df: DataFrame, id_col: str, text_col: str, hot: int = 20_000, salts: int = 64) -> DataFrame:
    """(id_first, id_copy), one row per further copy of a group of two or more."""
    marked = _marked(_keyed(df, id_col, text_col), hot)
    hot_firsts, firsts = _firsts(marked, salts)
    rest = marked.where("not is_hot").join(firsts.where("n > 1"), "ckey")
    both = rest.unionByName(marked.where("is_hot").join(F.broadcast(hot_firsts), "ckey"))  # at most MAX_HOT rows
    return both.where("rid <> id_first").select("id_first", F.col("rid").alias("id_copy"))


def collapsed(df: DataFrame, id_col: str, text_col: str, hot: int = 20_000, salts: int = 64) -> DataFrame:
    """(id_first, n_copies): one row per distinct record with its number of copies."""
    hot_firsts, firsts = _firsts(_marked(_keyed(df, id_col, text_col), hot), salts)
    return hot_firsts.unionByName(firsts).select("id_first", F.col("n").alias("n_copies"))
