"""Problem 5: visually identical text with different characters.

Method: normalisation quick check. A character is stable if it is its own
canonical form and no neighbour can join it (``textforms``); texts of stable
characters, in whatever script, are canonical and never leave the JVM. Only
texts with an unstable character go to Python, where the unstable segments
(with one character of context) are normalised and spliced back. Digests are
stored once; texts are read once.

Defined results: a null text has a null canonical form and takes part in no
class or pair; an empty text is a text like any other; a record delivered
twice (same id) counts once; input columns beside id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialecta.llm.textforms import UNSTABLE_CHAR, canonical_glyphs
from dialecta.tables import shipped, written


@F.pandas_udf(StringType())
def _spliced(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_glyphs, na_action="ignore")


def canonical_text(text: Column) -> Column:
    """Canonical form of a text column; stable texts are passed through."""
    return F.when(text.rlike(UNSTABLE_CHAR), _spliced(text)).otherwise(text)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, shown, exact): 128-bit digests of the canonical and of the exact text; one row per id."""
    base = shipped(df).select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt")).where("rid is not null and txt is not null")
    digests = base.select("rid", F.col("txt").rlike(UNSTABLE_CHAR).alias("unstable"), F.md5("txt").alias("exact"), "txt")
    stable = digests.where("not unstable").select("rid", F.col("exact").alias("shown"), "exact")
    unstable = digests.where("unstable").select("rid", F.md5(_spliced("txt")).alias("shown"), "exact")
    return written(stable.unionByName(unstable).select("rid", F.unhex("shown").alias("shown"), F.unhex("exact").alias("exact")).distinct(), "looks")


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per record whose text has a differing look-alike:
    (record_id, class_id, n_forms, n_links); class_id is the smallest id drawn
    the same way, n_links the number of records with another form."""
    keyed = _keyed(df, id_col, text_col)
    forms = keyed.groupBy("shown", "exact").agg(F.count("*").alias("same"), F.min("rid").alias("first"))
    classes = (
        forms.groupBy("shown")
        .agg(F.count("*").alias("n_forms"), F.sum("same").alias("total"), F.min("first").alias("class_id"))
        .where("n_forms > 1")
    )
    per_form = forms.join(classes, "shown").select("shown", "exact", "class_id", "n_forms", (F.col("total") - F.col("same")).alias("n_links"))
    return keyed.join(per_form, ["shown", "exact"]).select(F.col("rid").alias("record_id"), "class_id", "n_forms", "n_links")


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, hot: int = 2000, salts: int = 32) -> DataFrame:
    """(id_a, id_b), id_a < id_b: texts drawn the same that are not the same string.

    Forms are paired first, so equal texts never meet each other. A class with
    more than ``hot`` records is salted: one side is spread over ``salts``
    partitions, the other is repeated to each of them.
    """
    keyed = _keyed(df, id_col, text_col)
    mixed = (
        keyed.groupBy("shown").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi").select("shown", (F.col("n") > hot).alias("is_hot"))
    )
    members = keyed.join(mixed, "shown")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    spread = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = members.select("shown", F.col("exact").alias("exact_a"), F.col("rid").alias("id_a"), salt.alias("salt"))
    b = members.select("shown", F.col("exact").alias("exact_b"), F.col("rid").alias("id_b"), F.explode(spread).alias("salt"))
    return (
        a.join(b, ["shown", "salt"]).where("id_a < id_b and exact_a <> exact_b").select("id_a", "id_b")
    )


def canonical_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_id, canonical, changed) for every record, ids once."""
    return (
        shipped(df).select(F.col(id_col).alias("record_id"), F.col(text_col).alias("txt"))
        .select("record_id", canonical_text(F.col("txt")).alias("canonical"), "txt")
        .select("record_id", "canonical", (~F.col("txt").eqNullSafe(F.col("canonical"))).alias("changed"))
        .dropDuplicates(["record_id"])
    )
