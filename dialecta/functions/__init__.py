"""Functions that a dialect has and Spark lacks, as vectorised UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_FNV_SEED, _FNV_PRIME, _M64 = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF


def fnv1a(text: str | None, seed: int = _FNV_SEED) -> int | None:
    """Signed 64-bit FNV-1a of a text's UTF-8 bytes."""
    if text is None:
        return None
    h = seed & _M64
    for b in text.encode("utf-8"):
        h = ((h ^ b) * _FNV_PRIME) & _M64
    return h - (1 << 64) if h >> 63 else h


def _fnv_series(s: pd.Series) -> pd.Series:
    return s.map(fnv1a, na_action="ignore").astype("Int64")


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session."""
    from dialecta.tables import ship

    ship(spark)
    if not spark.catalog.functionExists("fnv_hash"):
        spark.udf.register("fnv_hash", F.pandas_udf(_fnv_series, LongType()))
