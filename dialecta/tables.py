"""Reading input tables and cutting lineage on shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="dialecta-code-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)  # the driver's file server hands it out
        _SHIPPED.add(app)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, with this package known to the executors: an operator's first step on a caller's table."""
    ship(df.sparkSession)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory (one file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and
    all runs on this machine (local tests) a folder of it is made and set.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file://" + os.path.join(tempfile.gettempdir(), f"dialecta-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(set_to)
        atexit.register(shutil.rmtree, set_to.removeprefix("file://"), ignore_errors=True)
    return set_to


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` stored as a table in the shared folder and read back.

    The result no longer depends on earlier stages, so a lost executor costs
    no recomputation, and later readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swap(fs, hadoop_path, fresh: str, path: str) -> None:
    """Puts the finished directory ``fresh`` in the place of ``path``; whatever fails, the old content stays or is put back.

    ``fs`` is a Hadoop file system, ``hadoop_path`` makes its paths. Nothing is deleted before the new directory is in place.
    """
    now, old = hadoop_path(path), hadoop_path(f"{path.rstrip('/')}.__old-{uuid.uuid4().hex}")
    had = fs.exists(now)
    if had and not fs.rename(now, old):
        raise OSError(f"{path} could not be moved aside; it is unchanged")
    if not fs.rename(hadoop_path(fresh), now):
        if had and not fs.rename(old, now):
            raise OSError(f"{path} could not be replaced nor put back; its content is in {old}")
        raise OSError(f"{path} could not be replaced; it is unchanged")
    if had:
        fs.delete(old, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are few bytes but much work, over at least two tasks a core; adaptive execution leaves them apart."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
