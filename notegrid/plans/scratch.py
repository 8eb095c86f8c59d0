"""Intermediate tables in the folder all executors share.

``written`` cuts lineage by writing a Parquet table below the checkpoint folder
and reading it again: the result survives the loss of any executor, keeps
column pruning, and is computed once however often it is used.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs in one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"notegrid-{os.getuid()}")


def written(df: DataFrame, name: str = "part", options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder; ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notegrid-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="snappy", **(options or {})).parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table behind a result of ``written`` that is no longer read."""
    for spark, path in [x for x in _MADE if any(x[1] in f for f in df.inputFiles())]:
        _MADE.remove((spark, path))
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def clear() -> int:
    """Delete the tables written so far; call it when no result is read any more."""
    n = 0
    while _MADE:
        n += _delete(*_MADE.pop())
    return n
