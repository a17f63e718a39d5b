"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one, as in tests, gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="dataward-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later steps survive lost executors."""
    path = f"{_scratch.get() or shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written; the tables that it wrote on the way are deleted after that."""
    folder = f"{_scratch.get() or shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        made = build()
        _scratch.reset(token)
        token = None
        return written(made)
    finally:
        if token is not None:
            _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        # A folder that cannot be deleted costs disk, not the result.
        with contextlib.suppress(Exception):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def extra_columns_dropped(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns never clash with those that an operator adds."""
    return df.select(*[df[n] for n in names])
