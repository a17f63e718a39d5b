"""Cutting lineage in iterative jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from dataward.functions.shared_files import Files, fresh_folder, shared_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet below the shared folder and read on from there.

    Later steps read only the columns they need, and joins are planned by the size that the rows really have; a
    checkpoint keeps the estimate made before, which knows nothing of generated rows.
    """
    folder = fresh_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def stored_meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """As ``stored``, but the files go with the block."""
    folder = fresh_folder(df.sparkSession, "stored")
    try:
        df.write.parquet(folder)
        yield df.sparkSession.read.schema(df.schema).parquet(folder)
    finally:
        Files(df.sparkSession).delete(folder)
