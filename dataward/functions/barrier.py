"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that later steps read several times.

    A plain projection is merged into every expression that uses it, which repeats the work and lets
    plans grow with each step. A one-row generator is not merged; it adds no shuffle and no rows.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))
