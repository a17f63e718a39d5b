"""Content digests: SHA-256 over JSON with keys in alphabetical order and absent fields left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_map(col: Column) -> Column:
    """A map with its entries in key order, so that its JSON text is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(col)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of the named fields in key order; NULL fields are dropped by ``to_json``."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def row_digest(*cols: str) -> Column:
    return digest({c: F.col(c) for c in cols})


def version_order(col: Column) -> Column:
    """Order key of a decimal version text of any length without leading zeros."""
    return F.struct(F.length(col).alias("len"), col.alias("text"))


def at_instant(value) -> Column:
    """An instant given as text, column or None, as a zone-less timestamp column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)
