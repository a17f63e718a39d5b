"""Per-key sequence operations that never put one whole key into one task.

A window partitioned by a key sends every row of that key to one task. The helpers here split a
key into *chunks* (a column that never decreases along the wanted order, such as a day or a block of
sequence numbers), work inside (key, chunk), and carry one summary row per chunk across the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.functions.barrier import once


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    raise ValueError(f"unsupported running aggregate: {kind}")


_AGGREGATES = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], order: list[Column], chunk: Column,
            aggs: dict[str, tuple[str, Column]], before: DataFrame | None = None) -> DataFrame:
    """Add running aggregates over all *earlier* rows of the same key (the current row excluded).

    ``aggs`` maps an output name to ``(kind, expression)`` with kind sum, count, max or min. max and
    min work on structs of orderable fields too, which gives "row with the highest version so far".

    ``before`` (keys and the names of ``aggs``) holds values from ahead of all rows of a key. They are joined with the
    summaries, which are parted by key already, so the rows themselves do not move for them.
    """
    inputs = {f"_in_{n}": e for n, (_, e) in aggs.items()}
    # Rows without a chunk come first; a number in its place lets them find their summary.
    rows = df.withColumns({**inputs, "_chunk": chunk if before is None else F.coalesce(chunk, F.lit(-(1 << 63)).cast("bigint"))})
    earlier_rows = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
                    .rowsBetween(Window.unboundedPreceding, -1))
    earlier_chunks = (Window.partitionBy(*keys).orderBy("_chunk")
                      .rowsBetween(Window.unboundedPreceding, -1))
    # Constant keys part nothing. The others pass a barrier: a filter for their nulls, pushed below it from the join, would make
    # another input of the summaries, and what the rows are made of would be shuffled twice.
    parting = [k for k in keys if df.schema[k].nullable]
    summary = once(rows, {k: F.col(k) for k in parting}).groupBy(*keys, "_chunk").agg(
        *[_AGGREGATES[k](f"_in_{n}").alias(f"_part_{n}") for n, (k, _) in aggs.items()])
    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carried = summary.select(*keys, "_chunk", *[
        fold[k](f"_part_{n}").over(earlier_chunks).alias(f"_carry_{n}") for n, (k, _) in aggs.items()])
    if before is not None:
        first = before.select(*keys, *[F.col(n).alias(f"_first_{n}") for n in aggs])
        carried = carried.join(first, keys, "left").withColumns({f"_carry_{n}": _combine(k, F.col(f"_carry_{n}"), F.col(f"_first_{n}")) for n, (k, _) in aggs.items()}).drop(
            *[f"_first_{n}" for n in aggs])
    # Windows come ahead of the join: a key that repeats in ``before`` repeats rows, and no row may meet its own copies.
    # What they read is made of a row's columns once it has moved, so that it is not shuffled beside them.
    moved = rows.drop(*inputs).repartition(*parting, "_chunk").withColumns(inputs)
    inside = moved.withColumns({f"_here_{n}": _AGGREGATES[k](f"_in_{n}").over(earlier_rows) for n, (k, _) in aggs.items()}).drop(*inputs)
    out = inside.join(carried, [*keys, "_chunk"], "left").withColumns({
        n: _combine(k, F.col(f"_carry_{n}"), F.col(f"_here_{n}")) for n, (k, _) in aggs.items()})
    return out.drop("_chunk", *[f"_{c}_{n}" for n in aggs for c in ("carry", "here")])


def neighbour(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
              values: dict[str, Column], direction: str = "previous") -> DataFrame:
    """Add values of the previous or next row of the same key; NULL at the end of the key.

    ``order`` names columns; ``direction`` is ``previous`` or ``next``.
    """
    back = direction == "previous"
    picked = F.struct(*[e.alias(n) for n, e in values.items()])
    rows = df.withColumns({"_pick": picked, "_chunk": chunk})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    position = F.struct(*order)
    edge = F.max_by if back else F.min_by
    summary = rows.groupBy(*keys, "_chunk").agg(edge("_pick", position).alias("_edge"))
    step = F.lag if back else F.lead
    carried = summary.select(*keys, "_chunk", step("_edge").over(across).alias("_carry"))
    joined = rows.join(carried, [*keys, "_chunk"], "left").withColumn(
        "_near", F.coalesce(step("_pick").over(inside), F.col("_carry")))
    return joined.select(*df.columns, *[F.col(f"_near.{n}").alias(n) for n in values])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int,
             rank: str = "rank_in_key") -> DataFrame:
    """Keep the first ``n`` rows per key. The rank filter is applied before the shuffle as well as
    after it (Spark's window group limit), so a hot key sends at most n rows per task."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the one with the highest order; a combinable aggregate, not a window."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others])


def ordered_root(df: DataFrame, keys: list[str], digest: str, levels: tuple[int, ...] = (5, 2)) -> DataFrame:
    """Order-free digest of a multiset of row digests, built as a tree over hex prefixes.

    Level one hashes the sorted digests that share the first ``levels[0]`` hex digits, each further
    level hashes the results that share a shorter prefix, the last step hashes what is left. With
    five digits a key is cut into about a million groups, so no task ever holds a whole key. Equal
    digests are counted, not listed, so copies of one row cost one entry.
    """
    def fold(frame: DataFrame, by: list[str]) -> DataFrame:
        pair = F.array_sort(F.collect_list(F.struct("_p", "_d")))
        return frame.groupBy(*by).agg(
            F.sha2(F.array_join(F.transform(pair, lambda s: s["_d"]), "\n"), 256).alias("_d"),
            F.sum("_rows").alias("_rows"))

    counted = df.groupBy(*keys, F.col(digest).alias("_p")).agg(F.count(F.lit(1)).alias("_rows"))
    level = counted.withColumn("_d", F.concat_ws(":", "_p", F.col("_rows").cast("string")))
    for width in levels:
        level = fold(level.withColumn("_q", F.substring("_p", 1, width)), [*keys, "_q"])
        level = level.withColumnRenamed("_q", "_p")
    return fold(level, keys).select(*keys, F.col("_d").alias("root"), F.col("_rows").alias("row_count"))
