"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm.shared import written


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col("a") != F.col("b")).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it can reach.

    Large-star ties each larger neighbour of a node to the least node around it, small-star ties the
    smaller ones. The minima are combinable and every node meets one row of them, so a hub costs no pairs.
    Rounds are written to the shared folder; they end when a round changes nothing (about log n rounds).
    Null ends, self links and repeated links count as absent.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    links = written(_pairs(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _pairs(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = written(_pairs(small))
        after = mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
