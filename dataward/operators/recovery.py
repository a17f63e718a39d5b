"""Checks that a restored control store must pass before it may serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, name: str, broken) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(broken, F.lit(False))).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations")


def recovery_checks(outbox: DataFrame, usage: DataFrame, migrations: DataFrame, required_migrations: DataFrame,
                    modes: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per check with its number of violations; all must be zero."""
    c = F.col
    outbox_bad = ((c("published_at").isNull() != c("publish_receipt").isNull())
                  | (c("publish_receipt").isNull() != c("publish_receipt_sha256").isNull())
                  | (c("published_at").isNotNull() & c("dead_lettered_at").isNotNull())
                  | (c("claimed_until").isNotNull() & c("claimed_by").isNull()))
    usage_bad = (~c("purpose").isin("operational-non-billable", "billing-candidate") | (c("quantity") <= 0)
                 | ~c("trace_id").rlike("^[a-f0-9]{32}$") | ~c("source_event_digest").rlike("^[a-f0-9]{64}$")
                 | ~c("event_sha256").rlike("^[a-f0-9]{64}$"))
    lacking = required_migrations.join(migrations, ["component", "version"], "left_anti")
    rooted = modes.join(heads.select("component", c("state_root").alias("_head")), "component", "left")
    root_bad = ((c("mode") != "scoped-authoritative") | ~c("state_root").rlike("^[a-f0-9]{64}$")
                | ~c("state_root").eqNullSafe(c("_head")))
    return (_count(outbox, "outbox_states", outbox_bad).unionByName(_count(usage, "usage_events", usage_bad))
            .unionByName(_count(lacking, "migrations", F.lit(True))).unionByName(_count(rooted, "roots", root_bad))
            .withColumn("passed", c("violations") == 0))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
