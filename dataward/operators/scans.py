"""Vulnerability scan reports: three kinds of findings in one table, and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.functions.canonical import at_instant

SCHEMA = """artifact string, databaseUpdatedAt string, Results array<struct<Target: string,
 Vulnerabilities: array<struct<VulnerabilityID: string, Severity: string>>,
 Misconfigurations: array<struct<ID: string, Severity: string>>, Secrets: array<struct<RuleID: string, Severity: string>>>>"""
BLOCKING = ("UNKNOWN", "HIGH", "CRITICAL")


def scan_findings(reports: DataFrame) -> DataFrame:
    """(artifact, scanner, target, id, severity): one row per finding of any kind."""
    results = reports.select("artifact", F.explode("Results").alias("r"))

    def kind(scanner: str, field: str, name: str, missing: str) -> DataFrame:
        rows = results.select("artifact", F.col("r.Target").alias("target"), F.explode(f"r.{field}").alias("f"))
        return rows.select("artifact", F.lit(scanner).alias("scanner"), "target", F.col(f"f.{name}").alias("id"), F.upper(F.coalesce("f.Severity", F.lit(missing))).alias("severity"))

    return (kind("vulnerability", "Vulnerabilities", "VulnerabilityID", "UNKNOWN")
            .unionByName(kind("misconfiguration", "Misconfigurations", "ID", "UNKNOWN")).unionByName(kind("secret", "Secrets", "RuleID", "CRITICAL")))


def scan_gate(reports: DataFrame, now, max_age_hours: int = 24, skew_seconds: int = 300) -> DataFrame:
    """Decision per artifact: stale scanner data, blocked by a severe finding, or pass."""
    blocking = scan_findings(reports).where(F.col("severity").isin(*BLOCKING)).groupBy("artifact").agg(F.count(F.lit(1)).alias("blocking"))
    age = F.timestamp_diff("SECOND", F.to_timestamp_ntz("databaseUpdatedAt"), at_instant(now))
    stale = ~F.coalesce((age >= -skew_seconds) & (age <= max_age_hours * 3600), F.lit(False))
    return reports.select("artifact", "databaseUpdatedAt").join(blocking, "artifact", "left").select(
        "artifact", F.coalesce("blocking", F.lit(0)).alias("blocking"),
        F.when(stale, "stale").when(F.coalesce("blocking", F.lit(0)) > 0, "blocked").otherwise("pass").alias("decision"))
