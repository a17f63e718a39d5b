"""Service levels: indicator counts, ratio series over sliding windows, snapshots and alerts.

Requests are first added up per service and minute. Everything after that works on minute rows,
whose number depends on the time covered and not on the traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.functions.canonical import at_instant

WINDOWS_MINUTES = {"5m": 5, "30m": 30, "1h": 60, "6h": 360, "30d": 43200}
AVAILABILITY_TARGET = 0.999
LATENCY_TARGET = 0.95
LATENCY_THRESHOLD_MS = 500
TINY = 1e-12

# Fixed values: (name, objective, long window, short window, burn factor, hold in minutes).
BURN_ALERTS = (
    ("AvailabilityBudgetFastBurn", "availability", "1h", "5m", 14.4, 2),
    ("AvailabilityBudgetSlowBurn", "availability", "6h", "30m", 6.0, 15),
    ("LatencyBudgetFastBurn", "latency", "1h", "5m", 14.4, 2),
    ("LatencyBudgetSlowBurn", "latency", "6h", "30m", 6.0, 15),
)


def minute_of(ts: Column) -> Column:
    """Minutes since 1970, independent of the session time zone."""
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _counts(threshold: float) -> list[Column]:
    return [F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("outcome") == "error").alias("server_error_count"),
            F.count("duration_ms").alias("latency_eligible_count"),
            F.count_if(F.col("duration_ms") <= threshold).alias("latency_good_count")]


def sli_counts(requests: DataFrame, start, end, threshold: float = LATENCY_THRESHOLD_MS) -> DataFrame:
    """Requests, server errors, latency-eligible and fast requests per service in ``(start, end]``."""
    lo, hi = at_instant(start), at_instant(end)
    return requests.where((F.col("ts") > lo) & (F.col("ts") <= hi)).groupBy("service").agg(*_counts(threshold))


def minute_counts(requests: DataFrame, threshold: float = LATENCY_THRESHOLD_MS) -> DataFrame:
    """Counts per service and minute with a row for every minute between the first and the last."""
    seen = requests.groupBy("service", minute_of(F.col("ts")).alias("minute")).agg(*_counts(threshold))
    spine = (seen.groupBy("service").agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
             .select("service", F.explode(F.sequence("lo", "hi")).alias("minute")))
    return spine.join(seen, ["service", "minute"], "left").fillna(0)


def burn_series(minutes: DataFrame, availability_target: float = AVAILABILITY_TARGET,
                latency_target: float = LATENCY_TARGET) -> DataFrame:
    """Availability and latency ratio per window at each minute, and the 30-day budget left.

    Without traffic the short windows read 1 (availability) and 0 (latency), as the recording
    rules do.
    """
    cols = ["request_count", "server_error_count", "latency_eligible_count", "latency_good_count"]
    line = Window.partitionBy("service").orderBy("minute")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    totals = minutes.select("service", "minute", *cols, *[F.sum(c).over(so_far).alias(f"_{c}") for c in cols])
    out = {}
    for name, width in WINDOWS_MINUTES.items():
        floor = F.lit(1.0 if name == "30d" else TINY)
        # Minutes are dense, so a window total is the difference of two running totals.
        n, bad, eligible, good = [
            (F.col(f"_{c}") - F.lag(f"_{c}", width, 0).over(line)).cast("double") for c in cols]
        out[f"availability_{name}"] = 1 - bad / F.greatest(n, floor)
        out[f"latency_{name}"] = good / F.greatest(eligible, floor)
    series = totals.select("service", "minute", *cols, *[c.alias(n) for n, c in out.items()])
    left = lambda c, target: F.greatest(1 - (1 - F.col(c)) / (1 - F.lit(target)), F.lit(0.0))
    return series.withColumns({
        "availability_budget_remaining": left("availability_30d", availability_target),
        "latency_budget_remaining": left("latency_30d", latency_target)})


def held(series: DataFrame, condition: Column, hold: int, keys: list[str]) -> Column:
    """True where the condition held at this minute and at each of the ``hold`` minutes before it."""
    w = Window.partitionBy(*keys).orderBy("minute").rangeBetween(-hold, 0)
    flag = F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    return F.sum(flag).over(w) == hold + 1


def burning(objective: str, target: float, long: str, short: str, factor: float) -> Column:
    burn = lambda w: (1 - F.col(f"{objective}_{w}")) / (1 - F.lit(target)) > factor
    return burn(long) & burn(short)


def alerts(series: DataFrame, availability_target: float = AVAILABILITY_TARGET,
           latency_target: float = LATENCY_TARGET, rules=BURN_ALERTS) -> DataFrame:
    """Periods in which an alert fires: condition true without a break for its hold time."""
    target = {"availability": availability_target, "latency": latency_target}
    fires = {name: held(series, burning(obj, target[obj], long, short, factor), hold, ["service"])
             for name, obj, long, short, factor, hold in rules}
    wide = series.select("service", "minute", *[c.alias(n) for n, c in fires.items()])
    long = wide.select("service", "minute", F.explode(F.array(*[
        F.struct(F.lit(n).alias("alert"), F.col(n).alias("firing")) for n in fires])).alias("x"))
    return firing_periods(long.select("service", "minute", "x.alert", "x.firing"), ["service", "alert"])


def firing_periods(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive firing minutes as one row each (gaps and islands over minute rows)."""
    w = Window.partitionBy(*keys).orderBy("minute")
    on = flags.where(F.col("firing")).withColumn("_island", F.col("minute") - F.row_number().over(w))
    return on.groupBy(*keys, "_island").agg(
        F.min("minute").alias("from_minute"), F.max("minute").alias("to_minute")).drop("_island")


def hold_alerts(samples: DataFrame, keys: list[str], condition: Column, hold: int) -> DataFrame:
    """Alert on any per-minute gauge (dead letters, exporter down, queue saturation, failures)."""
    return firing_periods(samples.withColumn("firing", held(samples, condition, hold, keys)), keys)


def _objective(good: Column, eligible: Column, target: float, name: str) -> dict[str, Column]:
    n = F.nullif(eligible, F.lit(0)).cast("double")
    sli = good / n
    consumed = (1 - sli) / (1 - F.lit(target))
    return {f"{name}_sli": sli, f"{name}_bad_ratio": 1 - sli, f"{name}_budget_consumed": consumed,
            f"{name}_budget_remaining": F.when(sli.isNotNull(), F.greatest(F.lit(0.0), 1 - consumed)),
            f"{name}_met": sli >= target}


def slo_snapshot(counts: DataFrame, availability_target: float = AVAILABILITY_TARGET,
                 latency_target: float = LATENCY_TARGET) -> DataFrame:
    """Indicator, error budget and status per service; NULL ratios where there was no traffic."""
    c = F.col
    out = counts.withColumns({
        **_objective(c("request_count") - c("server_error_count"), c("request_count"), availability_target, "availability"),
        **_objective(c("latency_good_count"), c("latency_eligible_count"), latency_target, "latency")})
    bad = ((c("server_error_count") > c("request_count")) | (c("latency_good_count") > c("latency_eligible_count"))
           | (c("latency_eligible_count") > c("request_count")))
    status = (F.when(bad, "MEASUREMENT_INVALID")
              .when((c("request_count") == 0) | (c("latency_eligible_count") == 0), "INSUFFICIENT_DATA")
              .when(c("availability_met") & c("latency_met"), "MET").otherwise("BREACHED"))
    return out.withColumn("status", status)
