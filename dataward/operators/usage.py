"""Usage metering: event building, the ingestion window, idempotent insert, hourly totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.canonical import at_instant, digest, row_digest, sorted_map

# Grammars of identifiers, quantities and dimension values.
COMPONENT = r"^[A-Za-z0-9][A-Za-z0-9._:-]{2,127}$"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]{7,127}$"
QUANTITY = r"^(?:0|[1-9][0-9]{0,20})(?:\.[0-9]{1,9})?$"
DIMENSION_VALUE = r"^[\x20-\x7e]{1,128}$"
SHA256_HEX = r"^[a-f0-9]{64}$"
TENANT = r"^[a-z][a-z0-9-]{2,62}$"
LATENCY_BOUNDS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
MAXIMUM_AGE_DAYS = 400
MAXIMUM_SKEW_SECONDS = 300

ROLLUP_KEYS = ["component", "tenant_id", "meter_name", "purpose", "unit", "period_start",
               "dimensions_sha256"]


@dataclass(frozen=True)
class Meter:
    purpose: str
    unit: str
    dimension_keys: tuple[str, ...] = ()


def normalize_quantity(col: Column) -> Column:
    """Fixed-point text without trailing zeros; NULL where malformed or not above zero."""
    trimmed = F.when(F.contains(col, F.lit(".")),
                     F.regexp_replace(F.regexp_replace(col, r"0+$", ""), r"\.$", "")).otherwise(col)
    return F.when(col.rlike(QUANTITY) & (trimmed != "0"), trimmed)


def _by_meter(meters: dict[str, Meter], value) -> Column:
    pairs = [F.lit(x) for name, m in sorted(meters.items()) for x in (name, value(m))]
    return F.element_at(F.create_map(*pairs), F.col("meter_name"))


def build_usage_events(df: DataFrame, component: str, meters: dict[str, Meter]) -> DataFrame:
    """Normalised usage events with an ``error`` column (NULL when the event is accepted).

    Input: tenant_id, meter_name, quantity (text), occurred_at, source_event_id,
    source_event_digest, dimensions (map), and optionally input_tenant_id and event_id.
    The meter definitions are configuration and are folded into the plan as literals.
    """
    have = set(df.columns)
    tenant_given = F.col("input_tenant_id") if "input_tenant_id" in have else F.lit(None).cast("string")
    event_given = F.col("event_id") if "event_id" in have else F.lit(None).cast("string")
    allowed = F.element_at(F.create_map(*[
        x for name, m in sorted(meters.items())
        for x in (F.lit(name), F.array(*[F.lit(k) for k in m.dimension_keys]).cast("array<string>"))]),
        F.col("meter_name"))
    dims = F.coalesce(F.col("dimensions"), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")))
    minted = digest({"component": F.lit(component), "meterName": F.col("meter_name"),
                     "sourceEventId": F.col("source_event_id"), "tenantId": F.col("tenant_id")})
    out = df.withColumns({
        "component": F.lit(component),
        "event_id": F.coalesce(event_given, minted),
        "purpose": _by_meter(meters, lambda m: m.purpose),
        "unit": _by_meter(meters, lambda m: m.unit),
        "_allowed": allowed,
        "dimensions": sorted_map(dims),
        "_quantity": normalize_quantity(F.col("quantity")),
    })
    bad_key = F.exists(F.map_keys("dimensions"), lambda k: ~F.array_contains(F.col("_allowed"), k))
    bad_value = F.exists(F.map_values("dimensions"),
                         lambda v: v.isNull() | ~v.rlike(DIMENSION_VALUE))
    error = (
        F.when(~F.lit(component).rlike(COMPONENT), "USAGE_CONFIG_INVALID")
        .when(F.length("tenant_id").isNull() | ~F.length("tenant_id").between(3, 128), "USAGE_CONTEXT_INVALID")
        .when(F.col("purpose").isNull(), "USAGE_METER_UNKNOWN")
        .when(tenant_given.isNotNull() & (tenant_given != F.col("tenant_id")), "USAGE_TENANT_MISMATCH")
        .when(F.col("source_event_id").isNull() | ~F.col("source_event_id").rlike(IDENTIFIER)
              | F.col("source_event_digest").isNull()
              | ~F.col("source_event_digest").rlike(SHA256_HEX), "USAGE_SOURCE_INVALID")
        .when((F.size("dimensions") > 16) | bad_key | bad_value, "USAGE_DIMENSIONS_INVALID")
        .when(F.col("_quantity").isNull(), "USAGE_QUANTITY_INVALID")
        .when(~F.col("event_id").rlike(IDENTIFIER), "USAGE_EVENT_ID_INVALID")
        .when(F.col("occurred_at").isNull(), "USAGE_TIME_INVALID"))
    return out.withColumns({
        "error": error,
        "quantity": F.col("_quantity").try_cast("decimal(30,9)"),
        "dimensions_sha256": F.sha2(F.to_json("dimensions"), 256),
    }).drop("_allowed", "_quantity", *(["input_tenant_id"] if "input_tenant_id" in have else []))


def age_gate(df: DataFrame, now, days: int = MAXIMUM_AGE_DAYS,
             skew_seconds: int = MAXIMUM_SKEW_SECONDS) -> DataFrame:
    """Mark events older than ``days`` or further than ``skew_seconds`` in the future as rejected."""
    clock = at_instant(now)
    oldest = clock - F.make_dt_interval(F.lit(days))
    newest = clock + F.make_dt_interval(secs=F.lit(skew_seconds))
    return df.withColumn("in_window", F.col("occurred_at").between(oldest, newest))


def event_digest(df: DataFrame) -> DataFrame:
    """Digest of the event content, the value an idempotent replay must repeat."""
    return df.withColumn("event_sha256", digest({
        "component": F.col("component"), "dimensions": F.to_json("dimensions"),
        "eventId": F.col("event_id"), "meterName": F.col("meter_name"),
        "occurredAt": F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "purpose": F.col("purpose"), "quantity": F.col("quantity").cast("string"),
        "sourceEventDigest": F.col("source_event_digest"), "sourceEventId": F.col("source_event_id"),
        "tenantId": F.col("tenant_id"), "unit": F.col("unit")}))


def dedupe_checked(df: DataFrame, keys: list[str], digest_col: str, order: list[str],
                   seen: DataFrame | None = None) -> DataFrame:
    """Idempotent insert: each row becomes ``inserted``, ``replayed`` or ``conflict``.

    The binding content of a key is the one already in ``seen`` (keys + digest, unique by key) or
    else that of the first row by ``order``. First rows come from a combinable aggregate, so a key
    that repeats without end still ships one row per task.
    """
    position = F.struct(*order)
    first = df.groupBy(*keys).agg(
        F.min(F.struct(position.alias("at"), F.col(digest_col).alias("digest"))).alias("_first"))
    if seen is not None:
        known = seen.select(*keys, F.col(digest_col).alias("_known"))
        first = first.join(known, keys, "left")
    else:
        first = first.withColumn("_known", F.lit(None).cast("string"))
    bound = F.coalesce("_known", "_first.digest")
    return (df.join(first, keys)
            .withColumn("outcome", F.when(F.col(digest_col) != bound, "conflict")
                        .when(F.col("_known").isNull() & (position == F.col("_first.at")), "inserted")
                        .otherwise("replayed"))
            .drop("_first", "_known"))


def usage_rollup(events: DataFrame) -> DataFrame:
    """Hourly totals; partial sums are taken before the shuffle, so hot tenants stay cheap."""
    hour = F.date_trunc("hour", F.col("occurred_at")).cast("timestamp_ntz")
    return (events.withColumn("period_start", hour)
            .groupBy(*ROLLUP_KEYS)
            .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("event_count"))
            .withColumn("period_seconds", F.lit(3600)))


def rebuild_rollup(events: DataFrame, meter_name: str, start, end) -> DataFrame:
    """Totals of one meter for the whole hours in ``[start, end)``; the filter reaches the scan."""
    lo, hi = at_instant(start), at_instant(end)
    return usage_rollup(events.where((F.col("meter_name") == meter_name)
                                     & (F.col("occurred_at") >= lo) & (F.col("occurred_at") < hi)))


def check_rebuild_range(start: str, end: str) -> None:
    """A rebuild range is hour-aligned, ordered and at most 366 days long."""
    from datetime import datetime, timedelta
    lo, hi = datetime.fromisoformat(start), datetime.fromisoformat(end)
    if any(t.minute or t.second or t.microsecond for t in (lo, hi)):
        raise ValueError("rebuild boundaries must be whole hours")
    if not timedelta(0) < hi - lo <= timedelta(days=366):
        raise ValueError("rebuild range must be positive and at most 366 days")


def rebuild_summary(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count(F.lit(1)).alias("rollup_count"),
                      F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"))


def list_rollups(rollup: DataFrame, tenant_id: str, meter_name: str, start, end) -> DataFrame:
    lo, hi = at_instant(start), at_instant(end)
    return (rollup.where((F.col("tenant_id") == tenant_id) & (F.col("meter_name") == meter_name)
                         & (F.col("period_start") >= lo) & (F.col("period_start") < hi))
            .orderBy("period_start", "dimensions_sha256"))


def rollup_drift(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored totals that differ from recomputed ones, are missing, or have no events behind them."""
    fresh = usage_rollup(events).select(*ROLLUP_KEYS, F.col("quantity").alias("expected_quantity"),
                                        F.col("event_count").alias("expected_count"))
    kept = stored.select(*ROLLUP_KEYS, F.col("quantity").alias("stored_quantity"),
                         F.col("event_count").alias("stored_count"))
    both = kept.join(fresh, ROLLUP_KEYS, "full_outer")
    kind = (F.when(F.col("stored_count").isNull(), "missing")
            .when(F.col("expected_count").isNull(), "extra")
            .when((F.col("stored_quantity") != F.col("expected_quantity"))
                  | (F.col("stored_count") != F.col("expected_count")), "changed"))
    return both.withColumn("drift", kind).where(F.col("drift").isNotNull())


def metric_series(samples: DataFrame, tenant_id: str, name: str) -> DataFrame:
    """Samples of one tenant and metric in time order."""
    return (samples.where((F.col("tenant_id") == tenant_id) & (F.col("metric_name") == name))
            .orderBy("observed_at", "sample_id"))


# --- management requests ------------------------------------------------------------------

_SLUG = "[a-z][a-z0-9-]{2,62}"

# Fixed values: (component, method, path pattern, operation).
MANAGEMENT_ROUTES = (
    ("caas", "POST", "^/v1/tenants$", "tenant.register"),
    ("caas", "POST", "^/v1/connectors/ensure$", "connector.ensure"),
    ("caas", "GET", f"^/v1/tenants/{_SLUG}$", "tenant.read"),
    ("caas", "PUT", f"^/v1/tenants/{_SLUG}/desired-state$", "tenant.desired-state.update"),
    ("caas", "POST", f"^/v1/tenants/{_SLUG}/upgrade$", "tenant.upgrade"),
    ("caas", "POST", f"^/v1/tenants/{_SLUG}/rollback$", "tenant.rollback"),
    ("caas", "POST", f"^/v1/tenants/{_SLUG}/reconcile$", "tenant.reconcile"),
    ("caas", "GET", f"^/v1/tenants/{_SLUG}/audit$", "tenant.audit.read"),
    ("dsaas", "POST", "^/v1/dataspaces$", "dataspace.create"),
    ("dsaas", "GET", f"^/v1/dataspaces/{_SLUG}$", "dataspace.read"),
    ("dsaas", "PUT", f"^/v1/dataspaces/{_SLUG}/desired-state$", "dataspace.desired-state.update"),
    ("dsaas", "POST", f"^/v1/dataspaces/{_SLUG}/reconcile$", "dataspace.reconcile"),
    ("dsaas", "POST", f"^/v1/dataspaces/{_SLUG}/participants$", "participant.submit"),
    ("dsaas", "GET", f"^/v1/dataspaces/{_SLUG}/participants/{_SLUG}$", "participant.read"),
    ("dsaas", "POST", f"^/v1/dataspaces/{_SLUG}/participants/{_SLUG}/approval$", "participant.approve"),
)


def classify_requests(df: DataFrame, platform_tenant: str = "platform") -> DataFrame:
    """Operation name by component, method and path; the tenant a request is accounted to."""
    operation = F.lit(None).cast("string")
    for component, method, pattern, name in reversed(MANAGEMENT_ROUTES):
        operation = F.when((F.col("component") == component) & (F.col("method") == method)
                           & F.col("path").rlike(pattern), name).otherwise(operation)
    known = F.col("authenticated") & F.col("status_code").between(100, 599)
    own = F.col("status_code").between(200, 299) & F.coalesce(
        F.col("requested_tenant_id").rlike(TENANT), F.lit(False))
    tenant = F.when(known, F.when(own, F.col("requested_tenant_id")).otherwise(platform_tenant))
    return df.withColumns({"operation": operation, "accounting_tenant": tenant})


def latency_bucket(col: Column, bounds=LATENCY_BOUNDS_MS) -> Column:
    """Index of the first bound that is not below the value; the number of bounds when none is."""
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(edges, lambda b: b < col))


def histogram_points(df: DataFrame, by: list[str], bounds=LATENCY_BOUNDS_MS) -> DataFrame:
    """Per group: request count, duration sum and one counter per bucket, as combinable counts."""
    bucket = latency_bucket(F.col("duration_ms"), bounds)
    counters = [F.count_if(F.col("_bucket") == i) for i in range(len(bounds) + 1)]
    return (df.withColumn("_bucket", bucket).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("request_count"),
                 F.sum(F.col("duration_ms").cast("decimal(18,3)")).alias("duration_sum"),
                 F.array(*counters).alias("bucket_counts")))


# --- delivery ------------------------------------------------------------------------------

def to_outbox(events: DataFrame) -> DataFrame:
    """One delivery row per accepted usage event (expects ``event_digest`` to have run)."""
    payload = F.to_json(F.struct(
        F.col("component"), F.col("event_id").alias("eventId"), F.col("event_sha256").alias("eventSha256"),
        F.col("meter_name").alias("meterName"), F.col("quantity").cast("string").alias("quantity"),
        F.col("tenant_id").alias("tenantId"), F.col("unit")))
    row_id = digest({"component": F.col("component"), "eventId": F.col("event_id"),
                     "tenantId": F.col("tenant_id"), "type": F.lit("usage.meter.recorded")})
    return events.select(
        "component", row_id.alias("outbox_id"), F.lit("usage-meter-event").alias("aggregate_kind"),
        F.col("event_id").alias("aggregate_id"), "tenant_id",
        F.lit("usage.meter.recorded").alias("event_type"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_sha256"), F.col("occurred_at").alias("created_at"))


_PAYLOAD = ("component string, eventId string, eventSha256 string, meterName string, quantity string, "
            "tenantId string, unit string")


def to_deliveries(outbox: DataFrame, event_type: str = "usage.meter.recorded") -> DataFrame:
    """Delivery records of one event type; digest and identity bindings are checked per row."""
    body = F.from_json("payload", _PAYLOAD)
    rejected = (
        F.when(F.sha2("payload", 256) != F.col("payload_sha256"), "PAYLOAD_DIGEST_MISMATCH")
        .when(F.col("body").isNull() | F.col("body.eventId").isNull(), "PAYLOAD_INVALID")
        .when((F.col("body.tenantId") != F.col("tenant_id"))
              | (F.col("body.component") != F.col("component"))
              | (F.col("body.eventId") != F.col("aggregate_id")), "IDENTITY_MISMATCH"))
    return (outbox.where(F.col("event_type") == event_type).withColumn("body", body)
            .select("outbox_id", "tenant_id", F.col("body.meterName").alias("meter_name"),
                    F.col("body.quantity").try_cast("decimal(30,9)").alias("quantity"),
                    F.col("body.eventSha256").alias("event_sha256"), rejected.alias("rejected")))


def to_audit_records(outbox: DataFrame, event_types: list[str], component: str) -> DataFrame:
    """Audit records of the listed event types whose digest and component binding hold."""
    ok = ((F.sha2("payload", 256) == F.col("payload_sha256")) & (F.col("component") == component))
    kept = outbox.where(F.col("event_type").isin(event_types))
    return kept.select(
        "component", "tenant_id", F.col("outbox_id").alias("event_id"), "event_type",
        F.col("created_at").alias("occurred_at"), "payload_sha256",
        row_digest("component", "tenant_id", "outbox_id", "event_type", "payload_sha256").alias("record_sha256"),
        ok.alias("bound"))
