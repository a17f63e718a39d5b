"""Usage metering over ``events``: one metered event per row, the user as tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.functions.redaction import tenant_bucket
from dataward.functions.shared_files import fresh_folder
from dataward.operators import usage as U
from dataward.plans.registry import query
from dataward.sources.range_store import RangeStore
from dataward.sources.tables import table

COMPONENT = "web-analytics"
SALT = "fixed-cardinality-salt"
METERS = {
    "click": U.Meter("operational-non-billable", "{event}", ("k",)),
    "view": U.Meter("operational-non-billable", "{event}", ("k",)),
    "purchase": U.Meter("billing-candidate", "{order}", ("k",)),
    "signup": U.Meter("billing-candidate", "{account}", ("k",)),
}


def raw_usage(spark: SparkSession, sf: str) -> DataFrame:
    source = F.concat(F.lit("source-event-"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select(
        F.concat(F.lit("tenant-"), F.col("user_id").cast("string")).alias("tenant_id"),
        F.col("event_type").alias("meter_name"),
        F.col("value").cast("decimal(30,9)").cast("string").alias("quantity"),
        F.col("ts").alias("occurred_at"), source.alias("source_event_id"),
        F.sha2(source, 256).alias("source_event_digest"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("dimensions"),
        F.col("event_id").alias("event_no"))


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    return U.build_usage_events(raw_usage(spark, sf), COMPONENT, METERS)


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return usage_events(spark, sf).where(F.col("error").isNull())


_PURPOSE = """case when event_type in ('click','view') then 'operational-non-billable'
  when event_type in ('purchase','signup') then 'billing-candidate' end"""
_UNIT = """case when event_type in ('click','view') then '{event}' when event_type='purchase' then '{order}'
  when event_type='signup' then '{account}' end"""
_USAGE = f"""usage as (select 'web-analytics' as component, 'tenant-' || user_id as tenant_id, event_id as event_no,
  event_type as meter_name, {_PURPOSE} as purpose, {_UNIT} as unit, ts as occurred_at,
  nullif(cast(value as decimal(30,9)), 0) as quantity, 'source-event-' || event_id as source_event_id,
  json_extract_string(props,'$.k') as k,
  sha256('{{"k":"' || json_extract_string(props,'$.k') || '"}}') as dimensions_sha256,
  case when event_type = 'error' then 'USAGE_METER_UNKNOWN'
       when cast(value as decimal(30,9)) = 0 then 'USAGE_QUANTITY_INVALID' end as error from events)"""
_ROLLUP = f"""{_USAGE}, rollup as (select component, tenant_id, meter_name, purpose, unit,
  cast(date_trunc('hour', occurred_at) as timestamp) as period_start, dimensions_sha256, sum(quantity) as quantity,
  count(*) as event_count, 3600 as period_seconds from usage where error is null group by all)"""


@query("usage_rollup", f"with {_ROLLUP} select * from rollup")
def usage_rollup(spark, sf):
    return U.usage_rollup(accepted(spark, sf))


@query("usage_events_built", f"""with {_USAGE} select event_no, tenant_id, meter_name, purpose, unit, quantity,
  dimensions_sha256, error, sha256('{{"component":"web-analytics","meterName":"' || meter_name ||
  '","sourceEventId":"' || source_event_id || '","tenantId":"' || tenant_id || '"}}') as event_id from usage""")
def usage_events_built(spark, sf):
    return usage_events(spark, sf).select(
        "event_no", "tenant_id", "meter_name", "purpose", "unit", "quantity", "dimensions_sha256",
        "error", "event_id")


@query("usage_age_gate", """select event_type, count(*) as events,
  count(*) filter (where ts between timestamp '2025-02-14 12:00:00' - interval 400 day
                   and timestamp '2025-02-14 12:00:00' + interval 300 second) as accepted from events group by 1""")
def usage_age_gate(spark, sf):
    ev = table(spark, sf, "events").withColumnRenamed("ts", "occurred_at")
    return (U.age_gate(ev, "2025-02-14 12:00:00").groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.count_if("in_window").alias("accepted")))


@query("usage_rebuild", f"""with {_ROLLUP} select count(*) as rollup_count, cast(sum(event_count) as bigint) as event_count
  from rollup where meter_name='purchase' and period_start >= timestamp '2024-01-05' and period_start < timestamp '2024-01-12'""")
def usage_rebuild(spark, sf):
    U.check_rebuild_range("2024-01-05T00:00:00", "2024-01-12T00:00:00")
    rebuilt = U.rebuild_rollup(accepted(spark, sf), "purchase", "2024-01-05 00:00:00", "2024-01-12 00:00:00")
    return U.rebuild_summary(rebuilt)


@query("usage_stored_rebuild", f"""with {_ROLLUP}, r as (select *, period_start >= timestamp '2024-01-06 05:00:00' and period_start < timestamp '2024-01-09 13:00:00' as again,
    period_start >= timestamp '2024-01-05' and period_start < timestamp '2024-01-12' as touched from rollup where meter_name = 'purchase'),
  n as (select count(*) filter (where touched) as t, count(*) filter (where again) as a from r)
  select tenant_id, period_start, dimensions_sha256, case when touched and not again then quantity + 1 else quantity end as quantity, event_count, t as tampered, a as rebuilt, true as repeated_is_the_same from r, n""")
def usage_stored_rebuild(spark, sf):
    """The rollup is stored, a week of one meter is falsified, some hours are rebuilt from the events, and once more."""
    events = accepted(spark, sf)
    rollup = U.usage_rollup(events)
    store = RangeStore(spark, fresh_folder(spark, "rollup"))
    store.store(rollup, "first")
    week = ("2024-01-05 00:00:00", "2024-01-12 00:00:00")
    wrong = store.read().where("meter_name = 'purchase'").withColumn("quantity", (F.col("quantity") + 1).cast(rollup.schema["quantity"].dataType))
    tampered = store.replace(wrong, "tamper", {"component": COMPONENT, "meter_name": "purchase"}, *week)
    hours = ("2024-01-06 05:00:00", "2024-01-09 13:00:00")
    again = lambda: store.replace(U.rebuild_rollup(events, "purchase", *hours), "rebuild-1", {"component": COMPONENT, "meter_name": "purchase"}, *hours)
    first, second = again(), again()
    return store.read().where("meter_name = 'purchase'").select(
        "tenant_id", "period_start", "dimensions_sha256", "quantity", "event_count", F.lit(tampered["inserted"]).cast("bigint").alias("tampered"),
        F.lit(first["inserted"]).cast("bigint").alias("rebuilt"), F.lit(first == second and len(store.log.numbers()) == 3).alias("repeated_is_the_same"))


@query("usage_rollup_listing", f"""with {_ROLLUP} select period_start, dimensions_sha256, quantity, event_count from rollup
  where tenant_id='tenant-7' and meter_name='view' and period_start >= timestamp '2024-01-03' and period_start < timestamp '2024-01-29'""")
def usage_rollup_listing(spark, sf):
    rollup = U.usage_rollup(accepted(spark, sf))
    return U.list_rollups(rollup, "tenant-7", "view", "2024-01-03 00:00:00", "2024-01-29 00:00:00").select(
        "period_start", "dimensions_sha256", "quantity", "event_count")


@query("usage_rollup_drift", f"""with {_ROLLUP}, stored as (
  select * replace (case when meter_name='click' and event_count > 1 then quantity + 1 else quantity end as quantity)
  from rollup where tenant_id <> 'tenant-3')
  select coalesce(s.tenant_id, r.tenant_id) as tenant_id, coalesce(s.meter_name, r.meter_name) as meter_name,
    coalesce(s.period_start, r.period_start) as period_start, s.quantity as stored_quantity, r.quantity as expected_quantity,
    case when s.event_count is null then 'missing' when r.event_count is null then 'extra' else 'changed' end as drift
  from stored s full join rollup r using (component, tenant_id, meter_name, purpose, unit, period_start, dimensions_sha256)
  where s.event_count is null or r.event_count is null or s.quantity <> r.quantity or s.event_count <> r.event_count""")
def usage_rollup_drift(spark, sf):
    events = accepted(spark, sf)
    tampered = F.when((F.col("meter_name") == "click") & (F.col("event_count") > 1), F.col("quantity") + 1)
    stored = U.usage_rollup(events).where(F.col("tenant_id") != "tenant-3").withColumn(
        "quantity", F.coalesce(tampered, F.col("quantity")).cast("decimal(38,9)"))
    return U.rollup_drift(stored, events).select(
        "tenant_id", "meter_name", "period_start", "stored_quantity", "expected_quantity", "drift")


@query("usage_dedupe", """with ev as (select user_id as k, sha256(event_type) as d, event_id as pos from events),
  seen as (select c_custkey as k, sha256('click') as d from customer where c_custkey % 2 = 0),
  first as (select k, arg_min(d, pos) as fd, min(pos) as fp from ev group by k)
  select ev.k as user_id, case when ev.d <> coalesce(seen.d, fd) then 'conflict'
    when seen.d is null and ev.pos = fp then 'inserted' else 'replayed' end as outcome, count(*) as events
  from ev join first using (k) left join seen on seen.k = ev.k group by all""")
def usage_dedupe(spark, sf):
    ev = table(spark, sf, "events").select(
        "user_id", F.sha2("event_type", 256).alias("event_sha256"), "event_id")
    seen = table(spark, sf, "customer").where(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("user_id"), F.sha2(F.lit("click"), 256).alias("event_sha256"))
    out = U.dedupe_checked(ev, ["user_id"], "event_sha256", ["event_id"], seen)
    return out.groupBy("user_id", "outcome").agg(F.count(F.lit(1)).alias("events"))


@query("metric_series", """select event_id as sample_id, ts as observed_at, value from events
  where user_id = 11 and event_type = 'view'""")
def metric_series(spark, sf):
    samples = table(spark, sf, "events").select(
        F.concat(F.lit("tenant-"), F.col("user_id").cast("string")).alias("tenant_id"),
        F.col("event_type").alias("metric_name"), F.col("ts").alias("observed_at"),
        F.col("event_id").alias("sample_id"), "value")
    return U.metric_series(samples, "tenant-11", "view").select("sample_id", "observed_at", "value")


def management_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as management API calls."""
    slug = F.concat(F.lit("t-"), F.col("o_custkey").cast("string"))
    path = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("/v1/tenants/"), slug, F.lit("/upgrade")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("/v1/tenants/"), slug))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("/v1/dataspaces"))
            .when(F.col("o_orderpriority") == "5-LOW",
                  F.concat(F.lit("/v1/dataspaces/space-a/participants/"), slug, F.lit("/approval")))
            .otherwise("/v1/unknown"))
    return table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") <= "2-HIGH", "caas").otherwise("dsaas").alias("component"),
        F.when(F.col("o_orderpriority") == "2-HIGH", "GET").otherwise("POST").alias("method"),
        path.alias("path"), (F.col("o_orderstatus") != "P").alias("authenticated"),
        F.when(F.col("o_totalprice") > 400000, 500).otherwise(201).alias("status_code"),
        slug.alias("requested_tenant_id"))


@query("management_requests", """with r as (select *, 't-' || o_custkey as slug from orders)
  select case o_orderpriority when '1-URGENT' then 'tenant.upgrade' when '2-HIGH' then 'tenant.read'
      when '3-MEDIUM' then 'dataspace.create' when '5-LOW' then 'participant.approve' end as operation,
    case when o_orderstatus <> 'P' then case when o_totalprice <= 400000 then slug else 'platform' end end as accounting_tenant,
    count(*) as requests from r group by 1, 2""")
def management_requests_query(spark, sf):
    return (U.classify_requests(management_requests(spark, sf))
            .groupBy("operation", "accounting_tenant").agg(F.count(F.lit(1)).alias("requests")))


_BUCKETS = " || ',' || ".join(
    f"count(*) filter (where value > {lo} and value <= {hi})" for lo, hi in
    zip([-1, *U.LATENCY_BOUNDS_MS], [*U.LATENCY_BOUNDS_MS, 1e18]))


@query("latency_histogram", f"""select event_type, count(*) as request_count,
  cast(sum(cast(value as decimal(18,3))) as decimal(28,3)) as duration_sum, {_BUCKETS} as bucket_counts from events group by 1""")
def latency_histogram(spark, sf):
    ev = table(spark, sf, "events").withColumnRenamed("value", "duration_ms")
    return U.histogram_points(ev, ["event_type"]).withColumn(
        "bucket_counts", F.array_join(F.col("bucket_counts").cast("array<string>"), ","))


@query("tenant_buckets", f"""select 'b' || (cast('0x' || substr(sha256('{SALT}' || chr(0) || 'tenant-' || user_id),1,8) as bigint) % 64) as bucket,
  count(*) as events from events group by 1""")
def tenant_buckets(spark, sf):
    tenant = F.concat(F.lit("tenant-"), F.col("user_id").cast("string"))
    return (table(spark, sf, "events").groupBy(tenant_bucket(tenant, SALT, 64).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("events")))


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    out = U.to_outbox(U.event_digest(accepted(spark, sf)))
    return out.withColumn("payload_sha256", F.when(
        F.col("tenant_id") == "tenant-5", F.sha2(F.lit("tampered"), 256)).otherwise(F.col("payload_sha256")))


@query("usage_deliveries", f"""with {_USAGE} select meter_name, case when tenant_id='tenant-5' then 'PAYLOAD_DIGEST_MISMATCH' end as rejected,
  count(*) as deliveries, cast(sum(quantity) as decimal(38,9)) as quantity from usage where error is null group by 1, 2""")
def usage_deliveries(spark, sf):
    return (U.to_deliveries(outbox(spark, sf)).groupBy("meter_name", "rejected")
            .agg(F.count(F.lit(1)).alias("deliveries"), F.sum("quantity").alias("quantity")))


@query("audit_records", f"""with {_USAGE} select tenant_id, tenant_id <> 'tenant-5' as bound, count(*) as records
  from usage where error is null group by 1, 2""")
def audit_records(spark, sf):
    return (U.to_audit_records(outbox(spark, sf), ["usage.meter.recorded"], COMPONENT)
            .groupBy("tenant_id", "bound").agg(F.count(F.lit(1)).alias("records")))
