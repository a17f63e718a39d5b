"""Outboxes, retries, hash chains and lifecycles over ``lineitem``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.functions.canonical import digest
from dataward.operators import chain as C
from dataward.operators import outbox as O
from dataward.plans.registry import query
from dataward.sources.tables import table


def days(n):
    return F.make_dt_interval(n)


def outbox(spark, sf):
    """Commands about parts: the order key with the line number gives a sequence."""
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    # Rows of one order and line number repeat; the lowest (part, supplier, price) stands for them.
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")).alias("x"))
    return lines.select(
        seq.alias("sequence"), F.concat(F.lit("cmd-"), seq.cast("string")).alias("outbox_id"),
        (F.col("x.l_partkey") % 97).cast("string").alias("aggregate_key"),
        F.when(F.col("x.l_returnflag") == "A", "DISCOVERY_UPSERT").otherwise("CONNECTOR_REGISTRATION_REVIEW").alias("type"),
        O.family(F.when(F.col("x.l_returnflag") == "A", "DISCOVERY_UPSERT").otherwise("CONNECTOR_REGISTRATION_REVIEW")).alias("family"),
        F.col("x.l_suppkey").cast("string").alias("resource_version"), F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("superseded_by"))


_OUTBOX = """raw as (select l_orderkey, l_linenumber, min((l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_shipdate)) as x from lineitem group by 1, 2),
  ob as (select l_orderkey * 8 + l_linenumber as sequence, cast(x[1] % 97 as varchar) as aggregate_key,
    case when x[4] = 'A' then 'discovery' else 'connector-review' end as family, cast(x[2] as varchar) as resource_version from raw),
  sup as (select *, lead(sequence) over (partition by aggregate_key, family order by sequence) as nxt from ob)"""


@query("supersede_commands", f"""with {_OUTBOX} select 'cmd-' || sequence as outbox_id, aggregate_key, family,
  case when nxt is null then 'pending' else 'superseded' end as status, 'cmd-' || nxt as superseded_by from sup""")
def supersede_commands(spark, sf):
    return O.supersede(outbox(spark, sf), 4096).select("outbox_id", "aggregate_key", "family", "status", "superseded_by")


@query("retain_superseded", f"""with {_OUTBOX}, r as (select *, row_number() over (partition by aggregate_key, family
    order by length(resource_version) desc, resource_version desc, sequence desc) as rn from sup where nxt is not null)
  select 'cmd-' || sequence as outbox_id, 'superseded' as status from r where rn <= 5 union all select 'cmd-' || sequence, 'pending' from sup where nxt is null""")
def retain_superseded(spark, sf):
    return O.retain_top(O.supersede(outbox(spark, sf), 4096)).select("outbox_id", "status")


@query("pending_order", f"""with {_OUTBOX} select aggregate_key, family, resource_version, sequence from sup where nxt is null""")
def pending_order(spark, sf):
    return O.pending_order(O.supersede(outbox(spark, sf), 4096)).select("aggregate_key", "family", "resource_version", "sequence")


def delivery_rows(spark, sf):
    """Orders as delivery rows of the customer's nation."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    d = F.col("o_orderdate")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("outbox_id"), F.col("c_nationkey").cast("string").alias("tenant_id"),
        F.concat(F.lit("component-"), (F.col("o_custkey") % 2).cast("string")).alias("component"), F.lit("usage.meter.recorded").alias("event_type"),
        d.alias("created_at"), (d + days((F.col("o_orderkey") % 30).cast("int"))).cast("timestamp_ntz").alias("available_at"),
        (F.length("o_orderpriority") % 5).alias("attempts"), F.when(F.col("o_orderstatus") == "F", d).alias("published_at"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 480000), d).alias("dead_lettered_at"),
        F.when(F.col("o_totalprice") < 60000, F.lit("w-1")).alias("claimed_by"),
        F.when(F.col("o_totalprice") < 60000, (d + days(F.lit(40))).cast("timestamp_ntz")).alias("claimed_until"))


_DELIVERY = """dr as (select o_orderkey, lpad(cast(o_orderkey as varchar), 12, '0') as outbox_id, c_nationkey as tenant, o_custkey % 2 as comp, o_orderdate as created_at,
    o_orderdate + to_days(cast(o_orderkey % 30 as integer)) as available_at, length(o_orderpriority) % 5 as attempts, o_orderstatus = 'F' as published,
    o_orderstatus = 'P' and o_totalprice > 480000 as dead, case when o_totalprice < 60000 then o_orderdate + to_days(40) end as claimed_until
  from orders join customer on c_custkey = o_custkey)"""


@query("ready_rows_topk", f"""with {_DELIVERY}, r as (select *, row_number() over (partition by tenant order by created_at, outbox_id) as turn from dr
    where not published and not dead and available_at <= timestamp '1998-06-01' and (claimed_until is null or claimed_until <= timestamp '1998-06-01') and attempts < 4)
  select outbox_id, cast(tenant as varchar) as tenant_id, turn from r order by turn, created_at, outbox_id limit 200""")
def ready_rows_topk(spark, sf):
    return O.ready_topk(delivery_rows(spark, sf), 200, "1998-06-01 00:00:00", 4).select("outbox_id", "tenant_id", "turn")


@query("outbox_health", f"""with {_DELIVERY} select 'component-' || comp as component, count(*) filter (where not published and not dead) as pending,
  count(*) filter (where dead) as dead_lettered, min(created_at) filter (where not published and not dead) as oldest_pending_at,
  cast(epoch(timestamp '2002-01-01' - (min(created_at) filter (where not published and not dead))) as bigint) as oldest_age_seconds,
  count(*) filter (where dead) = 0 as ready from dr group by 1""")
def outbox_health(spark, sf):
    return O.outbox_health(delivery_rows(spark, sf), "2002-01-01 00:00:00")


@query("attempt_outcomes", """select o_orderkey, case when o_custkey % 9 >= 6 then 'dead' else 'ready' end as outcome,
  case when o_custkey % 9 < 6 then o_orderdate + to_milliseconds(1500 * (o_custkey % 9)) end as next_available_at,
  case when o_custkey % 9 >= 6 then o_orderdate end as dead_lettered_at from orders""")
def attempt_outcomes(spark, sf):
    log = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("attempts"), F.col("o_orderdate").alias("failed_at"),
                                            (F.col("o_custkey") % 9 * 1500).alias("delay_ms"))
    return O.attempt_outcomes(log, 6).select("o_orderkey", "outcome", "next_available_at", "dead_lettered_at")


@query("retry_plan", """with f as (select 'space-' || (user_id % 8) as space_id, ts as failed_at, event_id as failure_no, (user_id % 3) as generation,
    sha256(case when event_type < 'purchase' then 'a' else 'b' end) as fingerprint from events),
  m as (select *, case when lag(generation) over w is not distinct from generation and lag(fingerprint) over w is not distinct from fingerprint then 0 else 1 end as restart
    from f window w as (partition by space_id order by failed_at, failure_no)),
  g as (select *, sum(restart) over (partition by space_id order by failed_at, failure_no rows unbounded preceding) as island from m),
  a as (select *, least(row_number() over (partition by space_id, island order by failed_at, failure_no), 64) as attempt,
    min(failed_at) over (partition by space_id, island) as first_failure_at from g),
  n as (select *, cast(least(300000, 1000 * power(2, least(attempt - 1, 30))) as bigint) as nominal_delay_ms,
    750 + cast('0x' || substr(sha256('{"attempt":' || attempt || ',"dataspaceId":"' || space_id || '","errorFingerprint":"' || fingerprint || '"}'), 1, 8) as bigint) % 251 as jitter_permille from a)
  select failure_no, attempt, first_failure_at, nominal_delay_ms, jitter_permille, greatest(1000, nominal_delay_ms * jitter_permille // 1000) as delay_ms,
    failed_at + to_milliseconds(greatest(1000, nominal_delay_ms * jitter_permille // 1000)) as next_retry_at from n""")
def retry_plan(spark, sf):
    failures = table(spark, sf, "events").select(
        F.concat(F.lit("space-"), (F.col("user_id") % 8).cast("string")).alias("space_id"), F.col("ts").alias("failed_at"), F.col("event_id").alias("failure_no"),
        (F.col("user_id") % 3).alias("generation"), F.sha2(F.when(F.col("event_type") < "purchase", "a").otherwise("b"), 256).alias("fingerprint"))
    return O.retry_plan(failures, F.to_date("failed_at")).select(
        "failure_no", "attempt", "first_failure_at", "nominal_delay_ms", "jitter_permille", "delay_ms", "next_retry_at")


def _content():
    return digest({"component": F.col("component"), "eventId": F.col("event_no").cast("string"), "payload": F.col("payload"),
                   "sequence": F.col("sequence").cast("string")})


def audit_chain(spark, sf):
    """Events as audit rows in id order; some rows are damaged."""
    e = table(spark, sf, "events").select(
        F.concat(F.lit("log-"), (F.col("event_id") % 3).cast("string")).alias("component"), F.concat(F.lit("tenant-"), F.col("user_id").cast("string")).alias("tenant_id"),
        (F.floor(F.col("event_id") / 3) + 1).alias("sequence"), F.col("event_id").alias("event_no"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("payload"))
    stamped = e.withColumn("event_digest", _content())
    before = stamped.select("component", (F.col("sequence") + 1).alias("sequence"), F.col("event_digest").alias("previous_digest"))
    linked = stamped.join(before, ["component", "sequence"], "left")
    n = F.col("event_no")
    return (linked.where(n % 1009 != 500)
            .withColumn("payload", F.when(n % 701 == 9, "edited").otherwise(F.col("payload")))
            .withColumn("previous_digest", F.when(n % 499 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("previous_digest"))))


_CHAIN = """src as (select event_id as n, 'log-' || (event_id % 3) as component, event_id // 3 + 1 as sequence, ts, user_id,
    sha256('{"component":"log-' || (event_id % 3) || '","eventId":"' || event_id || '","payload":"' || event_type || '","sequence":"' || (event_id // 3 + 1) || '"}') as d from events),
  lk as (select a.*, b.d as pd from src a left join src b on b.component = a.component and b.sequence = a.sequence - 1),
  au as (select n, component, sequence, ts, user_id, d, case when n % 499 = 7 then sha256('x') else pd end as pd, n % 701 = 9 as edited from lk where n % 1009 <> 500)"""


@query("verify_chain", f"""with {_CHAIN}, j as (select a.*, b.d as bd, b.ts as bts from au a left join au b on b.component = a.component and b.sequence = a.sequence - 1),
  f as (select component, sequence, unnest([case when sequence > 1 and bd is null then 'SEQUENCE_GAP' end,
    case when (sequence = 1 and pd is not null) or (sequence > 1 and bd is not null and pd is distinct from bd) then 'PREVIOUS_DIGEST_MISMATCH' end,
    case when edited then 'EVENT_DIGEST_MISMATCH' end, case when ts < bts then 'CLOCK_ROLLBACK' end]) as code from j),
  h as (select component, max(sequence) as sequence, arg_max(d, sequence) as d from au group by 1)
  select component, sequence, code from f where code is not null
  union all select component, sequence, 'HEAD_MISMATCH' from h where component = 'log-2'""")
def verify_chain(spark, sf):
    audit = audit_chain(spark, sf)
    heads = audit.groupBy("component").agg(F.max(F.struct("sequence", "event_digest")).alias("x")).select(
        "component", F.col("x.sequence").alias("head_sequence"),
        F.when(F.col("component") == "log-2", "stale").otherwise(F.col("x.event_digest")).alias("head_digest"))
    return C.verify_chain(audit, _content(), heads)


@query("audit_page", """with r as (select event_id as sequence from events where user_id = 17 and event_id < (select 0.8 * max(event_id) from events))
  select sequence, (select count(*) from r) as total, (select count(*) from r) > 25 as truncated from r order by sequence desc limit 25""")
def audit_page(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit("tenant-"), F.col("user_id").cast("string")).alias("tenant_id"), F.col("event_id").alias("sequence"))
    limit = log.agg(0.8 * F.max("sequence")).scalar()
    return C.audit_page(log, "tenant-17", limit, 25).select("sequence", "total", "truncated")


@query("access_audit", """select 'tenant-' || (user_id % 20) as tenant_id, case when event_type = 'error' then 'deny' else 'permit' end as decision,
  case when event_type = 'error' then 'NOT_BOUND' else event_type end as reason, count(*) as events, min(event_id) as first_sequence, max(event_id) as last_sequence from events group by 1, 2, 3""")
def access_audit(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 20).cast("string")).alias("tenant_id"), F.col("event_id").alias("sequence"),
        F.when(F.col("event_type") == "error", "deny").otherwise("permit").alias("decision"),
        F.when(F.col("event_type") == "error", "NOT_BOUND").otherwise(F.col("event_type")).alias("reason"))
    return C.access_audit(log)


@query("verify_receipts", """with r as (select o_orderkey as k, o_custkey as c, o_orderdate as committed, o_totalprice as p, o_orderpriority as pr from orders),
  f as (select k, unnest([case when pr = '1-URGENT' and p > 300000 then 'RECEIPT_INVALID' end, case when k % 41 = 3 then 'RECORD_MISSING' end,
    case when k % 41 <> 3 and k % 37 = 5 then 'RECEIPT_MISMATCH' end,
    case when k % 41 <> 3 and k % 29 = 4 then 'RETENTION_MISMATCH' end, case when k % 43 = 8 then 'CHAIN_BROKEN' end,
    case when k % 47 = 6 then 'RECEIPT_TAMPERED' end]) as code from r)
  select cast(k as varchar) as event_id, code from f where code is not null""")
def verify_receipts(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    until = lambda n: (F.col("o_orderdate") + days(n)).cast("timestamp_ntz")
    records = o.where(k % 41 != 3).select(k.cast("string").alias("event_id"), F.sha2(k.cast("string"), 256).alias("content_digest"),
                                          F.col("o_orderdate").alias("committed_at"), until(F.when(k % 29 == 4, 364).otherwise(365)).alias("retention_until"))
    own = lambda n: F.sha2(F.concat(F.lit("receipt-"), n.cast("string")), 256)
    receipts = o.select(
        k.cast("string").alias("event_id"), (k + 1).alias("sequence"), F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000), "b-2").otherwise("b-1").alias("backend_id"),
        F.sha2(F.when(k % 37 == 5, "other").otherwise(k.cast("string")), 256).alias("content_digest"), until(F.when(k % 29 == 4, 364).otherwise(365)).alias("retention_until"),
        F.when(k > 0, F.when(k % 43 == 8, "broken").otherwise(own(k - 1))).alias("previous_receipt_digest"), own(k).alias("receipt_digest"))
    return C.verify_receipts(records, receipts, 365, "b-1", F.when(F.col("event_id").cast("bigint") % 47 == 6, "x").otherwise(own(F.col("event_id").cast("bigint"))))


@query("state_root", """with d as (select o_orderstatus as component, o_orderpriority as scope, sha256(cast(o_custkey as varchar)) as d from orders),
  c as (select component, scope, d as p, d || ':' || count(*) as v, count(*) as n from d group by 1, 2, 3),
  l1 as (select component, scope, substr(p, 1, 5) as p, sha256(string_agg(v, chr(10) order by p)) as v, sum(n) as n from c group by 1, 2, substr(p, 1, 5)),
  l2 as (select component, scope, substr(p, 1, 2) as p, sha256(string_agg(v, chr(10) order by p)) as v, sum(n) as n from l1 group by 1, 2, substr(p, 1, 2)),
  s as (select component, scope, sha256(sha256(string_agg(v, chr(10) order by p))) as root0, sha256(scope || ':' || sha256(string_agg(v, chr(10) order by p))) as p from l2 group by 1, 2),
  m0 as (select component, p, p || ':' || count(*) as v, count(*) as n from s group by 1, 2),
  m1 as (select component, substr(p, 1, 5) as p, sha256(string_agg(v, chr(10) order by p)) as v, sum(n) as n from m0 group by 1, substr(p, 1, 5)),
  m2 as (select component, substr(p, 1, 2) as p, sha256(string_agg(v, chr(10) order by p)) as v, sum(n) as n from m1 group by 1, substr(p, 1, 2))
  select component, sha256(string_agg(v, chr(10) order by p)) as state_root, cast(sum(n) as bigint) as scopes from m2 group by 1""")
def state_root(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("component"), F.col("o_orderpriority").alias("scope"),
                                             F.sha2(F.col("o_custkey").cast("string"), 256).alias("d"))
    return C.state_root(rows, "component", "scope", "d")


def lifecycle(spark, sf):
    """Line items of an order as steps of a transfer."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    phases = F.array(*[F.lit(p) for p in ("authorized", "provisioned", "active", "terminating", "revoked", "terminated")])
    q = F.col("x.l_quantity").cast("int")
    at = F.when(q % 10 == 0, 0).otherwise(F.least(F.col("l_linenumber") - 1, F.lit(5)))
    return lines.select(
        F.col("l_orderkey").alias("transfer_id"), F.col("l_linenumber").alias("step_no"), F.element_at(phases, at + 1).alias("phase"),
        F.when(q % 9 != 0, F.lit("p")).alias("provisioning_id"), F.lit("d").alias("data_address_digest"), F.lit("t").alias("provisioned_at"),
        F.lit("t").alias("revoked_at"), F.when(q % 8 != 0, F.lit("r")).alias("revoke_receipt_digest"),
        F.when(F.col("x.l_partkey") % 50 == 0, "other").otherwise("agreement").alias("agreement_id"), F.lit("ds").alias("dataset_id"))


@query("lifecycle_findings", """with raw as (select l_orderkey as k, l_linenumber as n, min((l_partkey, l_suppkey, l_quantity)) as x from lineitem group by 1, 2),
  s as (select k, n, cast(x[3] as integer) as q, case when cast(x[3] as integer) % 10 = 0 then 0 else least(n - 1, 5) end as ph, x[1] % 50 = 0 as oth from raw),
  w as (select *, lag(ph) over (partition by k order by n) as pp, lag(oth) over (partition by k order by n) as po from s),
  f as (select k, n, unnest([case when pp is null and ph not in (0, 3) then 'FIRST_PHASE_INVALID' end,
    case when pp is not null and not (pp >= 3 and ph <= 2) and not (pp = ph or (pp, ph) in ((0,1),(1,2),(0,3),(1,3),(2,3),(3,4),(4,5))) then 'TRANSITION_INVALID' end,
    case when pp >= 3 and ph <= 2 then 'TERMINAL_RESTARTED' end,
    case when (ph in (1, 2) and q % 9 = 0) or (ph in (4, 5) and q % 8 = 0) then 'FIELD_MISSING' end,
    case when po is not null and po <> oth then 'IDENTITY_CHANGED' end]) as code from w)
  select k as transfer_id, n as step_no, code from f where code is not null""")
def lifecycle_findings(spark, sf):
    return C.lifecycle_findings(lifecycle(spark, sf), F.floor(F.col("step_no") / 4))


@query("scope_page", """select o_orderkey, o_custkey from orders where o_orderkey > 100 order by o_orderkey limit 50""")
def scope_page(spark, sf):
    return C.page_after(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)
