"""Registry decisions: orders, customers, suppliers and line items read as requests and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.operators import registries as R
from dataward.plans.registry import query
from dataward.sources.tables import table


def text(c):
    return F.col(c).cast("string")


def days(n):
    return F.make_dt_interval(n)


EPOCH = "timestamp '1996-01-01'"


def base():
    return F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")


def approvals(spark: SparkSession, sf: str) -> DataFrame:
    """One approval per customer, in force for a span that depends on its nation."""
    start = base() + days(F.col("c_custkey") % 1000)
    return table(spark, sf, "customer").select(
        F.lit("orders").alias("source_system_id"), text("c_custkey").alias("record_id"), F.lit("1").alias("resource_version"),
        F.sha2((F.col("c_custkey") % 5).cast("string"), 256).alias("record_digest"),
        F.concat(F.lit("approval-"), text("c_custkey")).alias("approval_id"),
        start.cast("timestamp_ntz").alias("approved_at"),
        (start + days(F.col("c_nationkey") * 60 + 30)).cast("timestamp_ntz").alias("valid_until"),
        F.when(F.col("c_mktsegment") == "BUILDING", "qualified").otherwise("public").alias("catalog_visibility"),
        F.when(F.col("c_acctbal") < 0, "denied").otherwise("approved").alias("offering_decision"))


def approval_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey"), F.lit("orders").alias("source_system_id"), text("o_custkey").alias("record_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "2").otherwise("1").alias("resource_version"),
        F.when(F.col("o_orderstatus") == "P", F.sha2(F.lit("other"), 256))
        .otherwise(F.sha2((F.col("o_custkey") % 5).cast("string"), 256)).alias("record_digest"),
        F.col("o_orderdate").alias("evaluated_at"))


_APPROVALS = f"""appr as (select *, {EPOCH} + to_days(cast(c_custkey % 1000 as integer)) as approved_at,
  {EPOCH} + to_days(cast(c_custkey % 1000 + c_nationkey * 60 + 30 as integer)) as valid_until from customer)"""


@query("resolve_approvals", f"""with {_APPROVALS}, r as (select o_orderkey,
  case when o_orderpriority = '5-LOW' then 'APPROVAL_ENTRY_MISSING' when o_orderstatus = 'P' then 'APPROVED_DIGEST_MISMATCH'
    when o_orderdate < approved_at then 'APPROVAL_NOT_YET_VALID' when o_orderdate > valid_until then 'APPROVAL_EXPIRED' end as approval_reason, appr.*
  from orders join appr on c_custkey = o_custkey)
  select o_orderkey, approval_reason, case when approval_reason is null then 'verified-synthetic' else 'unverified' end as approval_status,
    case when approval_reason = 'APPROVAL_NOT_YET_VALID' then approved_at end as next_evaluation_at,
    case when approval_reason is not null then 'internal' when c_mktsegment = 'BUILDING' then 'qualified' else 'public' end as catalog_visibility,
    case when approval_reason is not null then 'pending' when c_acctbal < 0 then 'denied' else 'approved' end as offering_decision from r""")
def resolve_approvals(spark, sf):
    return R.resolve_approvals(approval_requests(spark, sf), approvals(spark, sf), F.col("evaluated_at")).select(
        "o_orderkey", "approval_reason", "approval_status", "next_evaluation_at", "catalog_visibility", "offering_decision")


@query("approval_registry_findings", """select cast(o_orderkey as varchar) as approval_no, case when o_totalprice < 20000 then 'INVALID_APPROVAL_ENTRY'
    when n > 1 then 'DUPLICATE_APPROVAL_ENTRY' end as code
  from (select *, count(*) over (partition by o_custkey, o_orderstatus, o_orderpriority) as n from orders)
  where o_totalprice < 20000 or n > 1""")
def approval_registry_findings(spark, sf):
    reg = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("source_system_id"), text("o_custkey").alias("record_id"),
        F.substring("o_orderpriority", 1, 1).alias("resource_version"), F.sha2(text("o_orderkey"), 256).alias("record_digest"),
        text("o_orderkey").alias("approval_id"), F.col("o_orderdate").alias("approved_at"),
        F.when(F.col("o_totalprice") < 20000, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + days(F.lit(9)))
        .cast("timestamp_ntz").alias("valid_until"), F.lit("public").alias("catalog_visibility"), F.lit("approved").alias("offering_decision"))
    return R.approval_registry_findings(reg).select(F.col("approval_id").alias("approval_no"), "code")


@query("dispatch_gate", f"""with {_APPROVALS} select o_orderkey, case
    when o_orderstatus = 'P' or c_custkey % 11 = 0 then 'DISPATCH_APPROVAL_REQUIRED'
    when o_orderpriority = '5-LOW' then 'DISPATCH_APPROVAL_SOURCE_MISMATCH'
    when not (approved_at <= o_orderdate and valid_until > o_orderdate) then 'DISPATCH_APPROVAL_EXPIRED'
    when o_totalprice > 300000 then 'DISPATCH_APPROVAL_DIGEST_MISMATCH' end as gate_reason
  from orders join appr on c_custkey = o_custkey""")
def dispatch_gate(spark, sf):
    envelopes = approval_requests(spark, sf).join(
        table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey").select(
        "o_orderkey", "source_system_id", "record_id", "resource_version", "evaluated_at",
        F.concat(F.lit("approval-"), "record_id").alias("approval_id"),
        (F.col("o_orderstatus") != "P").alias("automatic_dispatch_allowed"), F.lit("production-connector").alias("routing"),
        F.sha2(F.when(F.col("o_totalprice") > 300000, "changed").otherwise("payload"), 256).alias("payload_digest"))
    reg = approvals(spark, sf).select(
        "approval_id", "source_system_id", "record_id", "resource_version",
        F.when(F.col("record_id").cast("bigint") % 11 == 0, "revoked").otherwise("approved").alias("status"),
        F.lit("operator-1").alias("approved_by"), F.col("approved_at").alias("valid_from"), "valid_until",
        F.sha2(F.lit("payload"), 256).alias("payload_digest"))
    return R.dispatch_gate(envelopes, reg, F.col("evaluated_at")).select("o_orderkey", "gate_reason")


def authority_registry(spark: SparkSession, sf: str) -> DataFrame:
    """One authority per supplier over two assets and two actions; some overlap, some are revoked."""
    k = F.col("s_suppkey")
    did = lambda c: F.concat(F.lit("did:example:p"), c.cast("string"))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("authority-"), k.cast("string")).alias("authority_id"),
        F.lit("did:example:hub").alias("participant_id"), did(F.floor(k / 2)).alias("provider_id"),
        F.lit("warehouse").alias("source_system_id"),
        F.array(F.concat(F.lit("asset-"), (k % 3).cast("string")), F.lit("asset-7")).alias("asset_ids"),
        F.array(F.lit("data-transfer"), F.lit("catalog-publish")).alias("allowed_actions"),
        F.when(k % 7 == 0, "pending").otherwise("approved").alias("decision"),
        F.when(k % 5 == 0, "revoked").otherwise("current").alias("revocation_status"),
        base().alias("effective_from"), (base() + days(F.lit(1200))).cast("timestamp_ntz").alias("valid_until"),
        (base() + days(k % 900)).cast("timestamp_ntz").alias("revocation_checked_at"),
        F.struct(F.concat(F.lit("evidence-"), (k % 40).cast("string")).alias("evidence_id"), F.lit("did:example:issuer").alias("issuer_id"),
                 did(F.floor(k / 2)).alias("subject_id"), F.lit("00").alias("artifact_sha256")).alias("basis"),
        F.struct(F.lit("verified").alias("status"),
                 F.when(k % 13 == 0, "did:example:stranger").otherwise("did:example:issuer").alias("approved_by"),
                 F.lit("did:example:verifier").alias("verified_by"), (base() + days(F.lit(1))).cast("timestamp_ntz").alias("approved_at"),
                 (base() + days(F.lit(2))).cast("timestamp_ntz").alias("verified_at")).alias("approval"))


@query("resolve_authority", """with req as (select l_orderkey, l_linenumber, l_partkey, cast(floor(l_suppkey / 2.0) as bigint) as provider, l_suppkey,
    case when l_partkey % 4 = 3 then 7 else l_partkey % 4 end as asset,
    case l_returnflag when 'A' then 'data-transfer' when 'N' then 'catalog-publish' else 'erase' end as action, l_shipdate as tm from lineitem),
  ent as (select s_suppkey as k, cast(floor(s_suppkey / 2.0) as bigint) as provider, unnest([s_suppkey % 3, 7]) as asset from supplier),
  byk as (select provider, asset, count(*) as n, min(k) as k from ent group by 1, 2),
  j as (select req.*, n, k, timestamp '1996-01-01' + to_days(cast(k % 900 as integer)) as checked from req left join byk using (provider, asset)),
  d as (select *, case when action = 'erase' then 'ACTION_UNSUPPORTED' when tm > timestamp '2001-06-01' then 'REGISTRY_SNAPSHOT_TOO_OLD'
    when n is null then 'AUTHORITY_NOT_FOUND' when n > 1 then 'AUTHORITY_AMBIGUOUS' when k % 7 = 0 then 'AUTHORITY_NOT_APPROVED'
    when k % 5 = 0 then 'AUTHORITY_NOT_CURRENT' when tm < timestamp '1996-01-01' or tm >= timestamp '1996-01-01' + to_days(1200) then 'AUTHORITY_OUTSIDE_VALIDITY'
    when checked > tm then 'REVOCATION_EVIDENCE_FROM_FUTURE' when tm > checked + to_days(700) then 'REVOCATION_EVIDENCE_STALE'
    when l_suppkey % 2 = 0 then 'AUTHORITY_VERIFICATION_REQUIRED' when l_partkey % 6 = 0 then 'AUTHORITY_VERIFICATION_INVALID'
    when l_partkey % 9 = 0 then 'AUTHORITY_SIGNATURE_UNVERIFIED' end as denial from j)
  select denial, case when n = 1 and denial is distinct from 'ACTION_UNSUPPORTED' and denial is distinct from 'REGISTRY_SNAPSHOT_TOO_OLD' then 'authority-' || k end as authority_id, denial is null as allowed, count(*) as requests from d group by 1, 2, 3""")
def resolve_authority(spark, sf):
    p = F.col("l_partkey")
    requests = table(spark, sf, "lineitem").select(
        F.lit("did:example:hub").alias("participant_id"),
        F.concat(F.lit("did:example:p"), F.floor(F.col("l_suppkey") / 2).cast("string")).alias("provider_id"),
        F.lit("warehouse").alias("source_system_id"),
        F.concat(F.lit("asset-"), F.when(p % 4 == 3, 7).otherwise(p % 4).cast("string")).alias("asset_id"),
        F.when(F.col("l_returnflag") == "A", "data-transfer").when(F.col("l_returnflag") == "N", "catalog-publish")
        .otherwise("erase").alias("action"),
        F.concat(F.lit("request-"), text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("decision_request_id"),
        F.col("l_shipdate").alias("evaluated_at"), (F.col("l_suppkey") % 2 != 0).alias("receipt_present"),
        (p % 6 != 0).alias("receipt_matches"), F.col("l_shipdate").alias("receipt_verified_at"), (p % 9 != 0).alias("signature_verified"))
    out = R.resolve_authority(requests, authority_registry(spark, sf), "2001-06-01 00:00:00", 700 * 86400)
    return out.groupBy("denial", "authority_id", "allowed").agg(F.count(F.lit(1)).alias("requests"))


@query("authority_findings", """with s as (select s_suppkey as k, count(*) over (partition by s_suppkey % 40) as ev from supplier),
  f as (select k, unnest([case when ev > 1 then 'DUPLICATE_EVIDENCE_ID' end,
    case when k % 900 > 500 then 'REVOCATION_CHECK_AFTER_AS_OF' end,
    case when k % 7 <> 0 and k % 5 = 0 then 'APPROVED_NOT_CURRENT' end, case when k % 7 <> 0 and k % 13 = 0 then 'SIGNER_NOT_ISSUER' end,
    case when k % 7 <> 0 and k % 900 < 2 then 'REVOCATION_PREDATES_VERIFICATION' end]) as code from s)
  select 'authority-' || k as authority_id, code from f where code is not null""")
def authority_findings(spark, sf):
    return R.authority_findings(authority_registry(spark, sf), "1997-05-15 00:00:00")


@query("authority_release_decision", """select case when count(*) > 0 then 'eligible-after-runtime-verification' else 'blocked-no-approved-authority' end as release_decision
  from supplier where s_suppkey % 7 <> 0 and s_suppkey % 5 <> 0 and s_suppkey % 900 <= 500 and s_suppkey % 900 >= 400""")
def authority_release_decision(spark, sf):
    return R.authority_release_decision(authority_registry(spark, sf), "1997-05-15 00:00:00", 100 * 86400)


HEADER = {"status": "READY", "issued_at": "1998-01-01 00:00:00", "valid_until": "1998-12-31 00:00:00", "max_age_seconds": 200 * 86400}


@query("memberships", """select o_orderkey, case when c_custkey is null or c_custkey % 9 = 0 then 'APPROVAL_DECISION_NOT_TRUSTED'
    when c_mktsegment = 'BUILDING' then 'APPROVAL_DECISION_NOT_APPROVED' when o_orderpriority = '5-LOW' then 'APPROVAL_DECISION_MISMATCH'
    when timestamp '1997-01-01' + to_days(c_nationkey * 20) > timestamp '1998-03-01' or
         timestamp '1997-01-01' + to_days(c_nationkey * 20 + 300) < timestamp '1998-03-01' then 'APPROVAL_DECISION_EXPIRED' end as membership_reason
  from orders left join customer on c_custkey = o_custkey""")
def memberships(spark, sf):
    start = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz") + days(F.col("c_nationkey") * 20)
    decisions = table(spark, sf, "customer").where(F.col("c_custkey") % 9 != 0).select(
        text("c_custkey").alias("decision_id"), F.lit("space-a").alias("dataspace_id"), text("c_custkey").alias("participant_id"),
        F.lit("org").alias("organization_id"), F.sha2(text("c_custkey"), 256).alias("evidence_sha256"),
        F.when(F.col("c_mktsegment") == "BUILDING", "DENIED").otherwise("APPROVED").alias("status"),
        start.cast("timestamp_ntz").alias("decided_at"), (start + days(F.lit(300))).cast("timestamp_ntz").alias("valid_until"))
    participants = table(spark, sf, "orders").select(
        "o_orderkey", text("o_custkey").alias("decision_id"), F.lit("space-a").alias("dataspace_id"), text("o_custkey").alias("participant_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "else").otherwise("org").alias("organization_id"), F.sha2(text("o_custkey"), 256).alias("evidence_sha256"))
    return R.verify_memberships(participants, decisions, "1998-03-01 00:00:00", HEADER).select("o_orderkey", "membership_reason")


def spaces(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as data spaces that each need up to three services."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        text("c_custkey").alias("space_id"),
        F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(*[
            F.concat(F.lit("svc-"), ((k * m) % 130).cast("string")) for m in (1, 3, 7)]))).alias("required_service_ids"))


def services(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as services with the time they were last observed."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("svc-"), k.cast("string")).alias("service_id"), F.when(k % 11 == 0, "DEGRADED").otherwise("READY").alias("status"),
        (F.lit("1998-03-01 00:00:00").cast("timestamp_ntz") - days(k * 3)).cast("timestamp_ntz").alias("observed_at"))


_NEED = """need as (select c_custkey, 'svc-' || unnest(list_distinct([c_custkey % 130, c_custkey * 3 % 130, c_custkey * 7 % 130])) as service_id
    from customer where c_custkey % 10 <> 0),
  svc as (select 'svc-' || s_suppkey as service_id, case when s_suppkey % 11 = 0 then 'DEGRADED' else 'READY' end as status,
    timestamp '1998-03-01' - to_days(cast(s_suppkey * 3 as integer)) as observed_at from supplier),
  st as (select c_custkey, case when status is null then 'MISSING' when observed_at < timestamp '1998-03-01' - to_days(200) then 'STALE' else status end as eff,
    observed_at from need left join svc using (service_id))"""


@query("service_readiness", f"""with {_NEED} select cast(c.c_custkey as varchar) as space_id, coalesce(bool_and(eff = 'READY'), true) as ready,
  count(*) filter (where eff = 'MISSING') as missing, count(*) filter (where eff = 'STALE') as stale
  from customer c left join st using (c_custkey) group by 1""")
def service_readiness(spark, sf):
    return R.service_readiness(spaces(spark, sf), services(spark, sf), "1998-03-01 00:00:00", HEADER)


@query("next_check", f"""with {_NEED}, p as (select o_custkey, min(o_orderdate) as d from orders where o_orderstatus = 'F' group by 1),
  s as (select c_custkey, min(observed_at) as o from st group by 1)
  select cast(c.c_custkey as varchar) as space_id, least(case when d is not null then least(timestamp '1998-12-31', timestamp '1998-01-01' + to_days(200), d) end,
    timestamp '1998-12-31', timestamp '1998-01-01' + to_days(200), o + to_days(200)) + interval 1 millisecond as next_check_at
  from customer c left join p on o_custkey = c.c_custkey left join s using (c_custkey)""")
def next_check(spark, sf):
    participants = table(spark, sf, "orders").select(
        text("o_custkey").alias("space_id"), F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("SUBMITTED").alias("approval_state"),
        F.col("o_orderdate").alias("decision_valid_until"))
    return R.next_check(spaces(spark, sf), participants, services(spark, sf), HEADER, HEADER)


@query("drift_targets", """with s as (select o_orderkey, o_orderpriority = '1-URGENT' as old_reg, o_totalprice > 350000 as moved, o_orderstatus = 'P' as open,
    o_orderdate <= timestamp '1996-06-01' as due, o_custkey % 3 > 0 as has_approved from orders)
  select o_orderkey, has_approved and old_reg as approval_refresh, moved as service_change, open as deadline_missing,
    (not open) and due as deadline_due from s where (has_approved and old_reg) or moved or open or due""")
def drift_targets(spark, sf):
    o = table(spark, sf, "orders")
    sp = o.select("o_orderkey", text("o_orderkey").alias("space_id"), (F.col("o_custkey") % 3).alias("approved_count"),
                  F.when(F.col("o_orderpriority") == "1-URGENT", "old").otherwise("now").alias("approval_registry_sha256"),
                  F.lit("svc-now").alias("service_registry_sha256"), F.sha2(text("o_custkey"), 256).alias("services_sha256"),
                  F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("next_check_at"))
    current = o.select(text("o_orderkey").alias("space_id"),
                       F.when(F.col("o_totalprice") > 350000, F.lit("moved")).otherwise(F.sha2(text("o_custkey"), 256)).alias("services_sha256"))
    return R.drift_targets(sp, "now", "svc-now", current, "1996-06-01 00:00:00").select(
        "o_orderkey", "approval_refresh", "service_change", "deadline_missing", "deadline_due")


@query("reconciliation_backlog", """with s as (select o_custkey, max(o_orderdate) filter (where o_orderstatus = 'P' and o_totalprice > 450000) as retry,
    bool_or(o_orderpriority = '1-URGENT' and o_totalprice > 400000) as re, bool_or(o_totalprice > 480000) as busy, count(*) > 8 as pend from orders group by 1)
  select o_custkey, case when retry is not null then 'failing' else 'blocked' end as state,
    case when retry is null then case when re then 'APPROVAL_BLOCKED' when busy then 'REQUIRED_SERVICE_BLOCKED' else 'RECONCILIATION_BLOCKED' end end as error_code
  from s where retry is not null or pend""")
def reconciliation_backlog(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_totalprice")
    sp = o.groupBy("o_custkey").agg(
        F.max(F.when((F.col("o_orderstatus") == "P") & (p > 450000), F.col("o_orderdate"))).alias("next_retry_at"),
        F.collect_set(F.when((F.col("o_orderpriority") == "1-URGENT") & (p > 400000), "REAPPROVAL_REQUIRED").otherwise("APPROVED")).alias("approval_states"),
        F.collect_set(F.when(p > 480000, "DEGRADED").otherwise("READY")).alias("service_states"), (F.count(F.lit(1)) > 8).alias("reconcile_pending"))
    return R.backlog(sp).select("o_custkey", "state", "error_code")


@query("resolve_bindings", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when p_partkey is not null and p_size > 10 then 'b-' || p_partkey end as binding_id,
  case when p_partkey is null or p_size <= 10 then 'TRANSFER_BINDING_NOT_FOUND' end as error
  from lineitem left join part on p_partkey = l_partkey and (p_size % 3) = l_linenumber % 3""")
def resolve_bindings(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("dataset_id"), (F.col("l_linenumber") % 3).alias("format"))
    bindings = table(spark, sf, "part").select(
        F.col("p_partkey").alias("dataset_id"), (F.col("p_size") % 3).alias("format"), F.concat(F.lit("b-"), text("p_partkey")).alias("binding_id"),
        F.lit("pull-1").alias("provisioner_id"), (F.col("p_size") > 10).alias("enabled"))
    return R.resolve_bindings(requests, bindings).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "binding_id", "error")


@query("orphans", """select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def orphans(spark, sf):
    registered = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.orphans(table(spark, sf, "orders").select("o_orderkey"), registered, ["o_orderkey"])


def principals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("role_"), (F.col("s_suppkey") % 5).cast("string")).alias("database_role"), F.concat(F.lit("t"), (F.col("s_suppkey") % 25).cast("string")).alias("tenant_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "break-glass").otherwise("tenant").alias("access_mode"), (F.col("s_acctbal") > 0).alias("active"),
        F.lit(None).cast("timestamp_ntz").alias("valid_until"))


@query("visible_rows", """select c_custkey, 'tenant' as seen_by from customer where c_nationkey = 7 and exists (select 1 from supplier where s_suppkey % 5 = 2
    and s_suppkey % 25 = 7 and s_suppkey % 3 <> 0 and s_acctbal > 0)
  union all select c_custkey, 'break-glass' from customer where exists (select 1 from supplier where s_suppkey % 5 = 2
    and s_suppkey % 25 = 7 and s_suppkey % 3 = 0 and s_acctbal > 0)""")
def visible_rows(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("t"), text("c_nationkey")).alias("tenant_id"))
    ctx = {"database_role": "role_2", "tenant_id": "t7", "actor_id": "actor", "now": "2024-01-01 00:00:00"}
    glass = {**ctx, "access_mode": "break-glass", "break_glass_reason": "incident 4711", "break_glass_expires_at": "2024-01-01 01:00:00"}
    p = principals(spark, sf)
    own = R.visible_rows(rows, p, {**ctx, "access_mode": "tenant"}).select("c_custkey", F.lit("tenant").alias("seen_by"))
    return own.unionByName(R.visible_rows(rows, p, glass).select("c_custkey", F.lit("break-glass").alias("seen_by")))


@query("revocation_status", """with reg as (select o_custkey, arg_max(o_orderstatus, o_orderkey) as s, max(o_orderdate) as tm from orders group by 1)
  select c_custkey, case when s is null or s = 'P' then 'UNAVAILABLE' when tm < timestamp '2000-06-01' or tm > timestamp '2001-07-15'
    or tm < timestamp '2001-07-15' - to_days(300) then 'STALE' when s = 'F' then 'REVOKED' else 'VALID' end as revocation
  from customer left join reg on o_custkey = c_custkey""")
def revocation_status(spark, sf):
    status = F.max_by("o_orderstatus", "o_orderkey")
    reg = table(spark, sf, "orders").groupBy("o_custkey").agg(status.alias("s"), F.max("o_orderdate").alias("observed_at")).select(
        F.lit("iss").alias("issuer"), text("o_custkey").alias("subject"), text("o_custkey").alias("token_id"),
        F.when(F.col("s") == "F", "REVOKED").when(F.col("s") == "O", "VALID").otherwise("UNKNOWN").alias("status"), "observed_at")
    tokens = table(spark, sf, "customer").select(
        "c_custkey", F.lit("iss").alias("issuer"), text("c_custkey").alias("subject"), text("c_custkey").alias("token_id"),
        F.lit("2000-06-01 00:00:00").cast("timestamp_ntz").alias("issued_at"))
    return R.revocation_status(tokens, reg, "2001-07-15 00:00:00", 300 * 86400).select("c_custkey", "revocation")


@query("identifier_collisions", """with u as (select o_orderkey, unnest(['customer', 'price', 'date']) as field,
    unnest([cast(o_custkey as varchar), cast(cast(floor(o_totalprice) as bigint) as varchar), strftime(o_orderdate, '%Y-%m-%d')]) as value from orders)
  select field, value, count(*) as owners, min(o_orderkey) as first_owner from u group by 1, 2 having count(*) > 1""")
def identifier_collisions(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("customer"), F.floor("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return R.identifier_collisions(o, ["customer", "price", "date"], "o_orderkey")


@query("release_eligibility", """with b as (select cast(p_partkey as varchar) as blocker_id, case when p_size > 25 then 'pilot' end as scope, case when p_partkey % 2 = 0 then 'open' else 'closed' end as status from part
    union all select 'supplier-' || s_suppkey, 'pilot', 'open' from supplier where s_acctbal < 0),
  e as (select cast(l_partkey as varchar) as blocker_id, bool_or(l_tax >= 0.08 and l_discount >= 0.1) as failed from lineitem group by 1)
  select coalesce(scope, 'production') as scope, st as effective_status, count(*) as blockers, count(*) filter (where st <> 'closed') as open_blockers,
    count(*) filter (where st <> 'closed') = 0 as eligible from
  (select b.*, case when coalesce(failed, false) then 'evidence-failed' when try_cast(blocker_id as bigint) % 6 = 0 then 'closed' else status end as st
   from b left join e using (blocker_id)) group by 1, 2""")
def release_eligibility(spark, sf):
    part = table(spark, sf, "part")
    blockers = part.select(text("p_partkey").alias("blocker_id"), F.when(F.col("p_size") > 25, "pilot").alias("scope"),
                           F.when(F.col("p_partkey") % 2 == 0, "open").otherwise("closed").alias("status"))
    overrides = part.where(F.col("p_partkey") % 6 == 0).select(text("p_partkey").alias("blocker_id"), F.lit("closed").alias("status"))
    evidence = table(spark, sf, "lineitem").select(text("l_partkey").alias("blocker_id"),
                                                   ((F.col("l_tax") < 0.08) | (F.col("l_discount") < 0.1)).alias("passed"))
    extra = table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(
        F.concat(F.lit("supplier-"), text("s_suppkey")).alias("blocker_id"), F.lit("pilot").alias("scope"), F.lit("open").alias("status"))
    return (R.release_eligibility(blockers, overrides, evidence, extra).groupBy("scope", "effective_status")
            .agg(F.count(F.lit(1)).alias("blockers"), F.count_if("open").alias("open_blockers"))
            .withColumn("eligible", F.col("open_blockers") == 0))


@query("gate_readiness", """with r as (select o_orderkey, unnest([o_custkey, o_custkey + 5]) as b, o_orderpriority as pr, o_orderdate as tm, o_totalprice as p from orders),
  u as (select *, count(*) over (partition by b) as uses from r)
  select o_orderkey, b as blocker_no, case when b >= (select count(*) from customer) then 'UNKNOWN_BLOCKER' when uses > 1 then 'DUPLICATE_BLOCKER' when pr = '1-URGENT' then 'EVIDENCE_MISSING'
    when p > 400000 then 'EVIDENCE_DIGEST_MISMATCH' when tm > timestamp '2000-01-01' then 'EVIDENCE_FROM_FUTURE'
    when tm < timestamp '2000-01-01' - to_days(900) then 'EVIDENCE_STALE' end as problem from u""")
def gate_readiness(spark, sf):
    gates = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("gate_id"), F.array("o_custkey", F.col("o_custkey") + 5).alias("blocker_ids"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.when(F.col("o_totalprice") > 400000, "x").otherwise("y")).alias("evidence_sha256"),
        F.lit("y").alias("expected_sha256"), F.col("o_orderdate").alias("evidence_at"))
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("blocker_id"))
    return R.readiness(gates, expected, "2000-01-01 00:00:00", 900).select(
        F.col("gate_id").alias("o_orderkey"), F.col("blocker_id").alias("blocker_no"), "problem")
