"""Harvest synchronisation: line items as versioned change events, parts as catalogue records."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.operators import offering as O
from dataward.operators import sync as S
from dataward.plans.registry import query
from dataward.sources.tables import table

CFG = O.ProjectionConfig("urn:example:space", "connector-1", "https://connector.invalid/dsp")
NOW = "2024-06-01 00:00:00"
_DAY = 8 * 10**14


def text(c):
    return F.col(c).cast("string")


def pos_of():
    """Position of a line item: ship day, part, supplier, line number."""
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint")
    return ((day * 10**8 + F.col("l_partkey")) * 10**6 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")


_POS = "((date_diff('day', date '1995-01-01', cast(l_shipdate as date)) * 100000000 + l_partkey) * 1000000 + l_suppkey) * 8 + l_linenumber"


def change_events(spark, sf):
    l = F.col
    return table(spark, sf, "lineitem").select(
        F.lit("orders").alias("source_system_id"), F.lit("batch-1").alias("batch_id"), text("l_orderkey").alias("record_id"), text("l_linenumber").alias("resource_version"),
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("event_id"), pos_of().alias("pos"),
        F.when(l("l_returnflag") == "R", "record.deleted").otherwise("record.upsert").alias("event_type"), F.sha2((l("l_partkey") % 3).cast("string"), 256).alias("event_digest"),
        (l("l_suppkey") % 10 == 0).alias("_seen"), (l("l_partkey") % 50 == 0).alias("_reused"))


def event_state(spark, sf):
    o = F.col
    return table(spark, sf, "orders").where(o("o_orderkey") % 3 == 0).select(
        F.lit("orders").alias("source_system_id"), text("o_orderkey").alias("record_id"), (o("o_custkey") % 4).cast("string").alias("resource_version"),
        F.sha2((o("o_custkey") % 3).cast("string"), 256).alias("event_digest"), ((o("o_orderstatus") == "P") & (o("o_custkey") % 8 == 1)).alias("withdrawn"))


def ledger(spark, sf):
    return change_events(spark, sf).where("_seen").groupBy("source_system_id", "event_id").agg(
        F.min("record_id").alias("record_id"), F.min(F.when(F.col("_reused"), "other").otherwise(F.col("event_digest"))).alias("event_digest"))


_CLASSIFY = f"""ev as (select l_orderkey as k, cast(l_linenumber as bigint) as v, {_POS} as pos, l_returnflag = 'R' as tomb, sha256(cast(l_partkey % 3 as varchar)) as d,
    l_suppkey % 10 = 0 as seen, l_partkey % 50 = 0 as reused, l_partkey, l_suppkey from lineitem),
  st as (select o_orderkey as k, (o_custkey % 4, 1, sha256(cast(o_custkey % 3 as varchar)), o_orderstatus = 'P' and o_custkey % 8 = 1) as held from orders where o_orderkey % 3 = 0),
  w as (select *, max(case when not seen then (v, -pos, d, tomb) end) over (partition by k order by pos rows between unbounded preceding and 1 preceding) as r from ev),
  b as (select w.*, case when r is null then held when held is null then r else greatest(r, held) end as best from w left join st using (k)),
  c as (select *, case when seen then 'duplicate' when v < best[1] then 'stale' when v = best[1] then 'duplicate-version' when tomb then 'withdrawn' else 'applied' end as result from b),
  cl as (select *, case when seen and reused then 'EVENT_ID_CONFLICT' when result = 'duplicate-version' and best[3] <> d then 'RESOURCE_VERSION_CONFLICT'
    when result = 'applied' and coalesce(best[4], false) then 'TERMINAL_RECORD_REVIVAL' end as conflict from c)"""


def classified(spark, sf):
    return S.classify_events(change_events(spark, sf), event_state(spark, sf), ledger(spark, sf), 30 * _DAY)


@query("classify_events", f"with {_CLASSIFY} select cast(k as varchar) as record_id, pos, result, conflict from cl")
def classify_events(spark, sf):
    return classified(spark, sf).select("record_id", "pos", "result", "conflict")


@query("batch_verdict", f"with {_CLASSIFY} select 'batch-1' as batch_id, count(conflict) = 0 as accepted, arg_min(conflict, pos) filter (where conflict is not null) as conflict from cl")
def batch_verdict(spark, sf):
    return S.batch_verdict(classified(spark, sf)).select("batch_id", "accepted", "conflict")


@query("latest_per_key", f"""with {_CLASSIFY}, a as (select * from cl where result in ('applied', 'withdrawn') and conflict is null)
  select cast(k as varchar) as record_id, cast(max(v) as varchar) as resource_version, arg_max(result, v) as result from a group by 1""")
def latest_per_key(spark, sf):
    done = classified(spark, sf).where(F.col("result").isin("applied", "withdrawn") & F.col("conflict").isNull())
    # Only these columns are asked for, so no others are shuffled, and both ways through ``running`` read the same join with the ledger.
    return S.latest_per_key(done.select(*S.KEY, "resource_version", "result")).select("record_id", "resource_version", "result")


@query("sync_report", f"""with {_CLASSIFY} select 'batch-1' as batch_id, count(*) filter (where result in ('applied', 'withdrawn')) as applied,
  count(*) filter (where result in ('duplicate', 'duplicate-version')) as duplicates, count(*) filter (where result = 'stale') as stale,
  count(*) filter (where result = 'withdrawn') as withdrawn, count(*) filter (where result = 'applied' and v % 2 = 0) as approved from cl""")
def sync_report(spark, sf):
    decided = classified(spark, sf).withColumn("decision_state", F.when(F.col("resource_version").cast("int") % 2 == 0, "APPROVED").otherwise("PENDING_EVIDENCE"))
    return S.sync_report(decided).select("batch_id", "applied", "duplicates", "stale", "withdrawn", "approved")


@query("event_validation", """with o as (select *, count(*) over (partition by o_custkey, o_orderstatus, cast(o_orderdate as date)) as n from orders)
  select o_orderkey, concat_ws(',', case when o_orderpriority = '5-LOW' then 'INVALID_IDENTIFIER' end, case when o_totalprice > 480000 then 'INVALID_EVENT_TYPE' end,
    case when o_custkey % 9 = 0 then 'INVALID_RESOURCE_VERSION' end, case when o_custkey % 10 = 3 then 'INVALID_TIMESTAMP' end, case when o_orderstatus = 'F' and o_orderkey % 6 = 1 and not o_totalprice > 480000 then 'INVALID_EVENT' end,
    case when o_custkey % 14 = 2 and o_orderstatus <> 'F' and not o_totalprice > 480000 then 'INLINE_SECRET_VALUE' end,
    case when o_orderdate > timestamp '2001-07-01 00:05:00' and o_custkey % 10 <> 3 then 'SOURCE_EVENT_TIME_AHEAD' end, case when n > 1 then 'DUPLICATE_EVENT_IN_BATCH' end) as errors from o""")
def event_validation(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_custkey")
    deleted = F.col("o_orderstatus") == "F"
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    title = F.when(k % 14 == 2, "password: hunter22").otherwise("plain")
    record = F.when(~deleted | (F.col("o_orderkey") % 6 == 1), F.struct(title.alias("title")))
    ev = o.select(
        "o_orderkey", F.lit("b-1").alias("batch_id"), F.lit("orders").alias("source_system_id"), F.lit("delta").alias("mode"),
        F.lit("2001-07-01T00:00:00Z").alias("observed_at"), F.when(k % 10 == 3, F.concat(F.substring(stamp, 1, 8), F.lit("32T00:00:00Z"))).otherwise(stamp).alias("occurred_at"),
        F.concat_ws(":", text("o_custkey"), "o_orderstatus", F.substring(stamp, 1, 10)).alias("event_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(text("o_orderkey"), F.lit(" x"))).otherwise(text("o_orderkey")).alias("record_id"),
        F.when(F.col("o_totalprice") > 480000, "record.other").when(deleted, "record.deleted").otherwise("record.upsert").alias("event_type"),
        F.when(k % 9 == 0, F.concat(F.lit("0"), text("o_custkey"))).otherwise(text("o_custkey")).alias("resource_version"), record.alias("record"))
    return O.validate_events(ev).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


def records(spark, sf):
    """Parts as catalogue records with every kind of gap."""
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    ev = lambda ok: F.when(ok, F.array(F.lit("ev-1"), F.lit("ev-2"), F.lit("ev-1"))).otherwise(none)
    host = lambda path: F.concat(F.lit("https://data.invalid/" + path + "/"), k.cast("string"))
    dist = lambda n, fmt: F.struct(
        F.lit(f"d{n}").alias("id"), F.lit("http-pull").alias("access_profile"), F.lit("CSV").alias("format"),
        F.when(k % 21 != 4, F.lit(fmt)).alias("transfer_format"), F.lit("https://www.iana.org/assignments/media-types/text/csv").alias("media_type"),
        F.when(k % 14 != 6, F.concat(F.lit("binding://store/"), k.cast("string"))).alias("source_binding_ref"),
        F.when(k % 7 == 1, "token").when(k % 7 != 0, "none").alias("lifecycle_mode"), F.lit(None).cast("string").alias("revocation_mode"), ev(k % 12 != 5).alias("evidence_ids"))
    dists = (F.when(k % 8 == 0, F.array().cast(O._distribution_type())).when(k % 8 == 1, F.array(dist(1, "transfer:http"), dist(2, "transfer:http")))
             .otherwise(F.array(dist(1, "transfer:http"), dist(2, "transfer:file"))))
    role = F.when(k % 6 != 0, F.struct(F.when(k % 6 == 1, "index-only").otherwise("hosted").alias("value"), ev(k % 6 != 2).alias("evidence_ids")))
    rec = F.struct(
        F.when(size % 11 == 0, "post").when(k % 97 == 5, "movie").otherwise("dataset").alias("record_type"),
        F.when(k % 89 == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.struct(F.concat(F.lit("urn:example:org:"), F.regexp_replace("p_brand", "#", "-")).alias("id"), F.col("p_brand").alias("name")).alias("publisher"),
        F.when(k % 83 == 7, F.lit("http://data.invalid/x")).when(k % 79 == 2, F.lit("https://data.invalid/x?token=1")).otherwise(host("page")).alias("landing_page"),
        F.lit("2024-01-01T00:00:00Z").alias("issued_at"), F.lit("2024-02-28T00:00:00+09:00").alias("modified_at"),
        F.array(F.lit(" a "), F.lit("b"), F.lit("a")).alias("keywords"), F.array(F.lit("urn:example:theme:roads")).alias("themes"), ev(F.lit(True)).alias("evidence_ids"),
        F.when(size % 7 == 1, "excluded").when(size % 7 == 2, "restricted").when(size % 7 != 0, "open").alias("access_rights"),
        F.when(k % 5 != 0, host("license")).alias("license"), F.when(k % 10 == 5, F.lit("own rights")).alias("rights"), F.when(k % 13 != 0, F.lit("holder-1")).alias("origin_data_holder_id"),
        F.when(k % 17 != 0, F.lit("provider-1")).alias("provider_participant_id"), F.when(k % 19 != 0, F.lit("operator-1")).alias("connector_operator_id"),
        F.lit("operator-2").alias("delivery_operator_id"), F.lit("party-1").alias("contracting_party_id"), role.alias("platform_record_role"),
        F.when(k % 23 != 0, F.struct(F.lit("owner").alias("kind"), ev(k % 31 != 0).alias("evidence_ids"))).alias("provider_authority"),
        F.when(k % 9 != 0, F.lit("approved")).alias("transfer_decision"), F.when(k % 29 != 0, F.lit("policy:open")).alias("policy_ref"), dists.alias("distributions"))
    return table(spark, sf, "part").select("p_partkey", F.lit("parts").alias("source_system_id"), k.cast("string").alias("record_id"), F.lit("1").alias("resource_version"),
                                           F.sha2(k.cast("string"), 256).alias("record_digest"), rec.cast(O.RECORD_SCHEMA.replace("\n", "")).alias("record"))


def record_approvals(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").where(k % 11 != 4).select(
        F.lit("parts").alias("source_system_id"), k.cast("string").alias("record_id"), F.lit("1").alias("resource_version"), F.sha2(k.cast("string"), 256).alias("record_digest"),
        F.concat(F.lit("approval-"), k.cast("string")).alias("approval_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("approved_at"),
        F.lit("2024-12-31 00:00:00").cast("timestamp_ntz").alias("valid_until"), F.when(k % 16 == 3, "qualified").otherwise("public").alias("catalog_visibility"),
        F.when(k % 15 == 7, "pending").otherwise("approved").alias("offering_decision"))


def decided(spark, sf):
    return O.decide(records(spark, sf), record_approvals(spark, sf), CFG, NOW)


def _sql_reasons() -> str:
    one = lambda i, same: f"""case when k % 21 = 4 then 'MISSING_TRANSFER_FORMAT' end, {"case when k % 8 = 1 and k % 21 <> 4 then 'AMBIGUOUS_TRANSFER_FORMAT' end," if same else ""}
      case when k % 14 = 6 then 'MISSING_SOURCE_BINDING' end, case when k % 12 = 5 then 'MISSING_DISTRIBUTION_EVIDENCE' end, case when k % 7 = 0 then 'MISSING_LIFECYCLE_MODE' end, case when k % 7 = 1 then 'MISSING_REVOCATION' end"""
    return f"""pt as (select *, p_partkey as k, p_partkey % 11 <> 4 as verified, case when p_partkey % 11 = 4 then 'internal' when p_partkey % 16 = 3 then 'qualified' else 'public' end as vis,
    case when p_size % 11 = 0 then 'post' else 'dataset' end as rt, case p_size % 7 when 1 then 'excluded' when 2 then 'restricted' when 0 then 'unknown' else 'open' end as acc from part),
  err as (select *, case when p_size % 11 <> 0 and k % 97 = 5 then 'INVALID_RECORD_TYPE' when k % 89 = 3 then 'INVALID_FIELD' when k % 83 = 7 then 'INSECURE_URL' when k % 79 = 2 then 'SECRET_URL_PARAMETER' end as err,
    case when p_size % 11 <> 0 and k % 97 = 5 then 'recordType' when k % 89 = 3 then 'record.title' when k % 83 = 7 or k % 79 = 2 then 'record.landingPage' end as err_field from pt),
  rs as (select *, case when rt <> 'dataset' then 'NOT_DATASET' when acc = 'excluded' then 'ACCESS_EXCLUDED' when k % 6 = 1 then 'INDEX_ONLY' else concat_ws(',',
      case when not verified then 'GOVERNANCE_APPROVAL_MISSING' end, case when verified and k % 15 = 7 then 'GOVERNANCE_OFFERING_NOT_APPROVED' end, case when vis <> 'public' then 'CATALOG_NOT_PUBLIC' end,
      case when acc = 'unknown' then 'ACCESS_RIGHTS_UNKNOWN' end, case when acc = 'restricted' then 'ACCESS_PROFILE_UNIMPLEMENTED' end, case when k % 6 = 0 then 'ROLE_UNKNOWN' end,
      case when k % 6 = 2 then 'MISSING_ROLE_EVIDENCE' end, case when k % 13 = 0 then 'MISSING_DATA_HOLDER' end, case when k % 17 = 0 then 'MISSING_PROVIDER_PARTICIPANT' end,
      case when k % 19 = 0 then 'MISSING_OPERATING_ROLE' end, case when k % 23 = 0 or k % 31 = 0 then 'MISSING_PROVIDER_AUTHORITY' end, case when k % 5 = 0 and k % 10 <> 5 then 'MISSING_RIGHTS' end,
      case when k % 29 = 0 then 'MISSING_POLICY' end, case when k % 9 = 0 then 'TRANSFER_NOT_APPROVED' end, case when k % 8 = 0 then 'MISSING_DISTRIBUTION' end,
      case when k % 8 <> 0 then nullif(concat_ws(',', {one(1, False)}, {one(2, True)}), '') end) end as reasons from err),
  dec as (select *, case when err is not null then 'QUARANTINED' when rt <> 'dataset' then 'CATALOG_ONLY' when acc = 'excluded' then 'QUARANTINED' when k % 6 = 1 then 'CATALOG_ONLY' when reasons <> '' then 'PENDING_EVIDENCE' else 'APPROVED' end as st,
    case when err is not null or (rt = 'dataset' and acc = 'excluded') then 'RECORD_QUARANTINED' when not verified then 'DISCOVERY_APPROVAL_MISSING' when vis <> 'public' then 'DISCOVERY_NOT_PUBLIC'
      when rt = 'dataset' and acc <> 'open' then 'S1_NON_OPEN_DISCOVERY_BLOCKED' else 'SYNTHETIC_PUBLIC_APPROVAL' end as disc from rs)"""


_DECIDED = _sql_reasons()


@query("offering_decisions", f"with {_DECIDED} select p_partkey, st as decision_state, reasons from dec where err is null")
def offering_decisions(spark, sf):
    return decided(spark, sf).where(F.size("record_errors") == 0).select(
        "p_partkey", "decision_state", F.array_join(F.transform("decision_reasons", lambda r: r["code"]), ",").alias("reasons"))


@query("record_quarantine", f"with {_DECIDED} select p_partkey, err as error_code, err_field as error_field from dec where err is not null")
def record_quarantine(spark, sf):
    _, bad = O.split_quarantine(O.normalize_records(records(spark, sf), CFG))
    return bad.select("p_partkey", "error_code", "error_field")


@query("record_normal_form", f"""with {_DECIDED} select p_partkey, p_name as title, 'a,b' as keywords, 'ev-1,ev-2' as evidence_ids, case when rt = 'dataset' then acc end as access_rights,
  case when rt = 'dataset' then case when k % 9 = 0 then 'pending' else 'approved' end end as transfer_decision from dec where err is null""")
def record_normal_form(spark, sf):
    good, _ = O.split_quarantine(O.normalize_records(records(spark, sf), CFG))
    c = lambda n: F.col(f"canonical.{n}")
    return good.select("p_partkey", c("title").alias("title"), F.array_join(c("keywords"), ",").alias("keywords"), F.array_join(c("evidence_ids"), ",").alias("evidence_ids"),
                       c("access_rights").alias("access_rights"), c("transfer_decision").alias("transfer_decision"))


@query("discovery_visibility", f"""with {_DECIDED} select p_partkey, disc as discovery_reason, disc = 'SYNTHETIC_PUBLIC_APPROVAL' as published from dec""")
def discovery_visibility(spark, sf):
    return decided(spark, sf).select("p_partkey", "discovery_reason", F.col("projection").isNotNull().alias("published"))


@query("public_projection", f"""with {_DECIDED} select p_partkey, 'urn:example:discovery:parts:' || k as urn, p_name as title, st as offering_state,
  case when rt = 'dataset' and k % 6 <> 0 then case when k % 6 = 1 then 'index-only' else 'hosted' end when rt = 'dataset' then 'unknown' end as role from dec where disc = 'SYNTHETIC_PUBLIC_APPROVAL'""")
def public_projection(spark, sf):
    j = lambda p: F.get_json_object("projection", p)
    return decided(spark, sf).where(F.col("projection").isNotNull()).select(
        "p_partkey", j("$.id").alias("urn"), j("$.title").alias("title"), j("$.offeringState").alias("offering_state"), j("$.platformRecordRole").alias("role"))


@query("candidate_nodes", f"""with {_DECIDED}, a as (select *, 'urn:example:space:dataset:parts:' || k as ds from dec where st = 'APPROVED'),
  d as (select *, 'urn:example:space:distribution:parts:' || k || ':d' || unnest([1, 2]) as node from a)
  select ds as candidate_id, node, 'dcat:Distribution' as kind, unnest(['dct:format', 'dcat:mediaType', 'dcat:accessService']) as property,
    unnest(['CSV', 'https://www.iana.org/assignments/media-types/text/csv', 'urn:example:space:service:provider-1:connector-1']) as value from d
  union all select ds, 'urn:example:space:service:provider-1:connector-1', 'dcat:DataService', 'dcat:endpointURL', 'https://connector.invalid/dsp' from a""")
def candidate_nodes(spark, sf):
    return O.candidate_nodes(decided(spark, sf)).where(F.col("kind") != "dcat:Dataset")


@query("private_reference_leaks", f"""with {_DECIDED} select p_partkey, k % 4 = 2 as leaked from dec where st = 'APPROVED'""")
def private_reference_leaks(spark, sf):
    d = decided(spark, sf).where(F.col("candidate_id").isNotNull())
    salted = d.withColumn("candidate_nodes", F.when(F.col("p_partkey") % 4 == 2, F.transform("candidate_nodes", lambda n: n.withField(
        "properties", F.concat(n["properties"], F.array(F.struct(F.lit("x").alias("property"), F.concat(F.lit("see binding://store/"), F.col("record_id")).alias("value"))))))).otherwise(F.col("candidate_nodes")))
    return O.leak_check(salted).select("p_partkey", "leaked")


def _applied(spark, sf):
    """Line items of a part as applied events with decided states."""
    l = F.col
    gone = (l("l_returnflag") == "R") & (l("l_quantity") > 40)
    shown, offered = l("l_discount") < 0.05, l("l_tax") < 0.03
    return table(spark, sf, "lineitem").select(
        F.lit("parts").alias("source_system_id"), text("l_partkey").alias("record_id"), text("l_orderkey").alias("resource_version"), text("l_orderkey").alias("event_id"),
        ((F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("bigint") * 10**8 + l("l_orderkey")) * 10**5 + l("l_suppkey")).alias("_p"), l("l_linenumber"),
        F.when(gone, "withdrawn").otherwise("applied").alias("result"), F.when(offered, "APPROVED").otherwise("PENDING_EVIDENCE").alias("decision_state"),
        F.when(shown, "SYNTHETIC_PUBLIC_APPROVAL").otherwise("DISCOVERY_NOT_PUBLIC").alias("discovery_reason"), F.when(shown, F.lit("p")).alias("projection_digest"),
        F.when(offered, F.concat(F.lit("urn:example:space:dataset:parts:"), text("l_partkey"))).alias("candidate_id")).withColumn(
        "pos", l("_p") * 8 + l("l_linenumber")).drop("_p", "l_linenumber")


@query("emit_commands", """with e as (select l_partkey as k, l_orderkey, ((date_diff('day', date '1995-01-01', cast(l_shipdate as date)) * 100000000 + l_orderkey) * 100000 + l_suppkey) * 8 + l_linenumber as pos,
    l_returnflag = 'R' and l_quantity > 40 as gone, l_discount < 0.05 as sh, l_tax < 0.03 as offr from lineitem),
  w as (select *, sh and not gone as shown, offr and not gone as offered, coalesce(max(case when sh and not gone then 1 else 0 end) over win, 0) = 1 or k % 20 = 3 as shown_before,
    coalesce(max(case when offr and not gone then 1 else 0 end) over win, 0) = 1 as offered_before, k % 20 = 6 as moved from e window win as (partition by k order by pos rows between unbounded preceding and 1 preceding)),
  c as (select k, pos, unnest([case when shown then 'DISCOVERY_UPSERT' when shown_before then 'DISCOVERY_DELETE' end,
      case when offered and moved then 'CONNECTOR_REGISTRATION_REVIEW_REPLACE' when offered then 'CONNECTOR_REGISTRATION_REVIEW' when offered_before or moved then 'CONNECTOR_REGISTRATION_REVIEW_WITHDRAW' end]) as type,
    unnest([case when not shown then case when gone then 'SOURCE_DELETED' else case when sh then 'SYNTHETIC_PUBLIC_APPROVAL' else 'DISCOVERY_NOT_PUBLIC' end end end,
      case when offered and moved then 'PROJECTION_CONFIG_CHANGED' when not offered then case when gone then 'SOURCE_DELETED' else case when offr then 'APPROVED' else 'PENDING_EVIDENCE' end end end]) as reason from w)
  select cast(k as varchar) as record_id, pos, type, reason from c where type is not null""")
def emit_commands(spark, sf):
    k = F.col("p_partkey")
    state = table(spark, sf, "part").select(
        F.lit("parts").alias("source_system_id"), k.cast("string").alias("record_id"), (k % 20 == 3).alias("discovery_was_projected"),
        F.when(k % 20 == 6, F.array(F.lit("urn:example:old:dataset"))).alias("known_candidate_ids"))
    return S.emit_commands(_applied(spark, sf), state, CFG, 30 * 8 * 10**13).select("record_id", "pos", "type", "reason")


@query("state_summary", """select 'decision:' || case when o_orderstatus = 'F' then 'APPROVED' when o_orderstatus = 'O' then 'CATALOG_ONLY' else 'UNKNOWN' end as item, count(*) as rows from orders group by 1
  union all select o_orderpriority || ':' || case when o_totalprice > 200000 then 'pending' else 'superseded' end, count(*) from orders group by 1""")
def state_summary(spark, sf):
    o = table(spark, sf, "orders")
    st = o.select(F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "CATALOG_ONLY").alias("decision_state"))
    ob = o.select(F.col("o_orderpriority").alias("type"), F.when(F.col("o_totalprice") > 200000, "pending").otherwise("superseded").alias("status"))
    return S.state_summary(st, ob)


def stored_state(spark, sf):
    """Parts as stored a while ago: every approval held, under another namespace for some."""
    k = F.col("p_partkey")
    everyone = record_approvals(spark, sf).withColumn("offering_decision", F.lit("approved"))
    old = O.decide(records(spark, sf), everyone, CFG, NOW)
    return old.select("p_partkey", *S.KEY, "resource_version", "record", "record_digest", "projection_digest", "candidate_digest", "candidate_id", "decision_state",
                      F.col("approval_valid_until").alias("stored_valid_until"), F.col("next_evaluation_at").alias("stored_next_evaluation_at"),
                      F.when(F.col("candidate_id").isNotNull(), F.array("candidate_id")).alias("known_candidate_ids"),
                      F.col("projection_digest").isNotNull().alias("discovery_was_projected"))


@query("reconcile_state", f"""with {_DECIDED}, n as (select *, case when st = 'APPROVED' or (err is null and reasons = 'GOVERNANCE_OFFERING_NOT_APPROVED') then true else false end as was_offered from dec),
  c as (select k, unnest([case when disc = 'SYNTHETIC_PUBLIC_APPROVAL' then 'DISCOVERY_UPSERT' end, case when st = 'APPROVED' then 'CONNECTOR_REGISTRATION_REVIEW' when was_offered then 'CONNECTOR_REGISTRATION_REVIEW_WITHDRAW' end]) as type from n)
  select type, count(*) as commands from c where type is not null group by 1""")
def reconcile_state(spark, sf):
    out = S.reconcile(stored_state(spark, sf), record_approvals(spark, sf), CFG, NOW, approvals_changed=True, config_changed=False)
    return out.select(F.explode("commands").alias("c")).groupBy("c.type").agg(F.count(F.lit(1)).alias("commands"))


@query("review_queue", f"""with {_DECIDED}, n as (select *, st = 'APPROVED' or (err is null and reasons = 'GOVERNANCE_OFFERING_NOT_APPROVED') as was from dec)
  select p_partkey, case when k % 25 = 1 then 'OUTBOX_AGGREGATE_STALE' when not verified then 'APPROVAL_ENTRY_MISSING' when k % 25 = 2 then 'OUTBOX_APPROVAL_GATE_INVALID'
    when st <> 'APPROVED' or k % 25 = 3 then 'OUTBOX_PROJECTION_STALE' end as problem from n where was""")
def review_queue(spark, sf):
    st, k = stored_state(spark, sf), F.col("p_partkey")
    ob = st.where(F.col("candidate_digest").isNotNull()).select(
        "p_partkey", F.concat(F.lit("cmd-"), "record_id").alias("outbox_id"), *S.KEY, F.when(k % 25 == 1, "0").otherwise("1").alias("resource_version"),
        F.lit("CONNECTOR_REGISTRATION_REVIEW").alias("type"), F.when(k % 25 == 3, "edited").otherwise(F.col("candidate_digest")).alias("payload_digest"), F.col("known_candidate_ids").alias("candidate_ids"),
        F.struct(F.when(k % 25 == 2, "other").otherwise(F.col("record_digest")).alias("record_digest"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("evaluated_at")).alias("gate"))
    return S.review_queue(ob, st, record_approvals(spark, sf), CFG, NOW).select("p_partkey", "problem")


@query("projection_by_paths", """select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') as other from events""")
def projection_by_paths(spark, sf):
    return O.project_by_paths(table(spark, sf, "events"), "props", {"k": "$.k", "other": "$.missing"}).select("event_id", "k", "other")


@query("draft_gaps", """with o as (select o_custkey as g, o_orderkey as n, o_orderpriority as pr, o_totalprice as p, o_orderstatus as s from orders),
  f as (select g, count(*) filter (where pr = '1-URGENT') = 0 as no_ds, count(*) filter (where s = 'P' and p > 300000) = 0 as no_mark from o group by 1)
  select 'g' || g as graph, cast(null as varchar) as node, unnest(list_filter([case when no_ds then 'MISSING_NODE:dcat:Dataset' end, case when no_mark then 'MISSING_PROFILE_MARKER' end], lambda x: x is not null)) as code from f
  union all select 'g' || g, 'n' || n, 'UNTAGGED_LITERAL' from o where s = 'F' and n % 3 > 0
  union all select 'g' || g, 'n' || n, 'MISSING_AGENT' from o where s = 'O' and not exists (select 1 from o a where a.g = o.g and a.pr = '5-LOW' and a.n % 7 = o.n % 7)""")
def draft_gaps(spark, sf):
    o, s, n = table(spark, sf, "orders"), F.col("o_orderstatus"), F.col("o_orderkey")
    agent = F.col("o_orderpriority") == "5-LOW"
    nodes = o.select(
        F.concat(F.lit("g"), text("o_custkey")).alias("graph"), F.concat(F.lit("n"), text("o_orderkey")).alias("node"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "dcat:Dataset").alias("kind"),
        F.when(s == "F", "dct:title").when(s == "O", "dct:publisher").otherwise("dct:conformsTo").alias("property"),
        F.when(s == "O", F.concat(F.lit("a"), (n % 7).cast("string"))).when((s == "P") & (F.col("o_totalprice") > 300000), "profile").otherwise("x").alias("value"),
        F.when(s == "F", "literal").otherwise("iri").alias("value_kind"), F.when(n % 3 == 0, "en").alias("lang"))
    agents = o.where(agent).select(F.concat(F.lit("g"), text("o_custkey")).alias("graph"), F.concat(F.lit("a"), (n % 7).cast("string")).alias("node"), F.lit("foaf:Agent").alias("kind"),
                                   *[F.lit(None).cast("string").alias(c) for c in ("property", "value", "value_kind", "lang")])
    return O.assess_gaps(nodes.unionByName(agents), ["dcat:Dataset"], "profile", ["dct:title"])


@query("candidate_history", """select o_orderkey, list_sort(list_distinct([o_orderstatus, o_orderpriority, 'id-' || (o_custkey % 5)]))[1] as first_id, len(list_distinct([o_orderstatus, o_orderpriority, 'id-' || (o_custkey % 5)])) as ids from orders""")
def candidate_history(spark, sf):
    known = F.array("o_orderstatus", "o_orderpriority")
    ids = S.candidate_history(known, F.concat(F.lit("id-"), (F.col("o_custkey") % 5).cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", ids.alias("h")).select("o_orderkey", F.col("h")[0].alias("first_id"), F.size("h").alias("ids"))
