"""Snapshot diffs and merges: two deterministic editions of parts, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.functions.canonical import row_digest
from dataward.operators import diff as D
from dataward.plans.registry import query
from dataward.sources.tables import table


def text(c):
    return F.col(c).cast("string")


def editions(spark, sf):
    """Parts before and after: some leave, some arrive, some change their size or are deprecated."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    cols = [k.alias("term_id"), F.col("p_name").alias("label"), F.col("p_brand").alias("owner")]
    before = p.where(k % 10 != 3).select(*cols, text("p_size").alias("value"), F.when(k % 13 == 0, "deprecated").otherwise("stable").alias("status"))
    after = p.where(k % 10 != 4).select(*cols, F.when(k % 7 == 0, F.concat(text("p_size"), F.lit("+"))).otherwise(text("p_size")).alias("value"),
                                        F.when((k % 13 == 0) | (k % 17 == 0), "deprecated").otherwise("stable").alias("status"))
    return before, after


@query("semantic_diff", """select p_partkey as term_id, case when p_partkey % 10 = 3 then 'added' when p_partkey % 10 = 4 then 'removed' else 'changed' end as change from part
  where p_partkey % 10 in (3, 4) or p_partkey % 7 = 0 or (p_partkey % 17 = 0 and p_partkey % 13 <> 0)
  union all select p_partkey, 'deprecated' from part where p_partkey % 10 <> 4 and (p_partkey % 13 = 0 or p_partkey % 17 = 0) and not (p_partkey % 10 <> 3 and p_partkey % 13 = 0)""")
def semantic_diff(spark, sf):
    before, after = editions(spark, sf)
    return D.semantic_diff(before, after, ["term_id"], ["label", "owner", "value", "status"], "status")


@query("compare_inventory", """with a as (select case when l_quantity > 45 then '' else 'old-' end || l_partkey as k, count(*) as n from lineitem group by 1),
  b as (select case when p_size > 5 then '' else 'new-' end || p_partkey as k, count(*) as n from part join range(2) r(i) on i = 0 or p_partkey % 31 = 0 group by 1),
  j as (select coalesce(a.k, b.k) as k, a.n as an, b.n as bn from a full join b using (k)),
  f as (select k, unnest([case when bn is null then 'missing' end, case when an is null then 'extra' end, case when an > 1 then 'duplicate-found' end, case when bn > 1 then 'duplicate-mapped' end]) as issue from j)
  select k as part_key, issue from f where issue is not null""")
def compare_inventory(spark, sf):
    filed = lambda usual, other, c: F.concat(F.when(usual, "").otherwise(other), text(c))
    found = table(spark, sf, "lineitem").select(filed(F.col("l_quantity") > 45, "old-", "l_partkey").alias("part_key"))
    copies = F.when(F.col("p_partkey") % 31 == 0, 2).otherwise(1)
    mapped = table(spark, sf, "part").select(F.explode(F.array_repeat(filed(F.col("p_size") > 5, "new-", "p_partkey"), copies)).alias("part_key"))
    return D.compare_inventory(found, mapped, ["part_key"])


@query("verify_manifest", """with f as (select 'part/' || p_partkey as path, sha256(p_name) as s from part where p_partkey % 19 <> 2),
  l as (select 'part/' || p_partkey as path, case when p_partkey % 23 = 5 then sha256('old') else sha256(p_name) end as s from part join range(2) r(i) on i = 0 or p_partkey % 37 = 0 where p_partkey % 29 <> 1),
  a as (select path, count(*) as n, min(s) as s from f group by 1), b as (select path, count(*) as n, min(s) as s from l group by 1),
  j as (select coalesce(a.path, b.path) as path, a.n as an, b.n as bn, a.s as sa, b.s as sb from a full join b using (path)),
  x as (select path, unnest([case when bn > 1 then 'duplicate' end, case when an is null then 'missing' end, case when bn is null then 'extra' end, case when sa <> sb then 'digest-mismatch' end]) as issue from j)
  select path, issue from x where issue is not null""")
def verify_manifest(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    path = F.concat(F.lit("part/"), text("p_partkey")).alias("path")
    files = p.where(k % 19 != 2).select(path, F.sha2("p_name", 256).alias("sha256"))
    lock = p.where(k % 29 != 1).select(path, F.when(k % 23 == 5, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("p_name", 256)).alias("sha256"),
                                       F.explode(F.array_repeat(F.lit(1), F.when(k % 37 == 0, 2).otherwise(1))).alias("i"))
    return D.verify_manifest(files, lock)


@query("verify_installed", """with x as (select p_partkey as k, unnest([case when p_partkey % 19 = 2 and p_partkey % 29 <> 1 then 'missing' end, case when p_partkey % 29 = 1 and p_partkey % 19 <> 2 then 'unexpected' end,
    case when p_partkey % 19 <> 2 and p_partkey % 29 <> 1 and p_partkey % 5 = 1 then 'name-mismatch' end, case when p_partkey % 19 <> 2 and p_partkey % 29 <> 1 and p_partkey % 8 = 2 then 'version-mismatch' end,
    case when p_partkey % 29 <> 1 and p_size = 7 then 'no-integrity' end]) as issue from part) select 'mod/' || k as path, issue from x where issue is not null""")
def verify_installed(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    path = F.concat(F.lit("mod/"), text("p_partkey")).alias("path")
    actual = p.where(k % 19 != 2).select(path, F.col("p_name").alias("name"), text("p_size").alias("version"))
    lock = p.where(k % 29 != 1).select(path, F.when(k % 5 == 1, "other").otherwise(F.col("p_name")).alias("name"),
                                       F.when(k % 8 == 2, "0").otherwise(text("p_size")).alias("version"), F.when(F.col("p_size") != 7, F.lit("sha")).alias("integrity"))
    return D.verify_inventory(actual, lock)


@query("verify_steps", """select 'step-' || p_partkey as step_id, 'missing' as issue from part where p_partkey % 3 > 0 and p_partkey not in (10, 20)
    and not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A')
  union all select distinct 'step-' || l_partkey, 'unexpected' from lineitem where l_partkey % 3 = 0""")
def verify_steps(spark, sf):
    run = table(spark, sf, "lineitem").select(F.concat(F.lit("step-"), text("l_partkey")).alias("step_id"),
                                              F.when(F.col("l_returnflag") == "A", "passed").otherwise("failed").alias("status"))
    required = table(spark, sf, "part").where(F.col("p_partkey") % 3 > 0).select(F.concat(F.lit("step-"), text("p_partkey")).alias("step_id"))
    return D.verify_steps(run, required, ["step-10", "step-20"])


@query("merge_snapshot", """select o_orderkey, case when o_custkey % 7 = 2 then 'insert' when o_custkey % 7 = 3 then 'delete' when o_totalprice > 300000 then 'update' else 'keep' end as op,
    case when o_custkey % 7 <> 2 and o_custkey % 7 <> 3 and not o_totalprice > 300000 then 4 else 5 end as revision,
    case when o_custkey % 7 = 3 or not o_totalprice > 300000 then o_orderstatus else 'X' end as state from orders""")
def merge_snapshot(spark, sf):
    o, c = table(spark, sf, "orders"), F.col("o_custkey") % 7
    current = o.where(c != 2).select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("label"), F.lit(4).alias("revision"))
    nxt = o.where(c != 3).select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")).alias("state"), F.col("o_orderpriority").alias("label"))
    return D.merge_snapshot(current, nxt, ["o_orderkey"], ["state", "label"], 5).select("o_orderkey", "op", "revision", "state")


@query("append_checked", """select case when o_custkey % 4 = 1 then 'append' when o_orderpriority = '2-HIGH' then 'conflict' else 'replay' end as outcome, o_orderstatus, count(*) as events from orders group by 1, 2""")
def append_checked(spark, sf):
    o = table(spark, sf, "orders")
    current = o.where(F.col("o_custkey") % 4 != 1).select("o_orderkey", F.sha2("o_orderstatus", 256).alias("event_digest"))
    new = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "2-HIGH", "x").otherwise(F.sha2("o_orderstatus", 256)).alias("event_digest"))
    out = D.append_checked(current, new, ["o_orderkey"], "event_digest")
    return out.groupBy("outcome", "o_orderstatus").agg(F.count(F.lit(1)).alias("events"))


@query("same_multiset", """with a as (select user_id % 7 as g, event_type as t, count(*) as n from events group by 1, 2),
  b as (select case when event_id % 101 = 0 then 0 else user_id % 7 end as g, event_type as t, count(*) as n from events group by 1, 2),
  j as (select coalesce(a.n, 0) - coalesce(b.n, 0) as d from a full join b using (g, t))
  select cast(sum(greatest(d, 0)) as bigint) as only_first, cast(sum(greatest(-d, 0)) as bigint) as only_second, sum(abs(d)) = 0 as equal from j""")
def same_multiset(spark, sf):
    e, g = table(spark, sf, "events"), F.col("user_id") % 7
    return D.same_multiset(e.select(g.alias("g"), "event_type"),
                           e.select(F.when(F.col("event_id") % 101 == 0, 0).otherwise(g).alias("g"), "event_type"))


@query("verify_migration", """select case when o_custkey % 7 = 2 then 'unexpected' when o_custkey % 7 = 3 then 'missing' when o_totalprice > 400000 then 'different' else 'equal' end as state, count(*) as rows from orders group by 1""")
def verify_migration(spark, sf):
    o, c = table(spark, sf, "orders"), F.col("o_custkey") % 7
    expected = o.where(c != 2).select("o_orderkey", "o_orderstatus")
    actual = o.where(c != 3).select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return D.verify_migration(expected, actual, ["o_orderkey"], ["o_orderstatus"])


@query("flatten_state", """with c as (select *, c_mktsegment || '-' || (c_custkey // 100) as space_id from customer) select 'tenant-' || c_nationkey as tenant_id, kind, space_id, member_id, sha256 from (
  select distinct c_nationkey, 'space' as kind, space_id, cast(null as varchar) as member_id, sha256('{"spaceId":"' || space_id || '","state":"ACTIVE"}') as sha256 from c
  union all select c_nationkey, 'participant', space_id, c_name, sha256('{"participantId":"' || c_name || '","state":"' || case when c_acctbal < 0 then 'SUSPENDED' else 'APPROVED' end || '"}') from c)""")
def flatten_state(spark, sf):
    member = F.struct(F.col("c_name").alias("participant_id"), F.when(F.col("c_acctbal") < 0, "SUSPENDED").otherwise("APPROVED").alias("state"))
    # A space has at most a hundred members, whatever the number of customers.
    space = F.concat_ws("-", "c_mktsegment", F.floor(F.col("c_custkey") / 100).cast("string")).alias("space")
    spaces = table(spark, sf, "customer").groupBy("c_nationkey", space).agg(F.collect_list(member).alias("p"))
    entry = F.struct(F.col("space").alias("key"), F.struct(F.lit("ACTIVE").alias("state"), F.col("p").alias("participants")).alias("value"))
    state = spaces.select(F.lit("hub").alias("component"), F.concat(F.lit("tenant-"), text("c_nationkey")).alias("tenant_id"),
                          F.map_from_entries(F.array(entry)).alias("spaces"))
    return D.flatten_state(state).drop("component")


@query("decision_matrix", """with r as (select l_orderkey, count(distinct l_linenumber % 3) as answered, count(distinct case when l_tax > 0.07 then 'reject' else 'accept' end) as decisions,
    min(case when l_tax > 0.07 then 'reject' else 'accept' end) as d from lineitem group by 1)
  select o_orderkey as case_id, case when coalesce(answered, 0) < 2 then 'incomplete' when decisions > 1 then 'disagree' when d <> case when o_totalprice > 400000 then 'reject' else 'accept' end then 'unexpected' else 'agreed' end as verdict
  from orders left join r on l_orderkey = o_orderkey""")
def decision_matrix(spark, sf):
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_totalprice") > 400000, "reject").otherwise("accept").alias("expected"))
    results = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 3).alias("engine"), F.when(F.col("l_tax") > 0.07, "reject").otherwise("accept").alias("decision"))
    return D.decision_matrix(cases, results, 2).select("case_id", "verdict")


@query("cutover_receipt", """with m as (select s_suppkey as c, sha256(cast(s_suppkey as varchar)) as r, s_acctbal > 200 as auth from supplier),
  h as (select s_suppkey as c, case when s_suppkey % 17 = 4 then 'x' else sha256(cast(s_suppkey as varchar)) end as r from supplier),
  g as (select l_suppkey as c from lineitem group by 1 having max(l_shipdate) >= timestamp '1996-01-01'),
  j as (select m.auth and h.r = m.r and g.c is not null as ok from m left join h using (c) left join g using (c))
  select count(*) as components, count(*) filter (where ok) as consistent, bool_and(ok) as cutover_valid from j""")
def cutover_receipt(spark, sf):
    s = table(spark, sf, "supplier")
    root = F.sha2(text("s_suppkey"), 256)
    modes = s.select(F.col("s_suppkey").alias("component"), F.when(F.col("s_acctbal") > 200, "scoped-authoritative").otherwise("legacy").alias("mode"), root.alias("state_root"))
    heads = s.select(F.col("s_suppkey").alias("component"), F.when(F.col("s_suppkey") % 17 == 4, "x").otherwise(root).alias("state_root"))
    done = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("component")).agg(F.max("l_shipdate").alias("last")).where(
        F.col("last") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("component", F.lit(4).alias("version"))
    return D.cutover_receipt(modes, heads, done)


@query("capacity_totals", """select o_orderstatus as component, count(*) as scopes, cast(sum(o_orderkey) as bigint) as state_bytes, cast(sum(o_custkey) as bigint) as row_count from orders group by 1""")
def capacity_totals(spark, sf):
    reg = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("component"), F.col("o_orderkey").alias("state_bytes"), F.col("o_custkey").alias("row_count"))
    return D.capacity_totals(reg)


def _checks():
    return {
        "digest_form": F.col("digest").rlike("^[a-f0-9]{64}$"), "quantity_positive": F.col("quantity") > 0,
        "exclusive_end_state": ~(F.col("published_at").isNotNull() & F.col("dead_lettered_at").isNotNull()),
        "receipt_pair": F.col("published_at").isNull() == F.col("receipt").isNull(),
        "path_in_tenant": F.col("object_key").startswith(F.concat(F.lit("tenants/"), F.col("tenant_id"), F.lit("/"))) & ~F.col("object_key").rlike(r"(^|/)\.\.(/|$)|//")}


def checked_rows(spark, sf):
    e = F.col
    return table(spark, sf, "lineitem").select(
        e("l_suppkey").cast("string").alias("tenant_id"), (e("l_quantity") - 2).alias("quantity"),
        F.when(e("l_tax") > 0.07, "bad").otherwise(F.sha2(e("l_orderkey").cast("string"), 256)).alias("digest"),
        F.when(e("l_returnflag") == "A", e("l_shipdate")).alias("published_at"), F.when(e("l_linestatus") == "O", e("l_shipdate")).alias("dead_lettered_at"),
        F.when((e("l_returnflag") == "A") & (e("l_discount") < 0.1), "r").alias("receipt"),
        F.concat(F.lit("tenants/"), F.when(e("l_partkey") % 100 == 0, F.lit("..")).otherwise(e("l_suppkey").cast("string")), F.lit("/obj")).alias("object_key"))


@query("table_invariants", """select rule, cast(violations as bigint) as violations, row_count from (select count(*) filter (where l_tax > 0.07) as a, count(*) filter (where l_quantity <= 2) as b,
    count(*) filter (where l_returnflag = 'A' and l_linestatus = 'O') as c, count(*) filter (where l_returnflag = 'A' and not l_discount < 0.1) as d,
    count(*) filter (where l_partkey % 100 = 0) as e, count(*) as row_count from lineitem),
  lateral (values ('digest_form', a), ('quantity_positive', b), ('exclusive_end_state', c), ('receipt_pair', d), ('path_in_tenant', e)) t(rule, violations)""")
def table_invariants(spark, sf):
    return D.table_invariants(checked_rows(spark, sf), _checks())


@query("recovery_checks", """select 'outbox_states' as check_name, count(*) filter (where l_returnflag = 'A' and not l_discount < 0.1) + count(*) filter (where l_returnflag = 'A' and l_linestatus = 'O' and l_discount < 0.1) as violations from lineitem
  union all select 'usage_events', count(*) filter (where value <= 0.05) from events
  union all select 'migrations', count(*) filter (where s_suppkey % 17 = 4) from supplier
  union all select 'roots', count(*) filter (where s_acctbal < 0) from supplier""")
def recovery_checks(spark, sf):
    from dataward.operators.recovery import recovery_checks as checks
    rows = checked_rows(spark, sf).withColumns({"publish_receipt": F.col("receipt"), "publish_receipt_sha256": F.col("receipt"),
                                                "claimed_by": F.lit(None).cast("string"), "claimed_until": F.lit(None).cast("timestamp_ntz")})
    usage = table(spark, sf, "events").select(F.lit("billing-candidate").alias("purpose"), (F.col("value") - 0.05).alias("quantity"),
                                              F.sha2(text("event_id"), 256).alias("source_event_digest"), F.sha2(text("event_id"), 256).alias("event_sha256"),
                                              F.md5(text("event_id")).alias("trace_id"))
    s = table(spark, sf, "supplier")
    required = s.select(F.col("s_suppkey").alias("component"), F.lit(3).alias("version"))
    applied = s.where(F.col("s_suppkey") % 17 != 4).select(F.col("s_suppkey").alias("component"), F.lit(3).alias("version"))
    modes = s.select(F.col("s_suppkey").alias("component"), F.lit("scoped-authoritative").alias("mode"), F.sha2(text("s_suppkey"), 256).alias("state_root"))
    heads = s.select(F.col("s_suppkey").alias("component"), F.when(F.col("s_acctbal") < 0, "x").otherwise(F.sha2(text("s_suppkey"), 256)).alias("state_root"))
    return checks(outbox=rows, usage=usage, migrations=applied, required_migrations=required, modes=modes, heads=heads).select("check_name", "violations")
