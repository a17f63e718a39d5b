"""Service levels over ``events``: four services, errors by event type, latency from the value."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.operators import slo as S
from dataward.plans.registry import query
from dataward.sources.tables import table


def requests(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"), "ts",
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
        F.when(F.col("event_type") != "signup", F.col("value") * 10).alias("duration_ms"))


_REQ = """req as (select 'svc-' || (user_id % 4) as service, ts, event_type = 'error' as err,
  case when event_type <> 'signup' then value * 10 end as ms from events)"""
_AGG = """count(*) as request_count, count(*) filter (where err) as server_error_count, count(ms) as latency_eligible_count,
  count(*) filter (where ms <= 500) as latency_good_count"""
_MINUTES = f"""{_REQ}, seen as (select service, cast(floor(epoch(ts) / 60) as bigint) as minute, {_AGG} from req group by 1, 2),
  spine as (select service, unnest(range(min(minute), max(minute) + 1)) as minute from seen group by 1),
  mins as (select service, minute, coalesce(request_count, 0) as n, coalesce(server_error_count, 0) as bad, coalesce(latency_eligible_count, 0) as el,
    coalesce(latency_good_count, 0) as good from spine left join seen using (service, minute))"""
_W = lambda c, n: f"cast(sum({c}) over (partition by service order by minute range between {n - 1} preceding and current row) as double)"
_SERIES = f"""{_MINUTES}, series as (select service, minute, n, """ + ", ".join(
    f"1 - {_W('bad', n)} / greatest({_W('n', n)}, {1.0 if k == '30d' else 1e-12}) as availability_{k}, "
    f"{_W('good', n)} / greatest({_W('el', n)}, {1.0 if k == '30d' else 1e-12}) as latency_{k}"
    for k, n in S.WINDOWS_MINUTES.items()) + " from mins)"


@query("sli_counts", f"""with {_REQ} select service, {_AGG} from req where ts > timestamp '2024-01-02' and ts <= timestamp '2024-01-25' group by 1""")
def sli_counts(spark, sf):
    return S.sli_counts(requests(spark, sf), "2024-01-02 00:00:00", "2024-01-25 00:00:00")


@query("slo_snapshot", f"""with {_REQ}, c as (select service, {_AGG} from req group by 1),
  r as (select *, (request_count - server_error_count) / cast(request_count as double) as a, latency_good_count / cast(latency_eligible_count as double) as l from c)
  select service, request_count, round(a, 9) as availability_sli, round(l, 9) as latency_sli, round((1 - a) / (1 - 0.75), 9) as availability_budget_consumed,
    round(greatest(0.0, 1 - (1 - a) / (1 - 0.75)), 9) as availability_budget_remaining, round((1 - l) / (1 - 0.4), 9) as latency_budget_consumed,
    case when a >= 0.75 and l >= 0.4 then 'MET' else 'BREACHED' end as status from r""")
def slo_snapshot(spark, sf):
    counts = S.sli_counts(requests(spark, sf), "2023-12-31 00:00:00", "2024-02-01 00:00:00")
    out = S.slo_snapshot(counts, 0.75, 0.4)
    return out.select("service", "request_count", *[F.round(c, 9).alias(c) for c in (
        "availability_sli", "latency_sli", "availability_budget_consumed", "availability_budget_remaining", "latency_budget_consumed")], "status")


_KEYS = [f"{o}_{k}" for k in S.WINDOWS_MINUTES for o in ("availability", "latency")]


@query("burn_series", f"""with {_SERIES} select service, cast(floor(minute / 1440) as bigint) as day, count(*) as minutes, {', '.join(
    f'round(min({c}), 9) as min_{c}, round(max({c}), 9) as max_{c}' for c in _KEYS)},
  round(min(greatest(1 - (1 - availability_30d) / (1 - 0.75), 0.0)), 9) as min_budget from series group by 1, 2""")
def burn_series(spark, sf):
    series = S.burn_series(S.minute_counts(requests(spark, sf)), 0.75, 0.4)
    return series.groupBy("service", F.floor(F.col("minute") / 1440).alias("day")).agg(
        F.count(F.lit(1)).alias("minutes"),
        *[F.round(F.min(c), 9).alias(f"min_{c}") for c in _KEYS], *[F.round(F.max(c), 9).alias(f"max_{c}") for c in _KEYS],
        F.round(F.min("availability_budget_remaining"), 9).alias("min_budget"))


_RULE = lambda n, o, t, lo, sh, f, hold: (
    f"select service, minute, '{n}' as alert, sum(case when (1 - {o}_{lo}) / (1 - {t}::double) > {f}::double and (1 - {o}_{sh}) / (1 - {t}::double) > {f}::double then 1 else 0 end) "
    f"over (partition by service order by minute range between {hold} preceding and current row) = {hold + 1} as firing from series")
_ALERTS = " union all ".join(_RULE(n, o, {"availability": 0.98, "latency": 0.95}[o], lo, sh, f, h) for n, o, lo, sh, f, h in S.BURN_ALERTS)


@query("burn_alerts", f"""with {_SERIES}, flags as ({_ALERTS}),
  isl as (select *, minute - row_number() over (partition by service, alert order by minute) as g from flags where firing)
  select service, alert, min(minute) as from_minute, max(minute) as to_minute from isl group by service, alert, g""")
def burn_alerts(spark, sf):
    return S.alerts(S.burn_series(S.minute_counts(requests(spark, sf)), 0.98, 0.95), 0.98, 0.95)


@query("gauge_alerts", f"""with {_MINUTES}, flags as (select service, minute, sum(case when n = 0 then 1 else 0 end)
    over (partition by service order by minute range between 5 preceding and current row) = 6 as firing from mins),
  isl as (select *, minute - row_number() over (partition by service order by minute) as g from flags where firing)
  select service, min(minute) as from_minute, max(minute) as to_minute from isl group by service, g""")
def gauge_alerts(spark, sf):
    return S.hold_alerts(S.minute_counts(requests(spark, sf)).select("service", "minute", "request_count"),
                         ["service"], F.col("request_count") == 0, 5)
