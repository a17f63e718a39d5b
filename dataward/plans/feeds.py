"""Readers, writers and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.functions.shared_files import fresh_folder
from dataward.functions.lexical import identity_valid, rfc3339_valid, xsd_valid
from dataward.operators import graph as G
from dataward.plans.graph import XSD, quads
from dataward.plans.registry import query
from dataward.sources.feeds import file_digests, parse_nquads
from dataward.sources.sinks import ntriples
from dataward.sources.tables import table


@query("statement_lines", f"""select p, o_kind, count(*) as quads from (select '{G.RDF_TYPE}' as p, 'iri' as o_kind from customer union all select 'urn:x:name', 'literal' from customer union all select 'urn:x:nation', 'iri' from customer union all select 'urn:x:segment', 'literal' from customer
  union all select 'urn:x:balance', 'literal' from customer) group by 1, 2""")
def statement_lines(spark, sf):
    q = quads(spark, sf).where(F.col("s").startswith("urn:x:c"))
    back, _ = parse_nquads(ntriples(q, "main"), "value", "main")
    return back.join(q, ["graph", "s", "p", "o", "o_kind"], "left_semi").groupBy("p", "o_kind").agg(F.count(F.lit(1)).alias("quads"))


@query("file_digests")
def table_file_digests(spark, sf):
    return file_digests(spark, sf, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query("instant_texts", """select o_orderkey, case o_custkey % 6 when 1 then false when 2 then false when 3 then true when 4 then false when 5 then true else true end as valid from orders""")
def instant_texts(spark, sf):
    n, day = F.col("o_custkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = (F.when(n == 1, F.concat(day, F.lit(" 00:00:00Z"))).when(n == 2, F.concat(day, F.lit("T00:00:00-00:00"))).when(n == 3, F.concat(day, F.lit("T23:59:59.123+09:00")))
             .when(n == 4, F.concat(day, F.lit("T24:00:00Z"))).otherwise(F.concat(day, F.lit("T01:02:03Z"))))
    return table(spark, sf, "orders").select("o_orderkey", rfc3339_valid(stamp).alias("valid"))


@query("leap_days", """select o_orderkey, (y % 4 = 0 and (y % 100 <> 0 or y % 400 = 0)) as valid from (select o_orderkey, 1000 + o_custkey % 1500 as y from orders)""")
def leap_days(spark, sf):
    day = F.concat((1000 + F.col("o_custkey") % 1500).cast("string"), F.lit("-02-29"))
    return table(spark, sf, "orders").select("o_orderkey", xsd_valid(day, F.lit(XSD + "date")).alias("valid"))


@query("identity_texts", """select page_id, case page_id % 4 when 1 then false when 2 then true when 3 then false else starts_with(url, 'https://') and regexp_matches(url, '^[!-~]+$') end as valid from pages""")
def identity_texts(spark, sf):
    n = F.col("page_id") % 4
    who = F.when(n == 1, "https://me@data.example.org/").when(n == 2, F.concat(F.lit("did:web:host:"), F.col("page_id").cast("string"))).when(n == 3, "did:web:").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", identity_valid(who).alias("valid"))


@query("stream_hourly_totals", """select cast(count(*) as bigint) as hours, cast(sum(n) as bigint) as events from (select event_type, date_trunc('hour', ts) as h, count(*) as n from events group by 1, 2)
  where h + interval 1 hour <= (select max(ts) from events)""")
def stream_hourly_totals(spark, sf):
    """The event table read as a stream and added up by hour, through a checkpointed file sink."""
    from dataward.streaming.usage import stream_rollup
    schema = table(spark, sf, "events").schema
    folder = fresh_folder(spark, "stream")
    ev = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select(
        F.col("ts").cast("timestamp").alias("occurred_at"), F.lit("web").alias("component"), F.lit("all").alias("tenant_id"), F.col("event_type").alias("meter_name"),
        F.lit("operational").alias("purpose"), F.lit("{event}").alias("unit"), F.lit("none").alias("dimensions_sha256"), F.col("value").cast("decimal(30,9)").alias("quantity"))
    run = (stream_rollup(ev, "0 seconds").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.agg(F.count(F.lit(1)).alias("hours"), F.sum("event_count").alias("events"))
