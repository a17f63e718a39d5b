"""Readers and writers, metering streams, service levels, chains, text."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from dataward.operators import graph as G
from dataward.operators import slo, text, usage
from dataward.sources import feeds, sinks
from dataward.streaming.usage import start_recording, stream_dedupe, stream_sli


def test_statement_files_round_trip(spark, folder):
    lines = ['<urn:a> <urn:p> "x \\"y\\"\\n\\u00e9"@EN .', '_:b1 <urn:p> <urn:c> <urn:g> .', '<urn:a> <urn:q> "1"^^<urn:int> . # note', "# only a note", ""]
    os.makedirs(folder + "/in")
    with open(folder + "/in/a.nq", "w") as f:
        f.write("\n".join(lines))
    rows = feeds.read_nquads(spark, folder + "/in").collect()
    assert {(r["graph"], r["s"], r["p"], r["o"], r["o_kind"], r["lang"], r["datatype"]) for r in rows} == {
        ("default", "urn:a", "urn:p", 'x "y"\né', "literal", "en", None), ("urn:g", "b1", "urn:p", "urn:c", "iri", None, None), ("default", "urn:a", "urn:q", "1", "literal", None, "urn:int")}
    with open(folder + "/in/b.nq", "w") as f:
        f.write("<urn:a> <urn:p> broken .")
    with pytest.raises(Exception, match="malformed"):
        feeds.read_nquads(spark, folder + "/in").collect()
    q = spark.createDataFrame([("default", "urn:a", "iri", "urn:p", 'a"b\\c\n', "literal", None, "en")], "graph string, s string, s_kind string, p string, o string, o_kind string, datatype string, lang string")
    sinks.write_ntriples(q, folder + "/nt")
    assert feeds.read_nquads(spark, folder + "/nt").first()["o"] == 'a"b\\c\n'
    with pytest.raises(Exception, match="default graph"):
        sinks.write_ntriples(q.withColumn("graph", F.lit("other")), folder + "/nt2")


def test_register_csv(spark, folder):
    os.makedirs(folder + "/csv")
    with open(folder + "/csv/r.csv", "w") as f:
        f.write('id,note\n1,"a ""b"", c"\n2,x,extra\n3,"two\nlines"\n')
    good, bad = feeds.read_register_csv(spark, folder + "/csv", ["id", "note"])
    assert sorted(map(tuple, good.collect())) == [("1", 'a "b", c'), ("3", "two\nlines")] and bad.count() == 1
    with pytest.raises(ValueError):
        feeds.read_register_csv(spark, folder + "/csv", ["id", "other"])
    sinks.to_register_csv(spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>"), folder + "/out")
    assert spark.read.option("header", True).option("escape", '"').csv(folder + "/out").first()["tags"] == '["a","b"]'


def test_file_digests_read_long_files_in_ranges(spark, folder, monkeypatch):
    os.makedirs(folder + "/in/a b%20#é")
    sizes = {"one": 1, "block": 64, "span": 1000, "over": 1001, "twice": 2000, "a b%20#é/long": 3003, "x.gz": 3000}
    want = set()
    for name, n in sizes.items():
        data = bytes(i * i % 251 for i in range(n))
        with open(f"{folder}/in/{name}", "wb") as f:
            f.write(data)
        want.add((f"file:{folder}/in/{name}", n, hashlib.sha256(data).hexdigest()))
    kept = []
    monkeypatch.setattr(feeds, "fresh_folder", lambda s, kind: kept.append(f"{folder}/{kind}") or kept[-1])
    found = feeds.file_digests(spark, folder + "/in", span=1000)
    rows = list(map(tuple, found.collect()))
    assert set(rows) == want and len(rows) == len(want) and found.schema.simpleString() == "struct<path:string,bytes:bigint,sha256:string>"
    # A task took one range of one file: each round stores as many files as there are rows, and goes 1,000 bytes further.
    long = sorted(n for n in sizes.values() if n > 1000)
    for k in range(1, 5):
        states = spark.read.parquet(f"{kept[0]}/{k}").select("bytes", "at", F.input_file_name()).collect()
        assert sorted((r["bytes"], r["at"]) for r in states) == [(n, min(n, 1000 * k)) for n in long if n > 1000 * (k - 1)] and len({r[2] for r in states}) == len(states)
    assert len(os.listdir(kept[0])) == 5
    assert set(map(tuple, feeds.file_digests(spark, folder + "/in", "o*").collect())) == {r for r in want if r[0].rsplit("/", 1)[1][0] == "o"}


def test_file_digests_above_one_binary_value(spark, folder):
    n = 2**31 + 5
    os.makedirs(folder + "/in")
    with open(folder + "/in/sparse", "wb") as f:
        f.truncate(n)
    with open(folder + "/in/sparse", "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert list(map(tuple, feeds.file_digests(spark, folder + "/in").select("bytes", "sha256").collect())) == [(n, want)]


def test_file_digests_in_a_store_that_only_spark_reads(spark, folder):
    with open(folder + "/a", "wb") as f:
        f.write(b"x" * 3000)
    spark.conf.set("fs.viewfs.mounttable.digests.link./in", f"file://{folder}")
    row = feeds.file_digests(spark, "viewfs://digests/in", span=1000).first()
    assert (row["bytes"], row["sha256"]) == (3000, hashlib.sha256(b"x" * 3000).hexdigest())


def test_snapshots_and_ranges(spark, folder):
    sinks.write_snapshot(spark.range(3), folder + "/s", 1)
    with pytest.raises(Exception):
        sinks.write_snapshot(spark.range(3), folder + "/s", 1)
    rows = lambda day, q: spark.createDataFrame([(f"2024-01-0{day} 01:00:00", q)], "t string, quantity int").select(F.col("t").cast("timestamp_ntz").alias("period_start"), "quantity")
    sinks.overwrite_range(rows(1, 1).unionByName(rows(2, 2)), folder + "/r")
    sinks.overwrite_range(rows(2, 9), folder + "/r")
    assert sorted(r["quantity"] for r in spark.read.parquet(folder + "/r").collect()) == [1, 9]


def test_replace_range_leaves_all_else(spark, folder):
    def rows(*cells):
        return spark.createDataFrame([("web", "t", m, f"2024-01-0{d} 0{h}:00:00", q) for m, d, h, q in cells], "component string, tenant_id string, meter_name string, t string, quantity int").select(
            "component", "tenant_id", "meter_name", F.col("t").cast("timestamp_ntz").alias("period_start"), "quantity")

    def stored():
        return sorted((r["meter_name"], r["period_start"].day, r["period_start"].hour, r["quantity"]) for r in sinks.read_rollup(spark, folder + "/x").collect())

    sinks.overwrite_range(rows(("m1", 1, 1, 1), ("m1", 1, 2, 2), ("m1", 1, 9, 3), ("m2", 1, 1, 4), ("m1", 2, 1, 5), ("m1", 3, 1, 6)), folder + "/x")
    sinks.replace_range(rows(("m1", 1, 1, 10)), folder + "/x", "web", "t", "m1", "2024-01-01 01:00:00", "2024-01-01 03:00:00")
    assert stored() == [("m1", 1, 1, 10), ("m1", 1, 9, 3), ("m1", 2, 1, 5), ("m1", 3, 1, 6), ("m2", 1, 1, 4)]
    sinks.replace_range(rows(), folder + "/x", "web", "t", "m1", "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    assert stored() == [("m1", 1, 1, 10), ("m1", 1, 9, 3), ("m1", 3, 1, 6), ("m2", 1, 1, 4)]


def test_candidate_history_keeps_all(spark):
    from dataward.operators.sync import candidate_history
    df = spark.range(1).select(candidate_history(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string")), F.lit("new")).alias("ids"))
    assert len(df.first()["ids"]) == 61


def test_quantities(spark):
    cases = [("1.500", "1.5"), ("0.000", None), ("0", None), ("01", None), ("10", "10"), ("1.0000000001", None), ("0.000000001", "0.000000001"), ("1e3", None)]
    df = spark.createDataFrame(cases, "q string, want string")
    assert df.where(~usage.normalize_quantity(F.col("q")).eqNullSafe(F.col("want"))).collect() == []


def test_recorded_stream_keeps_the_first_and_rejects_the_rest(spark, folder):
    schema = "component string, tenant_id string, event_id string, event_sha256 string, quantity int, occurred_at timestamp"
    add = lambda rows: spark.createDataFrame(rows, "component string, tenant_id string, event_id string, event_sha256 string, quantity int, at string").select(
        "component", "tenant_id", "event_id", "event_sha256", "quantity", F.col("at").cast("timestamp").alias("occurred_at")).coalesce(1).write.mode("append").parquet(folder + "/in")

    def run():
        src = stream_dedupe(spark.readStream.schema(schema).parquet(folder + "/in"), ["component", "tenant_id", "event_id", "event_sha256"])
        start_recording(src, folder + "/ledger", folder + "/rejects", folder + "/c", "2024-06-01 00:00:00").awaitTermination()

    add([("c", "t", "e1", "x", 1, "2024-05-01 00:00:00"), ("c", "t", "e1", "x", 1, "2024-05-01 00:00:00"), ("c", "t", "e2", "y", 1, "2020-01-01 00:00:00")])
    run()
    add([("c", "t", "e1", "x", 1, "2024-05-01 00:00:00"), ("c", "t", "e1", "z", 2, "2024-05-02 00:00:00"), ("c", "t", "e3", "w", 1, "2024-06-01 00:04:00")])
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(folder + "/ledger").collect()) == ["e1", "e3"]
    assert sorted((r["event_id"], r["outcome"]) for r in spark.read.parquet(folder + "/rejects").collect()) == [("e1", "conflict"), ("e2", "out-of-range")]


def test_sliding_indicators_stream(spark, folder):
    rows = [("s", f"2024-01-01 00:0{i}:30", "error" if i == 1 else "ok", 100.0 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "service string, at string, outcome string, duration_ms double").select("service", F.col("at").cast("timestamp").alias("ts"), "outcome", "duration_ms")
    df.write.parquet(folder + "/in")
    out = stream_sli(spark.readStream.schema(df.schema).parquet(folder + "/in"), 500, "0 seconds")
    out.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r["at"].minute: (r["request_count"], r["server_error_count"], r["latency_good_count"]) for r in spark.read.parquet(folder + "/out").collect()}
    assert got[5] == (5, 1, 5) and got[8] == (5, 0, 3)


def test_snapshot_status(spark):
    df = spark.createDataFrame([("a", 100000, 50, 100000, 96000), ("b", 0, 0, 0, 0), ("c", 10, 1, 10, 10)], "service string, request_count long, server_error_count long, latency_eligible_count long, latency_good_count long")
    out = {r["service"]: r for r in slo.slo_snapshot(df).collect()}
    assert out["a"]["status"] == "MET" and abs(out["a"]["availability_sli"] - 0.9995) < 1e-12 and abs(out["a"]["latency_sli"] - 0.96) < 1e-12
    assert out["b"]["status"] == "INSUFFICIENT_DATA" and out["b"]["availability_sli"] is None and out["c"]["status"] == "BREACHED"


def test_line_types_with_state(spark):
    doc = "---\ntitle: x\n---\n# A\n\nSet\n===\n~~~~\n```\n~~~\n# no\n~~~~\n<!-- a\nb -->\na | b\n--- | ---\nc | d\n\n> q\n- item\n    code\nplain"
    out = [r["type"] for r in text.line_types(spark.createDataFrame([(1, doc)], "doc_id int, text string")).orderBy("line_no").collect()]
    assert out == ["front-matter"] * 3 + ["heading", "blank", "heading", "heading-underline", "fence", "code", "code", "code", "fence", "comment", "comment", "table", "table", "table", "blank", "blockquote", "list", "code", "prose"]


def test_claims_and_acronyms(spark):
    docs = spark.createDataFrame([(1, "It is *fully*-compliant."), (2, "ＦＵＬＬＹ compliant?"), (3, "full comply")], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in text.blocked_claims(docs, ["Fully compliant"]).collect()) == [1, 2]
    lines = text.line_types(spark.createDataFrame([(1, "uses ABC now\nApplication Binary (XYZ) and XYZ\nlater XYZ ABC GET")], "doc_id int, text string"))
    assert [(r["acronym"], r["line_no"]) for r in text.acronym_findings(lines, []).collect()] == [("ABC", 1)]


def test_components_and_closure_against_brute_force(spark):
    import random
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert {r["node"]: r["component"] for r in G.connected(df).collect()} == {n: find(n) for n in parent}
    pairs = set(edges)
    while True:
        more = pairs | {(a, d) for a, b in pairs for c, d in pairs if b == c}
        if more == pairs:
            break
        pairs = more
    assert {(r["a"], r["b"]) for r in G.closure(df).collect()} == pairs
