"""Steps that must not grow faster than their input: joins that no estimate turns into a broadcast, rounds, plans."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from dataward.operators import chain as CH
from dataward.operators import constraints as C
from dataward.operators import graph as G
from dataward.operators import graph_rules as R
from dataward.operators import report_rules as RR
from dataward.operators import requirements as REQ
from dataward.operators import text as T
from dataward.operators.offering import validate_events
from dataward.operators.sync import classify_events
from dataward.plans import streams, sync
from dataward.sources.feeds import EVENT_SCHEMA
from dataward.streaming.lifecycle import PhaseMachine

POLICY = {"hosts": ["data.example.org"], "stable_hosts": ["data.example.org"], "max_values": 2, "max_literal_length": 40, "profile_iri": "https://data.example.org/profile/main"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def catalogue(spark, folder):
    rows = []
    for i in range(4):
        s = f"https://data.example.org/id/{i}"
        rows += [(s, G.RDF_TYPE, R.DCAT + "Dataset", "iri"), (s, R.DCT + "publisher", "https://data.example.org/org/a", "iri"), (s, R.DCT + "identifier", str(i // 2), "literal"),
                 (s, R.DCT + "relation", "http://192.168.0.1/x", "iri")][:4 if i else 3]
    spark.createDataFrame(rows, "s string, p string, o string, o_kind string").select(
        F.lit("main").alias("graph"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")).write.parquet(f"{folder}/q")
    return spark.read.parquet(f"{folder}/q")


def test_public_graph_scan_keeps_large_sides_off_the_driver(spark, folder):
    q = catalogue(spark, folder)
    keys = R.scoped_key_unique(q)
    assert "BroadcastExchange" not in plan(keys)
    assert {r["focus_node"][-1] for r in keys.collect()} == {"1", "3"}
    found = R.scan_public_graph(q, POLICY)
    assert "ArrowEvalPython" not in plan(found)  # verdicts are made once, not inside the plan of all rules
    assert {("DS-ID-UNIQUE-001", "1"), ("DS-ID-UNIQUE-001", "3"), ("SEC-PUBLIC-001", "1"), ("SEC-PUBLIC-001", "3")} <= {(r["code"], r["focus_node"][-1]) for r in found.collect()}


def test_reach_pairs_rounds_do_not_grow_with_the_number_of_branchings(spark, monkeypatch):
    # A way of 24 nodes, each with a dead end beside it, that runs into a ring of two.
    edges = [(i, i + 1) for i in range(24)] + [(i, 100 + i) for i in range(24)] + [(24, 23)]
    calls = []
    monkeypatch.setattr(G, "cut_lineage", lambda df, f=G.cut_lineage: calls.append(1) or f(df))
    got = G.reach_pairs(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (20,), (105,)], "node long"))
    want = {(s, n) for s in (0, 20) for n in [*range(s, 25), *range(100 + s, 124)]} | {(105, 105)}
    assert len(calls) < 40
    rows = [(r["start"], r["node"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_estimates_of_reach_pairs_do_not_grow_with_rounds(spark, monkeypatch):
    # Ways of 64 nodes with a dead end beside each, and one of 64 without: both are followed by doubling.
    edges = [(i, i + 1) for i in range(64)] + [(i, 1000 + i) for i in range(64)] + [(2000 + i, 2001 + i) for i in range(64)]
    calls = []
    monkeypatch.setattr(G, "stored", lambda df, f=G.stored: calls.append(1) or f(df))
    got = G.reach_pairs(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (2000,)], "node long"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 128  # two million bits where rounds multiply it
    assert len(calls) < 40
    assert sorted(r["node"] for r in got.collect()) == [*range(65), *range(1000, 1064), *range(2000, 2065)]


def test_domain_range_reads_statements_twice(spark, folder):
    ns = "urn:d#"
    typed = lambda p, kind: (p, G.RDF_TYPE, R.OWL + kind, "iri", None)
    terms = [typed(ns + "obj", "ObjectProperty"), (ns + "obj", R.RDFS + "domain", "A", "iri", None), (ns + "obj", R.RDFS + "domain", "B", "iri", None), (ns + "obj", R.RDFS + "range", R.RDFS + "Resource", "iri", None),
             typed(ns + "dat", "DatatypeProperty"), (ns + "dat", R.RDFS + "domain", R.RDFS + "Resource", "iri", None), (ns + "dat", R.RDFS + "range", R.XSD + "integer", "iri", None),
             typed(ns + "both", "ObjectProperty"), typed(ns + "both", "DatatypeProperty"), typed(ns + "note", "AnnotationProperty"), typed(ns + "far", "ObjectProperty"), (ns + "far", R.RDFS + "range", "A", "iri", None),
             (ns + "odd", R.RDFS + "domain", "A", "iri", None), ("B2", R.RDFS + "subClassOf", "B", "iri", None), ("B", R.RDFS + "subClassOf", "A", "iri", None)]
    rows = [("x", G.RDF_TYPE, "B2", "iri", None), ("y", G.RDF_TYPE, "A", "iri", None), ("x", ns + "obj", "z", "iri", None), ("y", ns + "obj", "z", "iri", None), ("y", ns + "obj", "1", "literal", None),
            ("x", ns + "dat", "1", "literal", R.XSD + "integer"), ("x", ns + "dat", "one", "literal", R.XSD + "integer"), ("x", ns + "dat", "1", "literal", None), ("x", ns + "dat", "y", "iri", None),
            ("x", ns + "both", "1", "literal", None), ("x", ns + "note", "1", "literal", None), ("x", ns + "odd", "1", "literal", None), ("x", "urn:other", "1", "literal", None), ("y", ns + "far", "x", "iri", None), ("y", ns + "far", "z", "iri", None)]
    for name, some in (("o", terms), ("d", rows)):
        spark.createDataFrame(some, "s string, p string, o string, o_kind string, datatype string").select(
            F.lit("g").alias("graph"), "s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "datatype", F.lit(None).cast("string").alias("lang")).write.parquet(f"{folder}/{name}")
    found = R.domain_range(spark.read.parquet(f"{folder}/o"), spark.read.parquet(f"{folder}/d"), ns)
    assert plan(found).count(f"{folder}/d]") == 2  # local statements, types
    short = {"UNDECLARED_LOCAL_PROPERTY": "U", "PROPERTY_DOMAIN_MISSING": "PD", "DOMAIN_TYPE_MISMATCH": "D", "OBJECT_PROPERTY_LITERAL": "L", "DATATYPE_PROPERTY_RESOURCE": "R",
             "PROPERTY_RANGE_MISSING": "PR", "RANGE_TYPE_MISMATCH": "T", "DATATYPE_RANGE_MISMATCH": "M"}
    assert sorted((short[r["code"]], r["predicate"][len(ns):], r["s"], r["o"]) for r in found.collect()) == sorted([
        ("D", "obj", "y", "z"), ("D", "obj", "y", "1"), ("L", "obj", "y", "1"), ("M", "dat", "x", "one"), ("M", "dat", "x", "1"), ("R", "dat", "x", "y"), ("PD", "both", "x", "1"), ("PR", "both", "x", "1"),
        ("U", "odd", "x", "1"), ("PD", "far", "y", "x"), ("PD", "far", "y", "z"), ("T", "far", "y", "z")])


def test_event_validation_shuffles_no_record(spark, folder):
    line = F.concat(F.lit('{"batch_id": "b", "event_id": "e'), F.greatest(F.col("id"), F.lit(1)).cast("string"), F.lit('"}'))
    spark.range(3).select(F.from_json(line, EVENT_SCHEMA).alias("e")).select("e.*").write.parquet(f"{folder}/events")
    got = validate_events(spark.read.parquet(f"{folder}/events"))
    assert "Exchange hashpartitioning" not in plan(got)
    assert sorted((r["event_id"], "DUPLICATE_EVENT_IN_BATCH" in r["errors"]) for r in got.collect()) == [("e1", True), ("e1", True), ("e2", False)]


def test_large_batches_of_a_feed_have_many_files(spark):
    folder = streams._feed(spark.range(2 * streams._LINES + 1).coalesce(1).select("id", F.lit(0).alias("b")), "b")
    assert spark.read.text(f"{folder}/feed").select(F.input_file_name()).distinct().count() == 3


def test_shape_statements_are_stored_before_they_are_joined(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(REQ, "stored", lambda df, f=REQ.stored: kept.append(df.columns) or f(df))
    cells = ["graph", "s", "s_kind", "p", "o", "o_kind"]
    rows = [("urn:n", "iri", G.RDF_TYPE, REQ.SH + "NodeShape", "iri"), ("urn:n", "iri", REQ.SH + "property", "x", "bnode"), ("x", "bnode", REQ.SH + "path", "urn:p", "iri"), ("x", "bnode", REQ.SH + "minCount", "1", "literal")]
    q = spark.createDataFrame([("g", *r) for r in rows], ", ".join(f"{c} string" for c in cells))
    assert [(r["node"], r["path"], r["minimum"]) for r in REQ.shape_requirements(q, "urn:", "urn:id").collect()] == [("x", "urn:p", 1)] and kept[0] == cells


def test_steps_of_transfers_are_rows(spark):
    machine = PhaseMachine(1, 1, False)
    assert list(machine._rows(("t",), [(1, "active", "rejected")])) == [Row(transfer_id="t", step_no=1, phase="active", verdict="rejected")]


def text_lines(spark):
    docs = spark.createDataFrame([(1, "# A\n\n## 1. b\n- 30 % of it\nSRC-1\n| x |\n"), (2, "plain")], "doc_id long, text string")
    return T.line_types(docs.repartition(2))


def test_lines_of_documents_are_sorted_once(spark):
    near = T.near_marker(text_lines(spark), r"\d+\s*%", r"SRC-\d+", "^source:", 3)
    assert plan(near).count("Sort [") == 1
    assert [tuple(r) for r in near.collect()] == [(1, 4, False)]
    # One more sort finds repeats, over shown lines without their windows.
    assert plan(RR.report_findings(text_lines(spark))).count("Sort [") == 2


def test_structure_rules_pass_over_lines_once(spark):
    lines = text_lines(spark)
    assert plan(T.heading_findings(lines)).count("Sort [") == plan(RR.section_findings(lines)).count("Sort [") == 1
    assert sorted(tuple(r) for r in T.heading_findings(lines).collect()) == [(2, 1, "STR001", "H1_COUNT")]


def test_equal_terms_are_grouped_once(spark):
    q = spark.createDataFrame([("n", "p", "1"), ("n", "p", "2"), ("n", "r", "2"), ("n", "r", "3")], "s string, p string, o string").select(
        F.lit("g").alias("graph"), "s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    focus = q.select("graph", F.col("s").alias("node"), F.col("s_kind").alias("node_kind")).distinct()
    got = C.equals(q, focus, C.values_of(q, focus, "p"), "r", {})
    assert "LeftAnti" not in plan(got)
    assert sorted(r["value"] for r in got.collect()) == ["1", "3"]


def test_receipts_leave_their_chain_digests_behind(spark):
    records = spark.createDataFrame([(str(i), f"c{i}") for i in range(4)], "event_id string, content_digest string").withColumns(
        {"committed_at": F.lit("2024-01-01").cast("timestamp_ntz"), "retention_until": F.lit("2024-01-31").cast("timestamp_ntz")})
    rows = [("0", 1, None, "r1"), ("1", 2, "r1", "r2"), ("2", 3, "other", "r3"), ("3", 4, None, "r4")]
    receipts = spark.createDataFrame(rows, "event_id string, sequence long, previous_receipt_digest string, receipt_digest string").withColumns(
        {"backend_id": F.lit("b"), "content_digest": F.concat(F.lit("c"), "event_id"), "retention_until": F.lit("2024-01-31").cast("timestamp_ntz")})
    found = CH.verify_receipts(records, receipts, 30, "b", F.col("receipt_digest"))
    assert sorted(tuple(r) for r in found.collect()) == [("2", "CHAIN_BROKEN"), ("3", "CHAIN_BROKEN")]
    assert "count(distinct" not in found._jdf.queryExecution().optimizedPlan().toString().lower() and "_own" not in plan(found)


def test_stored_state_moves_no_event(spark):
    ev = spark.createDataFrame([("s", "k", "1", "e1", 1, "record.upsert", "d"), ("s", "k", "3", "e2", None, "record.upsert", "d")],
                               "source_system_id string, record_id string, resource_version string, event_id string, pos long, event_type string, event_digest string")
    state = spark.createDataFrame([("s", "k", "2", "d", False)], "source_system_id string, record_id string, resource_version string, event_digest string, withdrawn boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = classify_events(ev, state, None)
        assert plan(got).count("Exchange hashpartitioning") == 5  # summaries, their keys, the state, and both sides of the way back
        assert {r["event_id"]: r["result"] for r in got.collect()} == {"e1": "stale", "e2": "applied"}
        # A key that repeats in the state repeats events; none of them competes with its own copy.
        twice = classify_events(ev, state.union(state), None).collect()
        assert sorted((r["event_id"], r["result"]) for r in twice) == [("e1", "stale")] * 2 + [("e2", "applied")] * 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_latest_per_key_joins_its_ledger_once(spark, folder):
    spark.range(40).select((F.col("id") % 7).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), (F.col("id") % 5).cast("int").alias("l_linenumber"),
                           F.when(F.col("id") % 9 == 0, "R").otherwise("N").alias("l_returnflag"), F.timestamp_seconds(F.lit(10**9) + F.col("id") * 10**6).alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(9).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("P").alias("o_orderstatus")).write.parquet(f"{folder}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sync.latest_per_key(spark, folder)
        assert len({r["record_id"] for r in got.collect()}) == got.count() > 0
        # Both ways through ``running`` read the events as they were shuffled for the ledger, and summaries do not travel with the events.
        final = plan(got).split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final and "_in__best" not in [x for x in final.splitlines() if "REPARTITION_BY_COL" in x][0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_closures_of_paths_are_made_of_numbers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "closure", lambda edges, f=G.closure: seen.append(dict(edges.dtypes)) or f(edges))
    none = F.lit(None).cast("string")
    q = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "s string, o string").select(
        F.lit("g").alias("graph"), "s", F.lit("iri").alias("s_kind"), F.lit("p").alias("p"), "o", F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    plus, star = ([(r["s"], r["o"]) for r in G.path(q, (form, "p")).collect()] for form in ("plus", "star"))
    assert sorted(plus) == [("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")]
    assert sorted(star) == [("a", "a"), *sorted(plus)]
    assert seen == [{"a": "bigint", "b": "bigint"}] * 2


def test_signature_rounds_read_stored_links(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(G, "stored", lambda df, f=G.stored: kept.append(df.columns) or f(df))
    q = spark.createDataFrame([("a", "x", "bnode"), ("x", "1", "literal")], "s string, o string, o_kind string").select(
        F.lit("g").alias("graph"), "s", F.lit("p").alias("p"), "o", "o_kind", F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    assert {r["s"] for r in G.node_signature(q).collect()} == {"a", "x"} and ["graph", "s", "p", "_child"] in kept
