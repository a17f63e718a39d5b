"""Requirements from shape statements: paths at any depth, loops, faulty lists, severities from below, derived cases."""

from dataward.operators import requirements as R

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NS, REQ = "urn:s:", "urn:x:req"


def quads(spark, rows):
    """Rows (s, p, o): names that start with _ are anonymous, those in quotes are literals."""
    kind = lambda x: "bnode" if x.startswith("_") else "literal" if x.startswith('"') else "iri"
    full = lambda p: R.SH + p[3:] if p.startswith("sh:") else RDF + p[4:] if p.startswith("rdf:") else p
    data = [("g", s, kind(s), full(p), full(o).strip('"'), kind(o)) for s, p, o in rows]
    return spark.createDataFrame(data, "graph string, s string, s_kind string, p string, o string, o_kind string")


def paths(spark, rows):
    return {r["node"]: r["path"] for r in R.path_texts(quads(spark, rows)).collect()}


def test_paths_nest_at_any_depth(spark):
    chain = [(f"_n{i}", "sh:inversePath", f"_n{i + 1}") for i in range(9)] + [("_n9", "sh:zeroOrMorePath", "urn:p")]
    rows = chain + [("_l0", "rdf:first", "_n7"), ("_l0", "rdf:rest", "_l1"), ("_l1", "rdf:first", "urn:q"), ("_l1", "rdf:rest", "rdf:nil"),
                    ("_a", "sh:alternativePath", "_l0"), ("_e", "sh:alternativePath", "rdf:nil"), ("_o", "sh:zeroOrOnePath", "_a"), ("_m", "sh:oneOrMorePath", "_o")]
    got = paths(spark, rows)
    assert got["_n0"] == "^" * 9 + "(urn:p)*"
    assert got["_l0"] == "(^^(urn:p)*/urn:q)" and got["_a"] == "(^^(urn:p)*|urn:q)" and got["_e"] == "()"
    assert got["_m"] == "(((^^(urn:p)*|urn:q))?)+"


def test_loops_faulty_lists_and_literals(spark):
    rows = [("_a", "sh:inversePath", "_b"), ("_b", "sh:zeroOrMorePath", "_a"), ("_c", "sh:oneOrMorePath", "_a"), ("_d", "sh:inversePath", "_c"),
            ("_x", "sh:alternativePath", "_l"), ("_l", "rdf:first", "urn:p"), ("_l", "rdf:rest", "_gone"), ("_y", "sh:inversePath", '"text"'), ("_z", "sh:inversePath", "_nothing"),
            ("_t", "sh:inversePath", "urn:p"), ("_t", "sh:inversePath", "urn:q"), ("_t", "sh:zeroOrOnePath", "urn:r")]
    got = paths(spark, rows)
    assert got["_a"] == "_:unsupported(_a)" and got["_b"] == "_:unsupported(_b)"
    assert got["_c"] == "(_:unsupported(_a))+" and got["_d"] == "^(_:unsupported(_a))+"
    assert "_x" not in got and got["_y"] == "^_:unsupported(text)" and got["_z"] == "^_:unsupported(_nothing)"
    assert got["_t"] == "(urn:r)?"


def test_severity_obligation_and_counts(spark):
    rows = [("urn:s:A", "rdf:type", "sh:NodeShape"), ("urn:s:A", "sh:closed", '"true"'), ("urn:s:A", "sh:property", "_p"), ("urn:s:A", "sh:property", "_q"),
            ("_p", "sh:severity", "sh:Warning"), ("_p", "sh:maxCount", '"0"'), ("_q", "sh:severity", "sh:Info"), ("_q", "sh:minCount", '"01"'),
            ("urn:s:B", "sh:targetNode", "urn:x:1"), ("urn:s:B", "sh:in", "rdf:nil"), ("urn:s:B", "sh:property", "_empty"),
            ("urn:s:C", "rdf:type", "sh:NodeShape"), ("urn:s:C", "sh:property", "_r"), ("_r", "sh:severity", "urn:x:odd"), ("_r", "sh:minCount", '"1"'), ("_r", REQ, '"R-1"'), ("_r", REQ, '"R-0"'),
            ("urn:other:D", "rdf:type", "sh:NodeShape"), ("urn:other:D", "sh:closed", '"true"')]
    got = {r["node"]: r for r in R.shape_requirements(quads(spark, rows), NS, REQ).collect()}
    assert set(got) == {"urn:s:A", "urn:s:B", "_p", "_q", "_empty", "_r"}
    assert (got["urn:s:A"]["severity"], got["urn:s:A"]["obligation"], got["urn:s:A"]["kind"]) == ("Warning", "SHOULD", "node-shape")
    assert (got["_p"]["obligation"], got["_p"]["maximum"], got["_p"]["owner"]) == ("SHOULD-NOT", 0, "urn:s:A")
    assert (got["_q"]["obligation"], got["_q"]["minimum"]) == ("MAY", None)
    assert (got["urn:s:B"]["severity"], got["urn:s:B"]["obligation"]) == ("Violation", "MUST-NOT")
    assert (got["_empty"]["severity"], got["_empty"]["obligation"], got["_empty"]["requirement_ids"]) == ("Violation", "MUST", [])
    assert (got["_r"]["severity"], got["_r"]["obligation"], got["_r"]["requirement_ids"], got["_r"]["path"]) == (None, "MUST", ["R-0", "R-1"], None)


def test_derived_cases(spark):
    reqs = spark.createDataFrame([("R1", "F1", "F2", ["core", "core"]), ("R2", "F1", "F3", ["core", "extra"]), ("R3", None, "F9", ["lab"]), ("R4", "F2", "F2", ["extra", "odd"])],
                                 "requirement_id string, positive_fixture_id string, negative_fixture_id string, profiles array<string>")
    fixtures = spark.createDataFrame([("F1", "conforms", "a", ["core", "lab"]), ("F2", "violates", "b", ["core", "extra"]), ("F3", "violates", "c", ["lab"]), ("F4", "conforms", "d", ["core"]), ("F4", "conforms", "e", ["core"])],
                                     "fixture_id string, expected string, sha256 string, profiles array<string>")
    profiles = spark.createDataFrame([("core", "released"), ("extra", "released"), ("lab", "diagnostic")], "profile string, kind string")
    cases, links, faults = R.derive_cases(reqs, fixtures, profiles)
    assert sorted((r["case_id"], r["expected"], r["requirements"]) for r in cases.collect()) == [("FULL-F1-CORE", "conforms", 2), ("FULL-F2-CORE", "violates", 1), ("FULL-F2-EXTRA", "violates", 1)]
    assert sorted(tuple(r) for r in links.collect()) == [("FULL-F1-CORE", "R1"), ("FULL-F1-CORE", "R2"), ("FULL-F2-CORE", "R1"), ("FULL-F2-EXTRA", "R4")]
    assert sorted(tuple(r) for r in faults.collect()) == [
        ("FIXTURE_MISSING", "R3"), ("FIXTURE_REPEATED", "F4"), ("FIXTURE_UNKNOWN", "F9"), ("FIXTURE_WITHOUT_PROFILE", "F3"), ("NO_NEGATIVE_CASE", "R2"), ("NO_POSITIVE_CASE", "R4"),
        ("OUTCOME_MISMATCH", "F2"), ("PROFILE_UNKNOWN", "odd")]
