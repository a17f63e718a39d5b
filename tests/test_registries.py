"""Registries whose keys repeat, nested values to redact, and JSON that is none."""

from datetime import datetime

from pyspark.sql import functions as F

from dataward.functions.redaction import redact
from dataward.functions.sensitive import scan_nested_secrets
from dataward.operators import registries as R

NOW = "2024-06-01 00:00:00"
EARLY, LATE = datetime(2024, 5, 31, 23), datetime(2024, 7, 1)
HEADER = {"status": "READY", "issued_at": "2024-05-31 23:00:00", "valid_until": "2024-07-01 00:00:00", "max_age_seconds": 86400}


def test_repeated_approvals_decide_nothing_and_multiply_nothing(spark):
    asked = spark.createDataFrame([(s, "r", "1", "d") for s in ("one", "two", "none")], "source_system_id string, record_id string, resource_version string, record_digest string")
    rows = [(s, "r", "1", "d", EARLY, LATE, "public", "approved", f"a{i}") for i, s in enumerate(("one", "two", "two"))]
    approvals = spark.createDataFrame(rows, "source_system_id string, record_id string, resource_version string, record_digest string, approved_at timestamp_ntz, "
                                      "valid_until timestamp_ntz, catalog_visibility string, offering_decision string, approval_id string")
    got = {r["source_system_id"]: (r["approval_reason"], r["catalog_visibility"], r["approval_id"]) for r in R.resolve_approvals(asked, approvals, NOW).collect()}
    assert got == {"one": (None, "public", "a0"), "two": ("DUPLICATE_APPROVAL_ENTRY", "internal", None), "none": ("APPROVAL_ENTRY_MISSING", "internal", None)}
    assert R.resolve_approvals(asked, approvals, NOW).count() == 3


def test_repeated_envelopes_decisions_services_and_bindings(spark):
    kind = "approval_id string, source_system_id string, record_id string, resource_version string, payload_digest string"
    sent = spark.createDataFrame([(i, "s", "r", "1", "p", True, "production-connector") for i in ("x", "y")], kind + ", automatic_dispatch_allowed boolean, routing string")
    known = spark.createDataFrame([(i, "s", "r", "1", "p", "approved", "me", EARLY, LATE) for i in ("x", "y", "y")],
                                  kind + ", status string, approved_by string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    assert sorted(map(tuple, R.dispatch_gate(sent, known, NOW).select("approval_id", "gate_reason").collect())) == [("x", None), ("y", "DUPLICATE_APPROVAL_ID")]

    bound = "decision_id string, dataspace_id string, participant_id string, organization_id string, evidence_sha256 string"
    people = spark.createDataFrame([(i, "d", "p", "o", "e") for i in ("x", "y")], bound)
    decided = spark.createDataFrame([(i, "d", "p", "o", "e", "APPROVED", EARLY, LATE) for i in ("x", "y", "y")], bound + ", status string, decided_at timestamp_ntz, valid_until timestamp_ntz")
    got = R.verify_memberships(people, decided, NOW, HEADER).select("decision_id", "membership_reason")
    assert sorted(map(tuple, got.collect())) == [("x", None), ("y", "APPROVAL_REGISTRY_DUPLICATE")]

    spaces = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z"])], "space_id string, required_service_ids array<string>")
    services = spark.createDataFrame([(i, "READY", EARLY) for i in ("x", "y", "y")], "service_id string, status string, observed_at timestamp_ntz")
    got = {(r["space_id"], r["service_id"]): r["effective_status"] for r in R.service_status(spaces, services, NOW, HEADER).collect()}
    assert got == {("a", "x"): "READY", ("b", "x"): "READY", ("b", "y"): "DUPLICATE", ("c", "z"): "MISSING"}
    assert {r["space_id"]: r["ready"] for r in R.service_readiness(spaces, services, NOW, HEADER).collect()} == {"a": True, "b": False, "c": False}

    asked = spark.createDataFrame([(i, f, "f") for i, f in enumerate("xyz")], "n int, dataset_id string, format string")
    bindings = spark.createDataFrame([(d, "f", f"b{i}", "p", True) for i, d in enumerate("xyy")], "dataset_id string, format string, binding_id string, provisioner_id string, enabled boolean")
    got = R.resolve_bindings(asked, bindings).select("dataset_id", "binding_id", "error")
    assert sorted(map(tuple, got.collect())) == [("x", "b0", None), ("y", None, "DUPLICATE_TRANSFER_BINDING"), ("z", None, "TRANSFER_BINDING_NOT_FOUND")]


def test_redaction_walks_structs_arrays_and_maps(spark):
    kind = ("props struct<note: string, auth: struct<password: string, tokens: array<string>, token_count: int>, n: int>, "
            "items array<struct<text: string, attrs: map<string, array<string>>>>, nested map<string, map<string, string>>, apiKey string, client_secret array<string>")
    row = (("token=abc rest", ("pw", ["t1", None], 3), 7), [("Bearer abc.def", {"cookie": ["c"], "plain": ["password: x", "ok"]}), None],
           {"secret": {"a": "b"}, "open": {"api-key": "k", "b": "c"}, "null": None}, "key", ["s"])
    df = spark.createDataFrame([row, (None, None, None, None, None)], kind)
    out = redact(df, df.columns)
    assert [f.dataType.simpleString() for f in out.schema] == [f.dataType.simpleString() for f in df.schema]
    got, empty = sorted((r.asDict(recursive=True) for r in out.collect()), key=lambda r: r["props"] is None)
    hidden = "[REDACTED]"
    assert got["props"] == {"note": hidden + " rest", "auth": {"password": hidden, "tokens": [hidden, None], "token_count": None}, "n": 7}
    assert got["items"] == [{"text": hidden, "attrs": {"cookie": [hidden], "plain": [hidden, "ok"]}}, None]
    assert got["nested"] == {"secret": {"a": hidden}, "open": {"api-key": hidden, "b": "c"}, "null": None}
    assert got["apiKey"] == hidden and got["client_secret"] == [hidden]
    assert set(empty.values()) == {None}


def test_text_that_is_no_json_is_a_finding_and_keys_may_have_any_name(spark):
    rows = [(1, 9, '{"a": {"apiKey": "v"}}'), (2, 9, '{"a": '), (3, 9, None), (4, 9, '{"a": ["password=hunter22"]}')]
    df = spark.createDataFrame(rows, "k int, v int, doc string")
    got = scan_nested_secrets(df, "doc", ["k", "v"]).select("k", "v", "path", "code").orderBy(F.col("k"))
    assert [tuple(r) for r in got.collect()] == [
        (1, 9, "record.a.apiKey", "INLINE_SECRET_FIELD"), (2, 9, "record", "INPUT_NOT_JSON"), (4, 9, "record.a[0]", "INLINE_SECRET_VALUE")]
