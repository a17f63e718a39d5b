"""Change events against a sequential replay, and the harvest loop end to end."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from dataward.operators import offering as O
from dataward.operators import sync as S
from dataward.sources.feeds import BATCH_SCHEMA, read_batches, stream_batches
from dataward.streaming.sync import current_state, stream_lifecycle, stream_sync

CFG = O.ProjectionConfig("urn:example:space", "svc", "https://c.invalid/dsp")


def replay(events, state, ledger):
    """What a sequential pass decides, one event after the other."""
    rows, out = dict(state), []
    for e in events:
        result = conflict = None
        if e["event_id"] in ledger:
            result = "duplicate"
            if ledger[e["event_id"]] != e["event_digest"]:
                conflict = "EVENT_ID_CONFLICT"
        else:
            held = rows.get(e["record_id"])
            v = int(e["resource_version"])
            if held and v < held[0]:
                result = "stale"
            elif held and v == held[0]:
                result = "duplicate-version"
                if held[1] != e["event_digest"]:
                    conflict = "RESOURCE_VERSION_CONFLICT"
            else:
                gone = e["event_type"] == "record.deleted"
                result = "withdrawn" if gone else "applied"
                if held and held[2] and not gone:
                    conflict = "TERMINAL_RECORD_REVIVAL"
                rows[e["record_id"]] = (v, e["event_digest"], gone)
        out.append((e["pos"], result, conflict))
    return out


@pytest.mark.parametrize("seed,block", [(1, 2), (2, 7), (3, 10**6)])
def test_classification_equals_sequential_replay(spark, seed, block):
    rng = random.Random(seed)
    events = [dict(source_system_id="s", batch_id="b", event_id=f"e{i}", pos=i, record_id="hot" if rng.random() < .5 else f"r{rng.randint(0, 4)}",
                   resource_version=str(rng.choice([1, 2, 3, 9, 10, 11, 10**40])), event_type=rng.choice(["record.upsert"] * 4 + ["record.deleted"]), event_digest=rng.choice("xyz")) for i in range(120)]
    state = {"hot": (2, "x", False), "r1": (9, "y", True)}
    ledger = {"e3": "x", "e9": "nope"}
    ev = spark.createDataFrame(events)
    st = spark.createDataFrame([("s", k, str(v), d, w) for k, (v, d, w) in state.items()], "source_system_id string, record_id string, resource_version string, event_digest string, withdrawn boolean")
    lg = spark.createDataFrame([("s", "e3", events[3]["record_id"], events[3]["event_digest"]), ("s", "e9", events[9]["record_id"], "nope")], "source_system_id string, event_id string, record_id string, event_digest string")
    ledger["e3"] = events[3]["event_digest"]
    got = S.classify_events(ev, st, lg, block).select("pos", "result", "conflict").orderBy("pos").collect()
    want = replay(events, state, ledger)
    # After the first conflict a sequential pass stops, so only rows up to it must agree.
    stop = next((i for i, w in enumerate(want) if w[2]), len(want) - 1)
    assert [tuple(r) for r in got[:stop + 1]] == want[:stop + 1]
    verdict = S.batch_verdict(S.classify_events(ev, st, lg, block)).first()
    first = next((w for w in want if w[2]), None)
    assert verdict["conflict"] == (first[2] if first else None)


def record(**changes):
    ok = dict(record_type="dataset", title=" Roads ", description="d", publisher=dict(id="urn:x:org", name="Org"), landing_page="https://a.invalid/x", issued_at="2024-01-01T00:00:00Z", modified_at="2024-01-02T00:00:00Z",
              keywords=["a", "a "], themes=[], evidence_ids=["ev-1"], access_rights="open", license="https://a.invalid/l", rights=None, origin_data_holder_id="h", provider_participant_id="p", connector_operator_id="c", delivery_operator_id="d",
              contracting_party_id="x", platform_record_role=dict(value="hosted", evidence_ids=["ev-2"]), provider_authority=dict(kind="owner", evidence_ids=["ev-3"]), transfer_decision="approved", policy_ref="policy:open",
              distributions=[dict(id="d1", access_profile="pull", format="CSV", transfer_format="transfer:http", media_type="https://www.iana.org/assignments/media-types/text/csv", source_binding_ref="binding://a/b", lifecycle_mode="none", revocation_mode=None, evidence_ids=["ev-4"])])
    return {**ok, **changes}


def decided(spark, rec, **approval):
    df = spark.createDataFrame([("s", "r", "1", json.dumps(rec))], "source_system_id string, record_id string, resource_version string, j string")
    df = df.withColumn("record", F.from_json("j", O.RECORD_SCHEMA.replace("\n", ""))).withColumn("record_digest", F.lit("d"))
    a = dict(dict(source_system_id="s", record_id="r", resource_version="1", record_digest="d", approval_id="a", approved_at="2024-01-01 00:00:00", valid_until="2024-12-31 00:00:00", catalog_visibility="public", offering_decision="approved"), **approval)
    ap = spark.createDataFrame([a]).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("approved_at", "valid_until")})
    return O.decide(df, ap, CFG, "2024-06-01 00:00:00").first()


@pytest.mark.parametrize("changes,state,codes", [
    ({}, "APPROVED", []), (dict(record_type="post"), "CATALOG_ONLY", ["NOT_DATASET"]), (dict(access_rights="excluded"), "QUARANTINED", ["ACCESS_EXCLUDED"]),
    (dict(platform_record_role=dict(value="index-only", evidence_ids=[])), "CATALOG_ONLY", ["INDEX_ONLY"]), (dict(license=None), "PENDING_EVIDENCE", ["MISSING_RIGHTS"]),
    (dict(access_rights=None, policy_ref=None), "PENDING_EVIDENCE", ["ACCESS_RIGHTS_UNKNOWN", "MISSING_POLICY"]), (dict(distributions=[]), "PENDING_EVIDENCE", ["MISSING_DISTRIBUTION"])])
def test_offering_decision(spark, changes, state, codes):
    row = decided(spark, record(**changes))
    assert (row["decision_state"], [r["code"] for r in row["decision_reasons"]]) == (state, codes)


@pytest.mark.parametrize("changes,code,field", [
    (dict(title="  "), "INVALID_FIELD", "record.title"), (dict(landing_page="http://a.invalid/"), "INSECURE_URL", "record.landingPage"), (dict(landing_page="https://a.org/"), "NON_SYNTHETIC_PUBLIC_URL", "record.landingPage"),
    (dict(record_type="x"), "INVALID_RECORD_TYPE", "recordType"), (dict(policy_ref="plain"), "INVALID_REFERENCE", "record.policyRef"), (dict(evidence_ids=["a b"]), "INVALID_IDENTIFIER", "record.evidenceIds"), (dict(issued_at="2024-02-30T00:00:00Z"), "INVALID_TIMESTAMP", "record.issuedAt")])
def test_broken_records_are_quarantined_alone(spark, changes, code, field):
    row = decided(spark, record(**changes))
    assert row["decision_state"] == "QUARANTINED" and (row["record_errors"][0]["code"], row["record_errors"][0]["field"]) == (code, field)
    assert row["projection"] is None and row["candidate_id"] is None


def test_expired_and_future_approvals(spark):
    assert decided(spark, record(), valid_until="2024-05-31 23:59:59")["approval_reason"] == "APPROVAL_EXPIRED"
    assert decided(spark, record(), valid_until="2024-06-01 00:00:00")["decision_state"] == "APPROVED"
    early = decided(spark, record(), approved_at="2024-06-01 00:00:01")
    assert early["approval_reason"] == "APPROVAL_NOT_YET_VALID" and early["next_evaluation_at"] is not None
    assert decided(spark, record(), record_digest="other")["approval_reason"] == "APPROVED_DIGEST_MISMATCH"


def write_batch(path, name, events):
    doc = dict(batch_id=name, source_system_id="s", mode="delta", observed_at="2024-06-01T00:00:00Z", records=events)
    with open(os.path.join(path, name + ".json"), "w") as f:
        json.dump(doc, f)


def event(i, rec, version, kind="record.upsert", **changes):
    return dict(event_id=f"e{i}", event_type=kind, record_id=rec, resource_version=version, occurred_at="2024-05-31T00:00:00Z", record=record(**changes) if kind == "record.upsert" else None)


def test_harvest_loop(spark, folder):
    feed = os.path.join(folder, "feed")
    os.makedirs(feed)
    paths = {n: os.path.join(folder, n) for n in ("state", "reports", "ledger", "checkpoint")}

    def run():
        q = stream_sync(stream_batches(spark, feed, 1), paths["state"], paths["reports"], paths["ledger"], paths["checkpoint"], "2024-06-01 01:00:00")
        q.awaitTermination()

    write_batch(feed, "b1", [event(1, "r1", "1"), event(2, "r2", "9")])
    assert read_batches(spark, feed).count() == 2
    run()
    rows = lambda: {r["record_id"]: (r["resource_version"], r["withdrawn"]) for r in current_state(spark, paths["state"]).collect()}
    assert rows() == {"r1": ("1", False), "r2": ("9", False)}
    write_batch(feed, "b2", [event(3, "r2", "10", title="new"), event(4, "r1", "2", "record.deleted"), event(5, "r2", "8")])
    run()
    assert rows() == {"r1": ("2", True), "r2": ("10", False)}
    write_batch(feed, "b3", [event(6, "r2", "11"), event(7, "r1", "3")])
    with pytest.raises(Exception, match="conflicts"):
        run()
    assert rows() == {"r1": ("2", True), "r2": ("10", False)}   # revival rejects the whole batch


def test_lifecycle_stream(spark, folder):
    steps = [("a", 1, "authorized"), ("a", 2, "provisioned"), ("a", 3, "terminated"), ("a", 4, "active"), ("b", 1, "active")]
    src = os.path.join(folder, "steps")
    spark.createDataFrame(steps, "transfer_id string, step_no long, phase string").write.parquet(src)
    out = stream_lifecycle(spark.readStream.schema("transfer_id string, step_no long, phase string").parquet(src))
    q = out.writeStream.format("parquet").option("path", os.path.join(folder, "out")).option("checkpointLocation", os.path.join(folder, "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["transfer_id"], r["step_no"]): r["verdict"] for r in spark.read.parquet(os.path.join(folder, "out")).collect()}
    assert got == {("a", 1): "accepted", ("a", 2): "accepted", ("a", 3): "rejected", ("a", 4): "accepted", ("b", 1): "rejected"}
