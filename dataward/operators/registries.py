"""Decisions that join facts to registries with validity intervals.

Registries are joined without a hint: Spark broadcasts them only while they are under its own size
threshold and sort-merges them otherwise. The evaluation time is a column or a parameter, never the
wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.canonical import at_instant, seconds_between
from dataward.functions.lexical import identity_valid, local_identifier_valid

VERIFIED = "verified-synthetic"
# The actions an authority can cover.
ALLOWED_ACTIONS = ("catalog-publish", "contract-negotiate", "data-transfer", "delegate")


def _first(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that holds, NULL when none does."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(rules):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out


def _one_per_key(registry: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row for each key of a registry: its columns under ``prefix``, and how many rows have it (``{prefix}hit``).
    A key that repeats decides nothing, so it meets every request once, with any of its rows."""
    rest = [c for c in registry.columns if c not in keys]
    grouped = registry.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}hit"), F.any_value(F.struct(*rest)).alias("_row"))
    return grouped.select(*keys, f"{prefix}hit", *[F.col("_row")[c].alias(prefix + c) for c in rest])


APPROVAL_KEYS = ["source_system_id", "record_id", "resource_version"]


def resolve_approvals(df: DataFrame, approvals: DataFrame, now) -> DataFrame:
    """Approval of each (source, record, version, digest) at ``now``; both interval ends count.

    Adds approval_status, approval_reason, next_evaluation_at, catalog_visibility,
    offering_decision, approval_id and valid_until. An unverified approval reads as internal/pending,
    and so does a key that the registry holds more than once.
    """
    clock = at_instant(now)
    a = _one_per_key(approvals, APPROVAL_KEYS, "_a_")
    joined = df.join(a, APPROVAL_KEYS, "left").withColumn("_now", clock)
    reason = _first(
        (F.col("_a_hit").isNull(), "APPROVAL_ENTRY_MISSING"), (F.col("_a_hit") > 1, "DUPLICATE_APPROVAL_ENTRY"),
        (~F.col("record_digest").eqNullSafe(F.col("_a_record_digest")), "APPROVED_DIGEST_MISMATCH"),
        (F.col("_now") < F.col("_a_approved_at"), "APPROVAL_NOT_YET_VALID"),
        (F.col("_now") > F.col("_a_valid_until"), "APPROVAL_EXPIRED"))
    out = joined.withColumn("approval_reason", reason)
    ok = F.col("approval_reason").isNull()
    out = out.withColumns({
        "approval_status": F.when(ok, VERIFIED).otherwise("unverified"),
        "next_evaluation_at": F.when(F.col("approval_reason") == "APPROVAL_NOT_YET_VALID", F.col("_a_approved_at")),
        "catalog_visibility": F.when(ok, F.col("_a_catalog_visibility")).otherwise("internal"),
        "offering_decision": F.when(ok, F.col("_a_offering_decision")).otherwise("pending"),
        "approval_id": F.when(ok, F.col("_a_approval_id")),
        "approval_valid_until": F.when(ok, F.col("_a_valid_until"))})
    return out.drop("_now", *[c for c in out.columns if c.startswith("_a_")])


def approval_registry_findings(approvals: DataFrame, evidence_limit: int = 200) -> DataFrame:
    """Rows of an approval registry that are malformed or repeat a key or an approval id."""
    by_key = approvals.groupBy(*APPROVAL_KEYS).agg(F.count(F.lit(1)).alias("_k"))
    by_id = approvals.groupBy("approval_id").agg(F.count(F.lit(1)).alias("_i"))
    code = _first(
        (~F.col("resource_version").rlike(r"^(0|[1-9]\d{0,63})$")
         | ~F.col("record_digest").rlike(r"^[a-f0-9]{64}$")
         | ~(F.col("valid_until") > F.col("approved_at"))
         | ~F.col("catalog_visibility").isin("public", "qualified", "internal", "hidden")
         | ~F.col("offering_decision").isin("approved", "pending", "denied"), "INVALID_APPROVAL_ENTRY"),
        (F.col("_k") > 1, "DUPLICATE_APPROVAL_ENTRY"), (F.col("_i") > 1, "DUPLICATE_APPROVAL_ID"))
    return (approvals.join(by_key, APPROVAL_KEYS).join(by_id, "approval_id")
            .withColumn("code", code).where(F.col("code").isNotNull()).drop("_k", "_i"))


def dispatch_gate(envelopes: DataFrame, approvals: DataFrame, now) -> DataFrame:
    """May a command leave? Source binding, half-open validity and payload digest must all hold."""
    clock = at_instant(now)
    a = _one_per_key(approvals, ["approval_id"], "_a_")
    joined = envelopes.join(a, ["approval_id"], "left")
    bound = ((F.col("_a_source_system_id") == F.col("source_system_id"))
             & (F.col("_a_record_id") == F.col("record_id"))
             & (F.col("_a_resource_version") == F.col("resource_version")))
    reason = _first(
        (F.col("_a_hit") > 1, "DUPLICATE_APPROVAL_ID"),
        (~F.col("automatic_dispatch_allowed") | (F.col("routing") != "production-connector")
         | F.col("approval_id").isNull() | F.col("_a_hit").isNull()
         | (F.col("_a_status") != "approved"), "DISPATCH_APPROVAL_REQUIRED"),
        (~F.coalesce(bound, F.lit(False)), "DISPATCH_APPROVAL_SOURCE_MISMATCH"),
        (F.coalesce(F.col("_a_approved_by"), F.lit("")) == "", "DISPATCH_APPROVAL_REQUIRED"),
        (~((F.col("_a_valid_from") <= clock) & (F.col("_a_valid_until") > clock)), "DISPATCH_APPROVAL_EXPIRED"),
        (F.col("_a_payload_digest") != F.col("payload_digest"), "DISPATCH_APPROVAL_DIGEST_MISMATCH"))
    return joined.select(*envelopes.columns, reason.alias("gate_reason"))


def resolve_authority(requests: DataFrame, registry: DataFrame, registry_as_of, max_age_seconds: int) -> DataFrame:
    """Is the requested action on the asset covered by exactly one approved, current authority?

    The registry is grouped by the five match keys after its two arrays are exploded, so each
    request meets at most one row. Receipt columns on the request are optional: receipt_present,
    receipt_matches, receipt_verified_at, signature_verified.
    """
    as_of = at_instant(registry_as_of)
    keys = ["participant_id", "provider_id", "source_system_id", "asset_id", "action"]
    entries = (registry.withColumn("asset_id", F.explode(F.array_distinct("asset_ids")))
               .withColumn("action", F.explode(F.array_distinct("allowed_actions"))))
    entry = F.struct("authority_id", "decision", "revocation_status", "effective_from", "valid_until",
                     "revocation_checked_at", F.col("approval.status").alias("approval_status"),
                     F.col("approval.verified_at").alias("verified_at"))
    by_key = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(entry).alias("_e"))
    joined = requests.join(by_key, keys, "left")
    have = set(requests.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    at, e = F.col("evaluated_at"), lambda n: F.col(f"_e.{n}")
    stale = lambda since: seconds_between(at, since) > max_age_seconds
    verified_at = col("receipt_verified_at", "timestamp_ntz")
    reason = _first(
        (~identity_valid(F.col("participant_id")) | ~identity_valid(F.col("provider_id"))
         | ~local_identifier_valid(F.col("source_system_id")) | ~local_identifier_valid(F.col("asset_id"))
         | ~F.col("decision_request_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]{7,255}$"), "REQUEST_INVALID"),
        (~F.col("action").isin(*ALLOWED_ACTIONS), "ACTION_UNSUPPORTED"),
        (at.isNull(), "EVALUATION_TIME_INVALID"),
        (at > as_of, "REGISTRY_SNAPSHOT_TOO_OLD"),
        (F.col("_n").isNull(), "AUTHORITY_NOT_FOUND"),
        (F.col("_n") > 1, "AUTHORITY_AMBIGUOUS"),
        ((e("decision") != "approved") | (e("approval_status") != "verified"), "AUTHORITY_NOT_APPROVED"),
        (e("revocation_status") != "current", "AUTHORITY_NOT_CURRENT"),
        ((at < e("effective_from")) | (at >= e("valid_until")), "AUTHORITY_OUTSIDE_VALIDITY"),
        (e("revocation_checked_at") > at, "REVOCATION_EVIDENCE_FROM_FUTURE"),
        (stale(e("revocation_checked_at")), "REVOCATION_EVIDENCE_STALE"),
        (~F.coalesce(col("receipt_present", "boolean"), F.lit(False)), "AUTHORITY_VERIFICATION_REQUIRED"),
        (~F.coalesce(col("receipt_matches", "boolean"), F.lit(False)), "AUTHORITY_VERIFICATION_INVALID"),
        (verified_at.isNull() | (verified_at < e("verified_at")) | (verified_at > at) | stale(verified_at),
         "AUTHORITY_VERIFICATION_STALE"),
        (~F.coalesce(col("signature_verified", "boolean"), F.lit(False)), "AUTHORITY_SIGNATURE_UNVERIFIED"))
    return joined.select(
        *requests.columns, reason.alias("denial"), reason.isNull().alias("allowed"),
        F.when((F.col("_n") == 1) & ~F.coalesce(reason, F.lit("")).isin(
            "REQUEST_INVALID", "ACTION_UNSUPPORTED", "EVALUATION_TIME_INVALID", "REGISTRY_SNAPSHOT_TOO_OLD"),
            e("authority_id")).alias("authority_id"),
        F.when(reason.isNull(), e("valid_until")).alias("authority_valid_until"))


def authority_findings(registry: DataFrame, as_of) -> DataFrame:
    """Semantic errors of an authority registry, one row per entry and code."""
    clock = at_instant(as_of)
    dup_id = registry.groupBy("authority_id").agg(F.count(F.lit(1)).alias("_ids"))
    dup_ev = registry.groupBy(F.col("basis.evidence_id").alias("_ev")).agg(F.count(F.lit(1)).alias("_evs"))
    df = (registry.withColumn("_ev", F.col("basis.evidence_id"))
          .join(dup_id, "authority_id").join(dup_ev, "_ev", "left"))
    approved = F.col("decision") == "approved"
    a = lambda n: F.col(f"approval.{n}")
    timed = F.col("effective_from").isNotNull() & F.col("valid_until").isNotNull() & F.col("revocation_checked_at").isNotNull()
    stamped = approved & timed & a("approved_at").isNotNull() & a("verified_at").isNotNull()
    bad_identity = lambda c: ~F.coalesce(identity_valid(c), F.lit(False))
    rules = [
        (F.col("_ids") > 1, "DUPLICATE_AUTHORITY_ID"), (F.col("_evs") > 1, "DUPLICATE_EVIDENCE_ID"),
        (bad_identity(F.col("participant_id")) | bad_identity(F.col("provider_id"))
         | bad_identity(F.col("basis.issuer_id")) | bad_identity(F.col("basis.subject_id")), "IDENTITY_INVALID"),
        (~local_identifier_valid(F.col("source_system_id"))
         | F.exists("asset_ids", lambda x: ~local_identifier_valid(x)), "LOCAL_IDENTIFIER_INVALID"),
        (~timed, "AUTHORITY_TIMESTAMP_INVALID"),
        (timed & ~(F.col("effective_from") < F.col("valid_until")), "AUTHORITY_INTERVAL_INVALID"),
        (timed & (F.col("revocation_checked_at") > clock), "REVOCATION_CHECK_AFTER_AS_OF"),
        (timed & (F.col("basis.subject_id") != F.col("provider_id")), "SUBJECT_PROVIDER_MISMATCH"),
        (timed & approved & (F.col("revocation_status") != "current"), "APPROVED_NOT_CURRENT"),
        (timed & approved & (a("status") != "verified"), "APPROVED_NOT_VERIFIED"),
        (timed & approved & (a("approved_by") != F.col("basis.issuer_id")), "SIGNER_NOT_ISSUER"),
        (timed & approved & (bad_identity(a("approved_by")) | bad_identity(a("verified_by"))), "APPROVAL_IDENTITY_INVALID"),
        (timed & approved & (a("approved_at").isNull() | a("verified_at").isNull()), "APPROVAL_TIMESTAMP_INVALID"),
        (stamped & ((a("approved_at") < F.col("effective_from")) | (a("approved_at") > F.col("valid_until"))), "APPROVAL_OUTSIDE_INTERVAL"),
        (stamped & ((a("verified_at") < a("approved_at")) | (a("verified_at") > clock)), "VERIFICATION_TIME_INVALID"),
        (stamped & (F.col("revocation_checked_at") < a("verified_at")), "REVOCATION_PREDATES_VERIFICATION")]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))
    return df.select("authority_id", F.explode(codes).alias("code"))


def authority_release_decision(registry: DataFrame, as_of, max_age_seconds: int) -> DataFrame:
    """One row: is any approved, verified, current and fresh authority in force at ``as_of``?"""
    clock = at_instant(as_of)
    live = ((F.col("decision") == "approved") & (F.col("revocation_status") == "current")
            & (F.col("approval.status") == "verified") & (F.col("effective_from") <= clock)
            & (clock < F.col("valid_until")) & (F.col("revocation_checked_at") <= clock)
            & (seconds_between(clock, F.col("revocation_checked_at")) <= max_age_seconds))
    return registry.agg(F.when(F.coalesce(F.bool_or(live), F.lit(False)), "eligible-after-runtime-verification")
                        .otherwise("blocked-no-approved-authority").alias("release_decision"))


def verify_memberships(participants: DataFrame, decisions: DataFrame, now, registry: dict) -> DataFrame:
    """Participant approvals against trusted decisions: status, four bound fields, validity.

    ``registry`` holds the header: status, issued_at, valid_until, max_age_seconds.
    """
    clock = at_instant(now)
    issued, until = at_instant(registry["issued_at"]), at_instant(registry["valid_until"])
    fresh = ((issued <= clock) & (clock <= until)
             & (seconds_between(clock, issued) <= registry["max_age_seconds"]))
    d = _one_per_key(decisions, ["decision_id"], "_d_")
    bound = ["dataspace_id", "participant_id", "organization_id", "evidence_sha256"]
    same = F.lit(True)
    for c in bound:
        same = same & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    reason = _first(
        (F.lit(registry["status"] != "READY"), "EXTERNAL_APPROVAL_GATE_BLOCKED"),
        (~fresh, "APPROVAL_REGISTRY_STALE"),
        (F.col("_d_hit").isNull(), "APPROVAL_DECISION_NOT_TRUSTED"), (F.col("_d_hit") > 1, "APPROVAL_REGISTRY_DUPLICATE"),
        (F.col("_d_status") != "APPROVED", "APPROVAL_DECISION_NOT_APPROVED"),
        (~same, "APPROVAL_DECISION_MISMATCH"),
        ((F.col("_d_decided_at") > clock) | (F.col("_d_valid_until") < clock), "APPROVAL_DECISION_EXPIRED"))
    return participants.join(d, ["decision_id"], "left").select(*participants.columns, reason.alias("membership_reason"))


def service_status(spaces: DataFrame, services: DataFrame, now, registry: dict) -> DataFrame:
    """Status of each required service of each space: MISSING, DUPLICATE, STALE or the reported one."""
    clock = at_instant(now)
    issued, until = at_instant(registry["issued_at"]), at_instant(registry["valid_until"])
    limit = registry["max_age_seconds"]
    fresh = (issued <= clock) & (clock <= until) & (seconds_between(clock, issued) <= limit)
    seen = F.col("observed_at")
    current = fresh & (seen <= clock) & (seconds_between(clock, seen) <= limit) & (seen <= until)
    wanted = spaces.select("space_id", F.explode("required_service_ids").alias("service_id"))
    known = _one_per_key(services.select("service_id", "status", "observed_at"), ["service_id"], "_s_").select(
        "service_id", F.col("_s_hit").alias("_hit"), F.col("_s_status").alias("status"), F.col("_s_observed_at").alias("observed_at"))
    joined = wanted.join(known, "service_id", "left")
    return joined.withColumn("effective_status", F.when(F.col("_hit") > 1, "DUPLICATE").when(F.col("status").isNull(), "MISSING")
                             .when(F.coalesce(current, F.lit(False)), F.col("status")).otherwise("STALE")).drop("_hit")


def service_readiness(spaces: DataFrame, services: DataFrame, now, registry: dict) -> DataFrame:
    """Ready when every required service is READY; a space that needs none is ready."""
    status = service_status(spaces, services, now, registry).groupBy("space_id").agg(
        F.bool_and(F.col("effective_status") == "READY").alias("_all"),
        F.count_if(F.col("effective_status") == "MISSING").alias("missing"),
        F.count_if(F.col("effective_status") == "STALE").alias("stale"))
    return spaces.select("space_id").join(status, "space_id", "left").select(
        "space_id", F.coalesce("_all", F.lit(True)).alias("ready"),
        F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("stale", F.lit(0)).alias("stale"))


def resolve_bindings(requests: DataFrame, bindings: DataFrame, require_enabled: bool = True) -> DataFrame:
    """Binding of (dataset, format); without an enabled one, or with several, the request has no binding."""
    usable = bindings.where(F.col("enabled")) if require_enabled else bindings
    keyed = _one_per_key(usable.select("dataset_id", "format", "binding_id", "provisioner_id"), ["dataset_id", "format"], "_b_")
    single = lambda c: F.when(F.col("_b_hit") == 1, F.col(f"_b_{c}")).alias(c)
    joined = requests.join(keyed, ["dataset_id", "format"], "left")
    return joined.select(*requests.columns, single("binding_id"), single("provisioner_id"), F.when(
        F.col("_b_hit") > 1, "DUPLICATE_TRANSFER_BINDING").when(F.col("_b_binding_id").isNull(), "TRANSFER_BINDING_NOT_FOUND").alias("error"))


def orphans(deployed: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    return deployed.join(registered.select(*keys), keys, "left_anti")


def visible_rows(df: DataFrame, principals: DataFrame, ctx: dict) -> DataFrame:
    """Rows the calling role may see: its tenant while bound and active, or all under break-glass.

    ``ctx``: database_role, tenant_id, access_mode, actor_id, now, and for break-glass
    break_glass_reason and break_glass_expires_at.
    """
    now = at_instant(ctx["now"])
    active = principals.where(
        (F.col("database_role") == ctx["database_role"]) & (F.col("tenant_id") == ctx["tenant_id"])
        & (F.col("access_mode") == ctx["access_mode"]) & F.col("active")
        & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))
    if ctx["access_mode"] == "break-glass":
        expires = at_instant(ctx.get("break_glass_expires_at"))
        granted = (F.lit(len(ctx.get("actor_id") or "") >= 3 and len(ctx.get("break_glass_reason") or "") >= 8)
                   & F.coalesce(expires > now, F.lit(False)))
        gate = active.agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 0) & granted)
        # One gate row at most: a literal key joins it to every row without pairing rows.
        return (df.withColumn("_gate", F.lit(1))
                .join(gate.select(F.lit(1).alias("_gate")), "_gate", "left_semi").drop("_gate"))
    if ctx["access_mode"] not in ("tenant", "service"):
        return df.where(F.lit(False))
    return (df.where(F.col("tenant_id") == ctx["tenant_id"])
            .join(active.select("tenant_id"), "tenant_id", "left_semi"))


def revocation_status(tokens: DataFrame, registry: DataFrame, now, max_age_seconds: int) -> DataFrame:
    """VALID or REVOKED, or UNAVAILABLE / STALE when no trustworthy record exists."""
    clock = at_instant(now)
    keys = ["issuer", "subject", "token_id"]
    joined = tokens.join(registry.select(*keys, F.col("status").alias("_s"), F.col("observed_at").alias("_at")), keys, "left")
    fresh = ((F.col("_at") >= F.col("issued_at")) & (F.col("_at") <= clock)
             & (seconds_between(clock, F.col("_at")) <= max_age_seconds))
    status = (F.when(F.col("_s").isNull() | ~F.col("_s").isin("VALID", "REVOKED"), "UNAVAILABLE")
              .when(~F.coalesce(fresh, F.lit(False)), "STALE").otherwise(F.col("_s")))
    return joined.select(*tokens.columns, status.alias("revocation"))


def identifier_collisions(df: DataFrame, fields: list[str], owner: str) -> DataFrame:
    """Values of any of ``fields`` that more than one owner carries."""
    long = df.select(owner, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    return (long.select(owner, "x.field", "x.value").where(F.col("value").isNotNull())
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("owners"), F.min(owner).alias("first_owner"))
            .where(F.col("owners") > 1))


def release_eligibility(blockers: DataFrame, overrides: DataFrame, evidence: DataFrame,
                        extra: DataFrame | None = None) -> DataFrame:
    """Open blockers after status overrides and evidence failures; eligible when none is left.

    Adds effective_status and open per blocker. ``extra`` holds blockers found elsewhere.
    """
    base = blockers if extra is None else blockers.unionByName(extra)
    o = overrides.select("blocker_id", F.col("status").alias("_override"))
    e = evidence.groupBy("blocker_id").agg(F.bool_or(~F.col("passed")).alias("_failed"))
    joined = base.join(o, "blocker_id", "left").join(e, "blocker_id", "left")
    status = F.when(F.coalesce("_failed", F.lit(False)), "evidence-failed").otherwise(F.coalesce("_override", "status"))
    scope = F.coalesce("scope", F.lit("production"))
    return joined.select("blocker_id", scope.alias("scope"), status.alias("effective_status"),
                         (status != "closed").alias("open"))


def readiness(gates: DataFrame, expected: DataFrame, now, max_age_days: int) -> DataFrame:
    """Gate register: per blocker known, unique, and whether its evidence is bound and recent."""
    clock = at_instant(now)
    rows = gates.select("gate_id", F.explode("blocker_ids").alias("blocker_id"), "evidence_sha256",
                        "expected_sha256", "evidence_at")
    uses = rows.groupBy("blocker_id").agg(F.count(F.lit(1)).alias("_uses"))
    known = expected.select("blocker_id", F.lit(True).alias("_known"))
    state = _first(
        (F.col("_known").isNull(), "UNKNOWN_BLOCKER"), (F.col("_uses") > 1, "DUPLICATE_BLOCKER"),
        (F.col("evidence_sha256").isNull(), "EVIDENCE_MISSING"),
        (F.col("evidence_sha256") != F.col("expected_sha256"), "EVIDENCE_DIGEST_MISMATCH"),
        (F.col("evidence_at") > clock, "EVIDENCE_FROM_FUTURE"),
        (seconds_between(clock, F.col("evidence_at")) > max_age_days * 86400, "EVIDENCE_STALE"))
    return (rows.join(uses, "blocker_id").join(known, "blocker_id", "left")
            .select("gate_id", "blocker_id", state.alias("problem")))


def next_check(spaces: DataFrame, participants: DataFrame, services: DataFrame, approval_registry: dict,
               service_registry: dict) -> DataFrame:
    """Earliest instant at which a space must be looked at again; NULLs do not count."""
    ms = F.make_dt_interval(secs=F.lit(0.001).cast("decimal(18,6)"))
    plus_age = lambda at, reg: at + F.make_dt_interval(secs=F.lit(reg["max_age_seconds"])) + ms
    approved = (participants.where(F.col("approval_state") == "APPROVED").groupBy("space_id")
                .agg(F.min(F.col("decision_valid_until") + ms).alias("_decision"), F.lit(True).alias("_any")))
    needed = spaces.select("space_id", F.explode("required_service_ids").alias("service_id"))
    seen = (needed.join(services.select("service_id", "observed_at"), "service_id").groupBy("space_id")
            .agg(F.min(plus_age(F.col("observed_at"), service_registry)).alias("_service")))
    approval_at = F.when(F.col("_any"), F.least(
        at_instant(approval_registry["valid_until"]) + ms,
        plus_age(at_instant(approval_registry["issued_at"]), approval_registry), F.col("_decision")))
    service_at = F.least(at_instant(service_registry["valid_until"]) + ms,
                         plus_age(at_instant(service_registry["issued_at"]), service_registry), F.col("_service"))
    return (spaces.select("space_id").join(approved, "space_id", "left").join(seen, "space_id", "left")
            .select("space_id", F.least(approval_at, service_at).alias("next_check_at")))


def drift_targets(spaces: DataFrame, registry_digest: str, service_digest: str, current: DataFrame, now) -> DataFrame:
    """Spaces to reconcile: approvals from another registry version, service drift, no or due deadline."""
    clock = at_instant(now)
    joined = spaces.join(current.select("space_id", F.col("services_sha256").alias("_services")), "space_id", "left")
    flags = {
        "approval_refresh": (F.col("approved_count") > 0) & ~F.col("approval_registry_sha256").eqNullSafe(F.lit(registry_digest)),
        "service_change": ~F.col("service_registry_sha256").eqNullSafe(F.lit(service_digest))
        | ~F.col("services_sha256").eqNullSafe(F.col("_services")),
        "deadline_missing": F.col("next_check_at").isNull(),
        "deadline_due": F.coalesce(F.col("next_check_at") <= clock, F.lit(False))}
    out = joined.withColumns(flags).drop("_services")
    return out.where(F.col("approval_refresh") | F.col("service_change") | F.col("deadline_missing") | F.col("deadline_due"))


def backlog(spaces: DataFrame) -> DataFrame:
    """Spaces that fail (a retry is planned) or are blocked, with the blocking code."""
    state = F.when(F.col("next_retry_at").isNotNull(), "failing").when(F.col("reconcile_pending"), "blocked")
    blocked = F.exists("approval_states", lambda s: s == "REAPPROVAL_REQUIRED")
    waiting = F.exists("service_states", lambda s: s != "READY")
    code = F.when(blocked, "APPROVAL_BLOCKED").when(waiting, "REQUIRED_SERVICE_BLOCKED").otherwise("RECONCILIATION_BLOCKED")
    return (spaces.withColumn("state", state).where(F.col("state").isNotNull())
            .withColumn("error_code", F.when(F.col("state") == "blocked", code)))
