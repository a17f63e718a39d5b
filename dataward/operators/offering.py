"""Catalogue records: validation, normal form, offering and visibility decisions, projections.

A record frame has source_system_id, record_id, resource_version and a ``record`` struct
(see ``RECORD_SCHEMA``). Decisions are plain expressions over that struct, so whole tables are
decided in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.functions.canonical import at_instant, digest
from dataward.functions.lexical import VERSION, identifier_valid, rfc3339_valid
from dataward.functions.lineage import stored
from dataward.functions.sensitive import EVENT_SECRETS, matches_any
from dataward.functions.unicode import stable_unicode
from dataward.operators.registries import VERIFIED

RECORD_SCHEMA = """struct<record_type: string, title: string, description: string,
 publisher: struct<id: string, name: string>, landing_page: string, issued_at: string, modified_at: string,
 keywords: array<string>, themes: array<string>, evidence_ids: array<string>,
 access_rights: string, license: string, rights: string, origin_data_holder_id: string,
 provider_participant_id: string, connector_operator_id: string, delivery_operator_id: string,
 contracting_party_id: string, platform_record_role: struct<value: string, evidence_ids: array<string>>,
 provider_authority: struct<kind: string, evidence_ids: array<string>>, transfer_decision: string, policy_ref: string,
 distributions: array<struct<id: string, access_profile: string, format: string, transfer_format: string,
 media_type: string, source_binding_ref: string, lifecycle_mode: string, revocation_mode: string, evidence_ids: array<string>>>>"""

# Vocabularies and grammars of records.
RECORD_TYPES = ("dataset", "organization", "system", "use-case", "post")
PLATFORM_ROLES = ("hosted", "brokered", "index-only", "unknown")
ACCESS_RIGHTS = ("open", "registered", "restricted", "secure", "excluded", "unknown")
TRANSFER_DECISIONS = ("approved", "conditional", "pending", "denied")
AUTHORITY_KINDS = ("owner", "delegate", "agent")
LIFECYCLE_MODES = ("none", "manual", "token", "entitlement", "subscription", "job")
EVENT_TYPES = ("record.upsert", "record.deleted")
URL_SECRET_PARAMETERS = ("apikey", "accesstoken", "authorization", "clientsecret", "credential", "key", "password",
                         "refreshtoken", "session", "signature", "token")
_SEGMENT = "[A-Za-z0-9][A-Za-z0-9._~-]*"
BINDING_REF = rf"^binding://{_SEGMENT}(?:/{_SEGMENT})+$"
POLICY_REF = rf"^policy:{_SEGMENT}(?::{_SEGMENT})*$"
TRANSFER_REF = rf"^transfer:{_SEGMENT}(?::{_SEGMENT})*$"
URN_REF = rf"^urn:{_SEGMENT}(?::{_SEGMENT})+$"
MAX_TEXT = 8192
MAX_ITEMS = 200


@dataclass(frozen=True)
class ProjectionConfig:
    identifier_namespace: str
    service_id: str
    connector_endpoint: str
    discovery_namespace: str = "urn:example:discovery"
    dsp_version: str = "2025-1"
    public_host_suffix: str = ".invalid"

    def digest(self) -> str:
        import hashlib
        import json
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# --- change events ---------------------------------------------------------------------------

def validate_events(ev: DataFrame, skew_seconds: int = 300) -> DataFrame:
    """Add ``errors``: the codes of the rules a change event breaks, in rule order.

    observed_at and occurred_at are text. Repeated event ids are counted per batch and id, and only these are stored
    and joined: while they are few, no record is shuffled for them. Events without a batch or an id are left out.
    """
    copies = ev.groupBy("batch_id", "event_id").agg(F.count(F.lit(1)).alias("_copies"))
    repeated = stored(copies.where("_copies > 1 and batch_id is not null and event_id is not null"))
    ids = F.concat_ws("\n", "event_id", "record_id", "source_system_id", "batch_id")
    bad_id = ~(identifier_valid(F.col("event_id")) & identifier_valid(F.col("record_id"))
               & identifier_valid(F.col("source_system_id")) & identifier_valid(F.col("batch_id")))
    occurred, observed = F.try_to_timestamp("occurred_at"), F.try_to_timestamp("observed_at")
    payload = F.col("record").isNotNull()
    upsert = F.col("event_type") == "record.upsert"
    # A payload is scanned as its JSON text; JSON escapes none of the characters the patterns use.
    secret = matches_any(F.to_json("record"), EVENT_SECRETS)
    rules = [
        (~F.coalesce(F.col("mode").isin("baseline", "delta"), F.lit(False)), "INVALID_BATCH_MODE"),
        (bad_id | ~F.col("_stable"), "INVALID_IDENTIFIER"),
        (matches_any(ids, EVENT_SECRETS), "CREDENTIAL_LIKE_IDENTIFIER"),
        (~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "INVALID_EVENT_TYPE"),
        (~F.coalesce(F.col("resource_version").rlike(VERSION), F.lit(False)), "INVALID_RESOURCE_VERSION"),
        (~(rfc3339_valid(F.col("occurred_at")) & rfc3339_valid(F.col("observed_at"))), "INVALID_TIMESTAMP"),
        ((upsert & ~payload) | ((F.col("event_type") == "record.deleted") & payload), "INVALID_EVENT"),
        (upsert & F.coalesce(secret, F.lit(False)), "INLINE_SECRET_VALUE"),
        (F.timestamp_diff("MICROSECOND", observed, occurred) > skew_seconds * 1_000_000, "SOURCE_EVENT_TIME_AHEAD"),
        (F.col("_copies") > 1, "DUPLICATE_EVENT_IN_BATCH")]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    known = ev.where(F.col("batch_id").isNotNull() & F.col("event_id").isNotNull())
    return (known.join(repeated, ["batch_id", "event_id"], "left").withColumn("_stable", stable_unicode(ids))
            .withColumn("errors", errors).drop("_copies", "_stable"))


# --- normal form -----------------------------------------------------------------------------

def url_error(col: Column, suffix: str | None) -> Column:
    """First broken rule of a public URL: syntax, https, parameters, query or fragment, host."""
    names = "|".join(sorted(URL_SECRET_PARAMETERS))
    query = F.lower(F.regexp_replace(F.regexp_extract(col, r"\?([^#]*)", 1), "[-_]", ""))
    host = F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    out = F.lit(None).cast("string")
    if suffix is not None:
        out = F.when(~host.endswith(suffix), "NON_SYNTHETIC_PUBLIC_URL")
    out = F.when(col.rlike(r"[?#]."), "PUBLIC_URL_COMPONENT_FORBIDDEN").otherwise(out)
    out = F.when(query.rlike(rf"(?:^|&)(?:{names})(?:=|&|$)"), "SECRET_URL_PARAMETER").otherwise(out)
    out = F.when(~F.lower(col).startswith("https://") | col.rlike(r"^[^/]*//[^/?#]*@"), "INSECURE_URL").otherwise(out)
    return F.when(~col.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), "INVALID_URL").otherwise(out)


def _text_error(col: Column) -> Column:
    return F.when(col.isNull() | (F.trim(col) == "") | (F.length(col) > MAX_TEXT), "INVALID_FIELD")


def _id_error(col: Column) -> Column:
    return (F.when(~identifier_valid(col), "INVALID_IDENTIFIER")
            .when(matches_any(col, EVENT_SECRETS), "CREDENTIAL_LIKE_IDENTIFIER"))


def _reference_error(col: Column, *grammars: str) -> Column:
    ok = F.lit(False)
    for g in grammars:
        ok = ok | col.rlike(g)
    return F.when((F.length(col) > 512) | ~ok, "INVALID_REFERENCE")


def _iri_error(col: Column, suffix: str) -> Column:
    return F.when(col.startswith("urn:"), _reference_error(col, URN_REF)).otherwise(url_error(F.trim(col), suffix))


def _ids_error(col: Column) -> Column:
    return (F.when(F.size(col) > MAX_ITEMS, "COLLECTION_TOO_LARGE")
            .when(F.exists(col, lambda x: _id_error(x).isNotNull()), "INVALID_IDENTIFIER"))


def _stamp_error(col: Column) -> Column:
    return F.when(~rfc3339_valid(col), "INVALID_TIMESTAMP")


def _optional(error, col: Column) -> Column:
    return F.when(col.isNotNull(), error)


def _empty() -> Column:
    return F.array().cast("array<string>")


def normalize_records(df: DataFrame, cfg: ProjectionConfig) -> DataFrame:
    """Normal form of ``record`` plus ``errors``, the (code, field) pairs of broken rules in order.

    Text is trimmed, arrays lose repeats, unknown access and open decisions get their defaults. A
    row with errors is for quarantine; others are unaffected.
    """
    r = lambda n: F.col(f"record.{n}")
    dataset = r("record_type") == "dataset"
    d = r("distributions")
    suffix = cfg.public_host_suffix
    checks = [
        ("recordType", F.when(~F.coalesce(r("record_type").isin(*RECORD_TYPES), F.lit(False)), "INVALID_RECORD_TYPE")),
        ("record.title", _text_error(r("title"))), ("record.description", _text_error(r("description"))),
        ("record.publisher.id", F.coalesce(_text_error(r("publisher.id")), _iri_error(r("publisher.id"), suffix))),
        ("record.publisher.name", _text_error(r("publisher.name"))),
        ("record.landingPage", F.coalesce(_text_error(r("landing_page")), url_error(F.trim(r("landing_page")), suffix))),
        ("record.issuedAt", _stamp_error(r("issued_at"))), ("record.modifiedAt", _stamp_error(r("modified_at"))),
        ("record.keywords", F.when(F.exists(r("keywords"), lambda x: _text_error(x).isNotNull()), "INVALID_FIELD")),
        ("record.themes", F.when(F.exists(r("themes"), lambda x: _iri_error(x, suffix).isNotNull()), "INVALID_REFERENCE")),
        ("record.evidenceIds", _ids_error(r("evidence_ids"))),
    ]
    only_dataset = [
        ("record.accessRights", F.when(~F.coalesce(r("access_rights"), F.lit("unknown")).isin(*ACCESS_RIGHTS), "INVALID_ACCESS_RIGHTS")),
        ("record.transferDecision", F.when(~F.coalesce(r("transfer_decision"), F.lit("pending")).isin(*TRANSFER_DECISIONS), "INVALID_TRANSFER_DECISION")),
        ("distributions.lifecycleMode", F.when(F.exists(d, lambda x: x["lifecycle_mode"].isNotNull() & ~x["lifecycle_mode"].isin(*LIFECYCLE_MODES)), "INVALID_LIFECYCLE_MODE")),
        ("distributions.id", F.when(F.exists(d, lambda x: _id_error(x["id"]).isNotNull()), "INVALID_IDENTIFIER")),
        ("distributions.format", F.when(F.exists(d, lambda x: _text_error(x["access_profile"]).isNotNull() | _text_error(x["format"]).isNotNull()), "INVALID_FIELD")),
        ("distributions.transferFormat", F.when(F.exists(d, lambda x: x["transfer_format"].isNotNull() & _reference_error(x["transfer_format"], TRANSFER_REF, URN_REF).isNotNull()), "INVALID_REFERENCE")),
        ("distributions.mediaType", F.when(F.exists(d, lambda x: F.coalesce(
            url_error(x["media_type"], None).isNotNull() | ~x["media_type"].rlike(r"(?i)^https://www\.iana\.org(?-i)/assignments/media-types/"), F.lit(True))), "INVALID_MEDIA_TYPE_IRI")),
        ("distributions.sourceBindingRef", F.when(F.exists(d, lambda x: x["source_binding_ref"].isNotNull() & _reference_error(x["source_binding_ref"], BINDING_REF, URN_REF).isNotNull()), "INVALID_REFERENCE")),
        ("distributions", F.when(F.size(F.array_distinct(F.transform(d, lambda x: x["id"]))) < F.size(d), "DUPLICATE_DISTRIBUTION")),
        ("record.originDataHolderId", _optional(_id_error(r("origin_data_holder_id")), r("origin_data_holder_id"))),
        ("platformRecordRole", F.when(r("platform_record_role").isNotNull() & ~F.coalesce(r("platform_record_role.value").isin(*PLATFORM_ROLES), F.lit(False)), "INVALID_PLATFORM_ROLE")),
        ("platformRecordRole.evidenceIds", _ids_error(r("platform_record_role.evidence_ids"))),
        ("record.license", _optional(url_error(F.trim(r("license")), suffix), r("license"))),
        ("record.providerParticipantId", _optional(_id_error(r("provider_participant_id")), r("provider_participant_id"))),
        ("record.connectorOperatorId", _optional(_id_error(r("connector_operator_id")), r("connector_operator_id"))),
        ("record.deliveryOperatorId", _optional(_id_error(r("delivery_operator_id")), r("delivery_operator_id"))),
        ("record.contractingPartyId", _optional(_id_error(r("contracting_party_id")), r("contracting_party_id"))),
        ("providerAuthority", F.when(r("provider_authority").isNotNull() & ~F.coalesce(r("provider_authority.kind").isin(*AUTHORITY_KINDS), F.lit(False)), "INVALID_AUTHORITY")),
        ("record.policyRef", _optional(_reference_error(r("policy_ref"), POLICY_REF, URN_REF), r("policy_ref"))),
    ]
    pairs = [(f, c) for f, c in checks] + [(f, F.when(dataset, c)) for f, c in only_dataset]
    marks = F.array(*[F.struct(c.alias("code"), F.lit(f).alias("field")) for f, c in pairs])
    errors = F.filter(marks, lambda e: e["code"].isNotNull())
    tidy = lambda c: F.array_distinct(F.transform(F.coalesce(c, _empty()), lambda x: F.trim(x)))
    when_dataset = lambda c: F.when(dataset, c)
    dist = F.transform(F.coalesce(d, F.array().cast(_distribution_type())), lambda x: F.struct(
        x["id"].alias("id"), F.trim(x["access_profile"]).alias("access_profile"), F.trim(x["format"]).alias("format"),
        F.trim(x["transfer_format"]).alias("transfer_format"), F.trim(x["media_type"]).alias("media_type"),
        F.trim(x["source_binding_ref"]).alias("source_binding_ref"), x["lifecycle_mode"].alias("lifecycle_mode"),
        F.trim(x["revocation_mode"]).alias("revocation_mode"), tidy(x["evidence_ids"]).alias("evidence_ids")))
    role = F.coalesce(r("platform_record_role"), F.struct(F.lit("unknown").alias("value"), _empty().alias("evidence_ids")))
    canonical = F.struct(
        r("record_type").alias("record_type"), F.trim(r("title")).alias("title"), F.trim(r("description")).alias("description"),
        F.struct(F.trim(r("publisher.id")).alias("id"), F.trim(r("publisher.name")).alias("name")).alias("publisher"),
        F.trim(r("landing_page")).alias("landing_page"), r("issued_at").alias("issued_at"), r("modified_at").alias("modified_at"),
        tidy(r("keywords")).alias("keywords"), tidy(r("themes")).alias("themes"), tidy(r("evidence_ids")).alias("evidence_ids"),
        when_dataset(F.coalesce(r("access_rights"), F.lit("unknown"))).alias("access_rights"), when_dataset(F.trim(r("license"))).alias("license"),
        when_dataset(F.trim(r("rights"))).alias("rights"), when_dataset(r("origin_data_holder_id")).alias("origin_data_holder_id"),
        when_dataset(r("provider_participant_id")).alias("provider_participant_id"), when_dataset(r("connector_operator_id")).alias("connector_operator_id"),
        when_dataset(r("delivery_operator_id")).alias("delivery_operator_id"), when_dataset(r("contracting_party_id")).alias("contracting_party_id"),
        when_dataset(F.struct(role["value"].alias("value"), tidy(role["evidence_ids"]).alias("evidence_ids"))).alias("platform_record_role"),
        when_dataset(r("provider_authority")).alias("provider_authority"), when_dataset(F.coalesce(r("transfer_decision"), F.lit("pending"))).alias("transfer_decision"),
        when_dataset(F.trim(r("policy_ref"))).alias("policy_ref"), when_dataset(dist).alias("distributions"))
    return once(df, {"record_errors": errors, "canonical": canonical})


def _distribution_type() -> str:
    return ("array<struct<id:string,access_profile:string,format:string,transfer_format:string,media_type:string,"
            "source_binding_ref:string,lifecycle_mode:string,revocation_mode:string,evidence_ids:array<string>>>")


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows); a quarantine row keeps the reason and no payload."""
    bad = F.size("record_errors") > 0
    kept = [c for c in df.columns if c not in ("record", "canonical", "record_errors")]
    quarantined = df.where(bad).select(*kept, F.col("record_errors")[0]["code"].alias("error_code"),
                                       F.col("record_errors")[0]["field"].alias("error_field"))
    return df.where(~bad).drop("record_errors"), quarantined


# --- decisions -------------------------------------------------------------------------------

def _reason(condition: Column, code: str, field) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), field.alias("field")))


def _distribution_reasons(d: Column) -> Column:
    """Per distribution its missing parts in order; a transfer format used earlier is ambiguous."""
    formats = F.transform(d, lambda x: x["transfer_format"])

    def one(x: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("distributions."), x["id"], F.lit("." + name))
        managed = x["lifecycle_mode"].isNotNull() & (x["lifecycle_mode"] != "none") & x["revocation_mode"].isNull()
        return F.array_compact(F.array(
            _reason(x["transfer_format"].isNull(), "MISSING_TRANSFER_FORMAT", at("transferFormat")),
            _reason(F.array_contains(F.slice(formats, F.lit(1), i), x["transfer_format"]), "AMBIGUOUS_TRANSFER_FORMAT", at("transferFormat")),
            _reason(x["source_binding_ref"].isNull(), "MISSING_SOURCE_BINDING", at("sourceBindingRef")),
            _reason(F.size(x["evidence_ids"]) == 0, "MISSING_DISTRIBUTION_EVIDENCE", at("evidenceIds")),
            _reason(x["lifecycle_mode"].isNull(), "MISSING_LIFECYCLE_MODE", at("lifecycleMode")),
            _reason(managed, "MISSING_REVOCATION", at("revocationMode"))))
    return F.flatten(F.transform(d, one))


def decide_offering(df: DataFrame) -> DataFrame:
    """Add decision_state and decision_reasons. Needs ``canonical`` and the approval columns."""
    c = lambda n: F.col(f"canonical.{n}")
    role, access = c("platform_record_role.value"), c("access_rights")
    blank = lambda col: F.coalesce(col, F.lit("")) == ""
    general = [
        _reason(F.col("approval_status") != VERIFIED, "GOVERNANCE_APPROVAL_MISSING", "governanceApproval"),
        _reason((F.col("approval_status") == VERIFIED) & (F.col("offering_decision") != "approved"),
                "GOVERNANCE_OFFERING_NOT_APPROVED", "governanceApproval.offeringDecision"),
        _reason(F.col("catalog_visibility") != "public", "CATALOG_NOT_PUBLIC", "catalogVisibility"),
        _reason(access == "unknown", "ACCESS_RIGHTS_UNKNOWN", "accessRights"),
        _reason(access.isin("registered", "restricted", "secure"), "ACCESS_PROFILE_UNIMPLEMENTED", "accessRights"),
        _reason(role == "unknown", "ROLE_UNKNOWN", "platformRecordRole"),
        _reason(role.isin("hosted", "brokered") & (F.size(c("platform_record_role.evidence_ids")) == 0),
                "MISSING_ROLE_EVIDENCE", "platformRecordRole.evidenceIds"),
        _reason(blank(c("origin_data_holder_id")), "MISSING_DATA_HOLDER", "originDataHolderId"),
        _reason(blank(c("provider_participant_id")), "MISSING_PROVIDER_PARTICIPANT", "providerParticipantId"),
        _reason(blank(c("connector_operator_id")) | blank(c("delivery_operator_id")) | blank(c("contracting_party_id")),
                "MISSING_OPERATING_ROLE", "connectorOperatorId|deliveryOperatorId|contractingPartyId"),
        _reason(c("provider_authority").isNull() | (F.coalesce(F.size(c("provider_authority.evidence_ids")), F.lit(0)) <= 0),
                "MISSING_PROVIDER_AUTHORITY", "providerAuthority"),
        _reason(blank(c("license")) & blank(c("rights")), "MISSING_RIGHTS", "license|rights"),
        _reason(blank(c("policy_ref")), "MISSING_POLICY", "policyRef"),
        _reason(c("transfer_decision") != "approved", "TRANSFER_NOT_APPROVED", "transferDecision"),
        _reason(F.size(c("distributions")) == 0, "MISSING_DISTRIBUTION", "distributions")]
    alone = lambda code, field: F.array(F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    full = F.concat(F.array_compact(F.array(*general)), _distribution_reasons(c("distributions")))
    reasons = (F.when(c("record_type") != "dataset", alone("NOT_DATASET", "recordType"))
               .when(access == "excluded", alone("ACCESS_EXCLUDED", "accessRights"))
               .when(role == "index-only", alone("INDEX_ONLY", "platformRecordRole")).otherwise(full))
    state = (F.when((c("record_type") != "dataset"), "CATALOG_ONLY").when(access == "excluded", "QUARANTINED")
             .when(role == "index-only", "CATALOG_ONLY").when(F.size("decision_reasons") > 0, "PENDING_EVIDENCE").otherwise("APPROVED"))
    return once(df, {"decision_reasons": reasons}).withColumn("decision_state", state)


def decide_visibility(df: DataFrame) -> DataFrame:
    """Add publish, discovery_reason and visibility."""
    rules = [
        (F.col("decision_state") == "QUARANTINED", "RECORD_QUARANTINED"),
        (F.col("approval_status") != VERIFIED, "DISCOVERY_APPROVAL_MISSING"),
        (F.col("catalog_visibility") != "public", "DISCOVERY_NOT_PUBLIC"),
        ((F.col("canonical.record_type") == "dataset") & (F.col("canonical.access_rights") != "open"), "S1_NON_OPEN_DISCOVERY_BLOCKED")]
    reason = F.lit("SYNTHETIC_PUBLIC_APPROVAL")
    for condition, code in reversed(rules):
        reason = F.when(condition, code).otherwise(reason)
    return df.withColumn("discovery_reason", reason).withColumns({
        "publish": F.col("discovery_reason") == "SYNTHETIC_PUBLIC_APPROVAL",
        "visibility": F.when(F.col("discovery_reason") == "SYNTHETIC_PUBLIC_APPROVAL", "public")
        .when(F.col("discovery_reason") == "DISCOVERY_NOT_PUBLIC", F.col("catalog_visibility")).otherwise("internal")})


# --- projections -----------------------------------------------------------------------------

def _urn(namespace: str, kind: str, *parts: Column) -> Column:
    """URN with percent-encoded parts; blanks encode as %20, as in URI components."""
    encoded = [F.regexp_replace(F.url_encode(p), r"\+", "%20") for p in parts]
    return F.concat_ws(":", F.lit(f"{namespace}:{kind}"), *encoded)


def dataset_urn(cfg: ProjectionConfig) -> Column:
    return _urn(cfg.identifier_namespace, "dataset", F.col("source_system_id"), F.col("record_id"))


def project_public(df: DataFrame, cfg: ProjectionConfig) -> DataFrame:
    """Add ``projection``, the allow-listed public form of records that may be published."""
    c = lambda n: F.col(f"canonical.{n}")
    evidence = F.array_union(c("evidence_ids"), F.coalesce(c("platform_record_role.evidence_ids"), _empty()))
    urn = F.concat_ws(":", F.lit(cfg.discovery_namespace), *[
        F.regexp_replace(F.url_encode(p), r"\+", "%20") for p in ("source_system_id", "record_id")])
    body = F.struct(
        c("access_rights").alias("accessRights"), F.lit(False).alias("automaticDispatchAllowed"), F.col("catalog_visibility").alias("catalogVisibility"),
        F.col("decision_reasons").alias("decisionReasons"), c("description").alias("description"), evidence.alias("evidenceIds"), urn.alias("id"),
        c("issued_at").alias("issuedAt"), c("keywords").alias("keywords"), c("landing_page").alias("landingPage"), c("modified_at").alias("modifiedAt"),
        F.col("decision_state").alias("offeringState"), c("platform_record_role.value").alias("platformRecordRole"), c("publisher").alias("publisher"),
        c("record_type").alias("recordType"), F.struct(F.col("record_id").alias("recordId"), F.col("source_system_id").alias("systemId")).alias("source"),
        F.lit(True).alias("syntheticOnly"), c("themes").alias("themes"), c("title").alias("title"))
    return once(df, {"projection": F.when(F.col("publish"), F.to_json(body))})


def project_candidate(df: DataFrame, cfg: ProjectionConfig) -> DataFrame:
    """Add candidate_id, ``candidate_nodes`` (dataset, distributions, service) and private ``bindings``
    for approved records; NULL for others."""
    c = lambda n: F.col(f"canonical.{n}")
    ns = cfg.identifier_namespace
    dist_urn = lambda x: _urn(ns, "distribution", F.col("source_system_id"), F.col("record_id"), x["id"])
    service = _urn(ns, "service", c("provider_participant_id"), F.lit(cfg.service_id))
    prop = lambda name, value: F.struct(F.lit(name).alias("property"), value.alias("value"))
    node = lambda urn, kind, props: F.struct(urn.alias("node"), F.lit(kind).alias("kind"), props.alias("properties"))
    literal = [("dct:identifier", F.col("record_id")), ("dct:title", c("title")), ("dct:description", c("description")),
               ("dct:publisher", c("publisher.id")), ("dct:issued", c("issued_at")), ("dct:modified", c("modified_at")),
               ("dct:accessRights", c("access_rights")), ("dct:license", c("license")), ("dct:rights", c("rights")),
               ("dcat:landingPage", c("landing_page"))]
    props = F.filter(F.concat(
        F.array(*[prop(n, v) for n, v in literal]),
        F.transform(c("keywords"), lambda k: prop("dcat:keyword", k)), F.transform(c("themes"), lambda t: prop("dcat:theme", t)),
        F.transform(c("distributions"), lambda x: prop("dcat:distribution", dist_urn(x)))), lambda p: p["value"].isNotNull())
    distributions = F.transform(c("distributions"), lambda x: node(dist_urn(x), "dcat:Distribution", F.array(
        prop("dct:format", x["format"]), prop("dcat:mediaType", x["media_type"]), prop("dcat:accessService", service))))
    nodes = F.concat(F.array(node(dataset_urn(cfg), "dcat:Dataset", props)), distributions,
                     F.array(node(service, "dcat:DataService", F.array(prop("dcat:endpointURL", F.lit(cfg.connector_endpoint))))))
    bindings = F.transform(c("distributions"), lambda x: F.struct(
        dist_urn(x).alias("distribution_id"), x["format"].alias("format"), x["transfer_format"].alias("transfer_format"),
        x["source_binding_ref"].alias("source_binding_ref"), x["lifecycle_mode"].alias("lifecycle_mode")))
    ok = F.col("decision_state") == "APPROVED"
    return once(df, {"candidate_id": F.when(ok, dataset_urn(cfg)), "candidate_nodes": F.when(ok, nodes), "bindings": F.when(ok, bindings)})


def candidate_nodes(df: DataFrame) -> DataFrame:
    """Node table of the candidates: one row per node and property."""
    nodes = df.where(F.col("candidate_nodes").isNotNull()).select("candidate_id", F.explode("candidate_nodes").alias("n"))
    return nodes.select("candidate_id", "n.node", "n.kind", F.explode("n.properties").alias("p")).select(
        "candidate_id", "node", "kind", "p.property", "p.value")


def leak_check(df: DataFrame) -> DataFrame:
    """Add ``leaked``: does any public string of a candidate contain one of its private bindings?"""
    public = F.flatten(F.transform("candidate_nodes", lambda n: F.concat(F.array(n["node"]), F.transform(n["properties"], lambda p: p["value"]))))
    private = F.filter(F.transform("bindings", lambda b: b["source_binding_ref"]), lambda b: b.isNotNull())
    return df.withColumn("leaked", F.exists(private, lambda b: F.exists(public, lambda s: F.contains(s, b))))


def decide(df: DataFrame, approvals: DataFrame, cfg: ProjectionConfig, now) -> DataFrame:
    """The whole decision for records: approval, normal form, decisions, projection digests."""
    from dataward.operators.registries import resolve_approvals
    sized = df if "record_digest" in df.columns else df.withColumn("record_digest", digest({"record": F.col("record")}))
    out = decide_visibility(decide_offering(normalize_records(resolve_approvals(sized, approvals, at_instant(now)), cfg)))
    out = project_candidate(project_public(out, cfg), cfg)
    broken = F.size("record_errors") > 0
    out = out.withColumns({
        "decision_state": F.when(broken, "QUARANTINED").otherwise(F.col("decision_state")),
        "discovery_reason": F.when(broken, "RECORD_QUARANTINED").otherwise(F.col("discovery_reason")),
        **{c: F.when(~broken, F.col(c)) for c in ("projection", "candidate_id", "candidate_nodes", "bindings")}})
    return out.withColumns({
        "projection_digest": F.sha2("projection", 256),
        "candidate_digest": F.when(F.col("candidate_id").isNotNull(), F.sha2(F.to_json(F.struct("bindings", "candidate_nodes")), 256))})


# --- draft gaps ------------------------------------------------------------------------------

def assess_gaps(nodes: DataFrame, required_kinds: list[str], profile_marker: str, language_properties: list[str]) -> DataFrame:
    """Gaps of draft graphs: missing node kinds, missing profile marker, untagged text, dangling agents.

    ``nodes``: graph, node, kind, property, value, value_kind, lang.
    """
    flags = nodes.groupBy("graph").agg(
        *[F.bool_or(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"_k{i}") for i, k in enumerate(required_kinds)],
        F.bool_or(F.coalesce((F.col("property") == "dct:conformsTo") & (F.col("value") == profile_marker), F.lit(False))).alias("_marked"))
    codes = F.array_compact(F.array(
        *[F.when(~F.col(f"_k{i}"), F.lit(f"MISSING_NODE:{k}")) for i, k in enumerate(required_kinds)],
        F.when(~F.col("_marked"), F.lit("MISSING_PROFILE_MARKER"))))
    whole = flags.select("graph", F.lit(None).cast("string").alias("node"), F.explode(codes).alias("code"))
    untagged = nodes.where(F.col("property").isin(language_properties) & (F.col("value_kind") == "literal") & F.col("lang").isNull()).select(
        "graph", "node", F.lit("UNTAGGED_LITERAL").alias("code")).distinct()
    agents = nodes.where(F.col("kind") == "foaf:Agent").select("graph", F.col("node").alias("value"))
    dangling = nodes.where(F.col("property") == "dct:publisher").join(agents, ["graph", "value"], "left_anti").select(
        "graph", "node", F.lit("MISSING_AGENT").alias("code")).distinct()
    return whole.unionByName(untagged).unionByName(dangling)


def project_by_paths(df: DataFrame, json_col: str, mapping: dict[str, str]) -> DataFrame:
    """Fields picked from a JSON document by path, as configured."""
    return df.withColumns({name: F.get_json_object(json_col, path) for name, path in mapping.items()})
