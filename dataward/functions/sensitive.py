"""Secrets and personal data: value patterns, forbidden keys, nested scans, resource references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.functions.unicode import folded

# Secret patterns of change events, secret and personal patterns of public graphs.
EVENT_SECRETS = (
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\bSECRET_DO_NOT_LEAK\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)\b(?:password|client[_-]?secret|api[_-]?key|access[_-]?token)\s*[:=]\s*\S{4,}",
)
GRAPH_SECRETS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i)authorization\s*:\s*bearer\s+[A-Za-z0-9._~+/=-]+",
    r"(?<![0-9A-Z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])",
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b",
    r"(?i)\b(?:binding|secret|vault)://",
    r"(?i)\bjdbc:[a-z0-9]+:",
)
_LABEL = r"[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
PERSONAL = (
    r"\b\d{6}[- ]?[1-8]\d{6}\b",
    r"(?:\+82\s*(?:\(\s*0\s*\)\s*)?1[016789]|01[016789])[-. ]?\d{3,4}[-. ]?\d{4}\b",
    r"(?:\+82[-. ]*(?:\(\s*0\s*\)[-. ]*)?(?:2|[3-6][1-5]|70))[-. ]?\d{3,4}[-. ]?\d{4}\b",
    r"\b0(?:2|[3-6][1-5]|70)[-. ]?\d{3,4}[-. ]?\d{4}\b",
    r"\b0\d{1,2}[-. ]\d{3,4}[-. ]\d{4}\b",
    rf"(?i)\b[A-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{_LABEL}(?:[.]{_LABEL})+\b",
    rf"(?i)[^\s<>@]+@{_LABEL}(?:[.]{_LABEL})+\b",
)
FORBIDDEN_KEYS = ("password", "passwd", "cookie", "cookies", "csrf", "csrftoken", "session", "sessionid",
                  "authorization", "apikey", "accesstoken", "refreshtoken", "secret", "secretvalue", "clientsecret")
# Credential names and assignments in resource references.
CREDENTIAL_KEY = (r"(?i)(?:authorization|credential|api[-_]?key|access[-_]?token|refresh[-_]?token|token|secret"
                  r"|password|passwd|cookie|private[-_]?key|signed[-_]?url|signature)")
CREDENTIAL_QUERY_NAMES = (
    "authorization", "proxyauthorization", "credential", "apikey", "accesstoken", "refreshtoken", "token", "secret",
    "password", "passwd", "cookie", "setcookie", "privatekey", "signature", "sig", "xamzcredential", "xamzsignature",
    "xamzsecuritytoken", "xgoogcredential", "xgoogsignature", "googleaccessid", "awsaccesskeyid", "clientsecret",
    "sharedaccesssignature", "subscriptionkey", "code", "key")
CREDENTIAL_QUERY_SUFFIX = (r"(?:authorization|credential|signature|accesskey|apikey|privatekey|subscriptionkey|token|secret"
                           r"|password|passwd|cookie)$")
CREDENTIAL_VALUES = (
    r"(?i)^(?:bearer|basic|digest|sharedaccesssignature)\s+\S+",
    r"(?i)(?:^|[?&#;,\s])(?:authorization|proxy[-_]?authorization|credential|api[-_]?key|access[-_]?token"
    r"|refresh[-_]?token|token|secret|password|passwd|cookie|set[-_]?cookie|private[-_]?key|signature|sig"
    r"|x[-_]?amz[-_]?credential|x[-_]?amz[-_]?signature)\s*[:=]\s*[^&#;,\s]+",
)


def matches_any(col: Column, patterns) -> Column:
    """Whether any pattern occurs; one alternation, so a text is walked by one matcher."""
    scoped = [f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns]
    return col.rlike("|".join(scoped))


def has_personal(col: Column) -> Column:
    """Personal data in a folded text. Each pattern needs an @ or three digits, which are cheap to test."""
    mail, numbers = [p for p in PERSONAL if "@" in p], [p for p in PERSONAL if "@" not in p]
    return (F.contains(col, F.lit("@")) & matches_any(col, mail)) | (col.rlike(r"\d{3}") & matches_any(col, numbers))


def sensitive_folded(col: Column) -> Column:
    return F.coalesce(matches_any(col, GRAPH_SECRETS) | has_personal(col), F.lit(False))


def sensitive_text(col: Column) -> Column:
    """Whether a text holds a secret or personal data, after compatibility folding of the whole text."""
    return sensitive_folded(folded(col))


def sensitive_kinds(df: DataFrame, text_col: str) -> DataFrame:
    """Add has_secret and has_personal for a text column; the text is folded once."""
    ready = once(df, {"_folded": folded(F.col(text_col))})
    return once(ready, {"has_secret": F.coalesce(matches_any(F.col("_folded"), GRAPH_SECRETS), F.lit(False)),
                        "has_personal": F.coalesce(has_personal(F.col("_folded")), F.lit(False))}).drop("_folded")


def scan_nested_secrets(df: DataFrame, json_col: str, keys: list[str], max_depth: int = 32) -> DataFrame:
    """Findings in nested JSON of any shape: forbidden key names, secret values, too much depth, text that is no JSON.

    Each level explodes the objects and arrays of the level before; the loop ends when a level holds
    no containers, which one existence check per level decides.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("record").alias("path"), F.try_parse_json(json_col).alias("_v"))
    found = [df.where(F.col(json_col).isNotNull() & F.try_parse_json(json_col).isNull()).select(
        *keys, F.lit("record").alias("path"), F.lit("INPUT_NOT_JSON").alias("code"))]
    for depth in range(max_depth + 1):
        text = F.try_variant_get("_v", "$", "string")
        kind = F.schema_of_variant("_v")
        leaf = ~kind.rlike("^(?:OBJECT|ARRAY)")
        found.append(level.where(leaf & F.coalesce(matches_any(text, EVENT_SECRETS), F.lit(False)))
                     .select(*keys, "path", F.lit("INLINE_SECRET_VALUE").alias("code")))
        nested = level.where(~leaf)
        if depth == max_depth:
            found.append(nested.select(*keys, "path", F.lit("INPUT_TOO_COMPLEX").alias("code")))
            break
        if nested.limit(1).isEmpty():
            break
        nested.createOrReplaceTempView("_nested_level")
        step = spark.sql(f"select {', '.join(f'`{k}`' for k in keys)}, path, t.key as _k, t.pos as _pos, t.value as _v "
                         "from _nested_level, lateral variant_explode(_v) as t")
        named = F.lower(F.regexp_replace("_k", "[-_]", "")).isin(*FORBIDDEN_KEYS)
        level = step.select(*keys, F.when(F.col("_k").isNull(), F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
                            .otherwise(F.concat_ws(".", "path", "_k")).alias("path"), "_k", "_v")
        found.append(level.where(F.coalesce(named, F.lit(False))).select(*keys, "path", F.lit("INLINE_SECRET_FIELD").alias("code")))
        level = level.drop("_k")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def safe_resource_ref(df: DataFrame, ref_col: str) -> DataFrame:
    """Add ``ref_problem`` for a map of typed identifiers: credential keys, values, or URL parts. Names in a query
    part are decoded first, so that an encoded name is seen as what it stands for."""
    def query_pairs(v: Column) -> Column:
        return F.split(F.regexp_extract(v, r"\?([^#]*)", 1), "&")

    # Full-width forms of the printable ASCII characters read as those.
    wide, plain = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))

    def bad_pair(pair: Column) -> Column:
        raw = F.split(pair, "=")[0]
        name = F.translate(F.coalesce(F.try_url_decode(raw), raw), wide, plain)
        name = F.lower(F.regexp_replace(name, "[._-]", ""))
        value = F.try_url_decode(F.get(F.split(pair, "=", 2), F.lit(1)))
        return (name.isin(*CREDENTIAL_QUERY_NAMES) | name.rlike(CREDENTIAL_QUERY_SUFFIX)
                | F.coalesce(matches_any(value, CREDENTIAL_VALUES), F.lit(False)))

    values = F.map_values(ref_col)
    fragment = lambda v: F.try_url_decode(F.regexp_extract(v, r"#(.*)$", 1))
    has_fragment = lambda v: F.contains(v, F.lit("#"))
    problem = (F.when(F.col(ref_col).isNull() | F.exists(values, lambda v: v.isNull()), "RESOURCE_REF_INVALID")
               .when(F.exists(F.map_keys(ref_col), lambda k: k.rlike(CREDENTIAL_KEY)), "CREDENTIAL_FIELD")
               .when(F.exists(values, lambda v: matches_any(F.trim(v), CREDENTIAL_VALUES)), "CREDENTIAL_VALUE")
               .when(F.exists(values, lambda v: v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")), "USERINFO")
               .when(F.exists(values, lambda v: F.exists(query_pairs(v), bad_pair)), "CREDENTIAL_QUERY")
               .when(F.exists(values, lambda v: has_fragment(v) & fragment(v).isNull()), "RESOURCE_REF_INVALID")
               .when(F.exists(values, lambda v: has_fragment(v) & F.coalesce(
                   matches_any(fragment(v), CREDENTIAL_VALUES), F.lit(False))), "CREDENTIAL_FRAGMENT"))
    return df.withColumn("ref_problem", problem)
