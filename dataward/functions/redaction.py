"""Redaction of text and attributes, and stable cardinality buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key and value patterns of secrets, and the span attributes that may leave a service.
SECRET_KEY = (r"(?i)(?:authorization|cookie|password|passwd|secret|token|api[-_]?key|private[-_]?key"
              r"|client[-_]?secret|credential)")
SECRET_VALUE = (r"(?i)(?:bearer\s+[a-z0-9._~+/-]+=*|-----BEGIN [A-Z ]*PRIVATE KEY-----"
                r"|(?:password|secret|token|api[-_]?key)\s*[=:]\s*\S+)")
SAFE_ATTRIBUTES = (
    "service.name", "service.version", "deployment.environment.name", "http.request.method",
    "http.response.status_code", "url.scheme", "server.address", "server.port",
    "network.protocol.version", "rpc.system", "rpc.service", "rpc.method", "db.system", "error.type",
)
SAFE_SUFFIXES = ("component", "operation", "result", "tenant_bucket")
REDACTED = "[REDACTED]"


def redact_text(col: Column, limit: int | None = None) -> Column:
    """Replace secret-looking spans over the whole text; ``limit`` then keeps that many first characters."""
    text = F.regexp_replace(col, SECRET_VALUE, REDACTED)
    return text if limit is None else F.substring(text, 1, limit)


def _is_secret(name: str) -> bool:
    return re.search(SECRET_KEY, name) is not None


def redact_value(col: Column, kind: T.DataType, secret: Column | bool = False) -> Column:
    """A value of any type with every text in it redacted, found by walking its type.

    Below a secret name (of a struct field or a map key, which array items and inner values inherit) texts read
    ``[REDACTED]`` and other plain values become null, as a column keeps its type.
    """
    hidden = secret if isinstance(secret, Column) else F.lit(secret)
    if isinstance(kind, T.StringType):
        return F.when(col.isNotNull() & hidden, F.lit(REDACTED)).otherwise(redact_text(col))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: redact_value(x, kind.elementType, secret))
    if isinstance(kind, T.StructType):
        fields = [redact_value(col[f.name], f.dataType, True if _is_secret(f.name) else secret).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*fields)) if fields else col
    if isinstance(kind, T.MapType):
        named = lambda k: F.regexp_like(k, F.lit(SECRET_KEY)) if isinstance(kind.keyType, T.StringType) else F.lit(False)
        return F.transform_values(col, lambda k, v: redact_value(v, kind.valueType, hidden | named(k)))
    return col if secret is False else F.when(~hidden, col)


def redact_map(col: Column) -> Column:
    return redact_value(col, T.MapType(T.StringType(), T.StringType()))


def redact(df: DataFrame, cols: list[str]) -> DataFrame:
    """Redact columns of texts, arrays, structs and maps, nested as they come; a column whose own name is secret
    is blanked whole."""
    return df.withColumns({c: redact_value(F.col(c), df.schema[c].dataType, _is_secret(c)) for c in cols})


def tenant_bucket(col: Column, salt: str, n: int = 64) -> Column:
    """``b0`` … ``b{n-1}`` from the first four bytes of SHA-256(salt, NUL, tenant)."""
    if len(salt.encode()) < 16 or not 2 <= n <= 256:
        raise ValueError("salt needs 16 bytes and the bucket count must be 2 to 256")
    head = F.substring(F.sha2(F.concat(F.lit(salt + "\0"), col), 256), 1, 8)
    return F.concat(F.lit("b"), (F.conv(head, 16, 10).cast("bigint") % n).cast("string"))


def allow_attributes(col: Column, tenant: Column | None = None, salt: str | None = None,
                     prefix: str = "app") -> Column:
    """Only allow-listed span attributes, redacted; the tenant appears as its bucket alone."""
    allowed = F.array(*[F.lit(a) for a in (*SAFE_ATTRIBUTES, *[f"{prefix}.{s}" for s in SAFE_SUFFIXES])])
    kept = F.map_filter(col, lambda k, v: F.array_contains(allowed, k)
                        & ~F.regexp_like(k, F.lit(SECRET_KEY)))
    cleaned = F.transform_values(kept, lambda k, v: redact_text(v))
    if tenant is None:
        return cleaned
    name = f"{prefix}.tenant_bucket"
    return F.map_concat(F.map_filter(cleaned, lambda k, v: k != name),
                        F.create_map(F.lit(name), tenant_bucket(tenant, salt)))
