"""Lexical checks: instants, identities, identifiers and typed literals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INSTANT = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:[.]\d+)?(Z|[+-]\d{2}:\d{2})$"
_DID = r"^did:[a-z0-9]+:(?:[A-Za-z0-9._-]|%[0-9A-Fa-f]{2})+(?::(?:[A-Za-z0-9._-]|%[0-9A-Fa-f]{2})+)*$"
IDENTIFIER = r"^[\p{L}\p{N}][\p{L}\p{N}._~:/-]*$"
VERSION = r"^(0|[1-9]\d{0,63})$"


def _part(col: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(col, pattern, i).try_cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return (F.when(month == 2, F.when(leap, 29).otherwise(28))
            .when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31).otherwise(0))


def rfc3339_valid(col: Column) -> Column:
    """Strict instant: real calendar date, no leap second, and a known offset (-00:00 is refused)."""
    y, mo, d, h, mi, s = [_part(col, _INSTANT, i) for i in range(1, 7)]
    zone = F.regexp_extract(col, _INSTANT, 7)
    offset = (zone == "Z") | ((zone != "-00:00") & (F.substring(zone, 2, 2).try_cast("int") <= 23)
                              & (F.substring(zone, 5, 2).try_cast("int") <= 59))
    ok = (col.rlike(_INSTANT) & d.between(1, days_in_month(y, mo)) & (h <= 23) & (mi <= 59)
          & (s <= 59) & offset)
    return F.coalesce(ok, F.lit(False))


def identity_valid(col: Column) -> Column:
    """An HTTPS URL without user information, or a bare DID; printable ASCII only."""
    authority = F.regexp_extract(col, r"^https://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"[.]$", "")
    https = (col.startswith("https://") & ~F.contains(col, F.lit("\\"))
             & ~col.rlike(r"%(?![0-9A-Fa-f]{2})") & ~F.contains(authority, F.lit("@"))
             & host.rlike(r"^(?:\[[0-9A-Fa-f:.]+\]|[^.\s]+(?:[.][^.\s]+)*)$"))
    return F.coalesce(col.rlike(r"^[\x21-\x7E]+$") & (https | col.rlike(_DID)), F.lit(False))


def local_identifier_valid(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]{2,255}$"), F.lit(False))


def identifier_valid(col: Column) -> Column:
    """Identifier grammar of feeds: letters, digits and ``._~:/-``, at most 256 characters."""
    return F.coalesce(col.rlike(IDENTIFIER) & (F.length(col) <= 256), F.lit(False))


# --- typed literals ---------------------------------------------------------------------------

_ZONE = r"(Z|[+-](?:(?:0\d|1[0-3]):[0-5]\d|14:00))?"
_YEAR = r"(-?(?:[1-9]\d{3,}|0\d{3}))"
_DATE = rf"^{_YEAR}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]){_ZONE}$"
_TIME_OF_DAY = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)"
_DATETIME = rf"^{_YEAR}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T{_TIME_OF_DAY}{_ZONE}$"
XSD = "http://www.w3.org/2001/XMLSchema#"

_FLOAT = r"^(?:-?INF|NaN|[+-]?(?:\d+(?:[.]\d*)?|[.]\d+)(?:[eE][+-]?\d+)?)$"

# Datatypes with a purely lexical rule.
_LEXICAL = {
    "boolean": r"^(?:true|false|0|1)$",
    "decimal": r"^[+-]?(?:\d+(?:[.]\d*)?|[.]\d+)$",
    "double": _FLOAT,
    "duration": r"^-?P(?=.)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:[.]\d+)?S)?)?$",
    "float": _FLOAT,
    "hexBinary": r"^(?:[0-9A-Fa-f]{2})*$",
    "integer": r"^[+-]?\d+$",
    "negativeInteger": r"^-0*[1-9]\d*$",
    "nonNegativeInteger": r"^(?:[+]?\d+|-0+)$",
    "nonPositiveInteger": r"^(?:-\d+|[+]?0+)$",
    "positiveInteger": r"^[+]?0*[1-9]\d*$",
    "string": r"(?s)^.*$",
}
_CALENDAR = {"date": _DATE, "dateTime": _DATETIME, "dateTimeStamp": _DATETIME}


def _real_day(col: Column, pattern: str) -> Column:
    """Day within its month; 10,000 is a multiple of 400, so the last four year digits decide."""
    year = F.regexp_replace(F.regexp_extract(col, pattern, 1), "^-", "")
    y = F.substring(year, -4, 4).try_cast("int")
    day = F.regexp_extract(col, pattern, 3).try_cast("int")
    month = F.regexp_extract(col, pattern, 2).try_cast("int")
    return (year != "0000") & (day <= days_in_month(y, month))


def xsd_valid(value: Column, datatype: Column) -> Column:
    """NULL for datatypes outside XML Schema, else whether the text is a valid literal of it."""
    rule = F.lit(False)
    for name, pattern in _LEXICAL.items():
        rule = F.when(datatype == XSD + name, value.rlike(pattern)).otherwise(rule)
    for name, pattern in _CALENDAR.items():
        ok = value.rlike(pattern) & F.coalesce(_real_day(value, pattern), F.lit(False))
        if name == "dateTimeStamp":
            ok = ok & value.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
        rule = F.when(datatype == XSD + name, ok).otherwise(rule)
    return F.when(datatype.startswith(XSD), F.coalesce(rule, F.lit(False)))


def xsd_reason(value: Column, datatype: Column) -> Column:
    known = datatype.isin(*[XSD + n for n in (*_LEXICAL, *_CALENDAR)])
    return F.when(datatype.startswith(XSD) & ~known, "unsupported-xsd-datatype").when(
        ~xsd_valid(value, datatype), "invalid-lexical-or-value-space")
