"""Order of typed literals: exact for decimals of any length, partial for instants with and without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
# The numeric datatypes.
INTEGERS = ("integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt",
            "unsignedShort", "unsignedByte", "positiveInteger")
FLOATS = ("double", "float")
#: Seconds by which an instant without zone may lie before or after its own text in UTC.
ZONE_RANGE = 14 * 3600
_INFINITE = 1 << 40
_INSTANT = r"^(\d{4}-\d\d-\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?$"
_DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
_FLOATING = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that it may use often: the value is evaluated once and its expression not copied."""
    return F.transform(F.array(value), body)[0]


def _struct(**columns) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in columns.items()])


def _key(kind, zoned: Column, a: Column, b, c) -> Column:
    return _struct(kind=kind, zoned=zoned, a=a.cast("bigint"), b=b, c=c)


def _number_key(text: Column) -> Column:
    """Sign and length of the whole part, its digits, the digits after the point; of negative numbers with every
    digit replaced by what it lacks to nine, so that larger is smaller."""
    form = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$"
    part = lambda i: F.regexp_extract(text, form, i)
    lacks = lambda x: F.translate(x, "0123456789", "9876543210")

    def split(p):
        whole = F.when(p["point"] <= 0, "").otherwise(F.rpad(F.substring(p["digits"], F.lit(1), p["point"]), p["point"], "0"))
        rest = F.when(p["point"] <= 0, F.concat(F.repeat(F.lit("0"), -p["point"]), p["digits"])).otherwise(F.substring(p["digits"], p["point"] + 1, F.length(p["digits"])))
        return _struct(minus=p["minus"], whole=F.regexp_replace(whole, "^0+", ""), rest=F.regexp_replace(rest, "0+$", ""))

    def keyed(n):
        size = F.length(n["whole"]) + 1
        return (F.when((n["whole"] == "") & (n["rest"] == ""), _key("number", F.lit(False), F.lit(0), "", ""))
                .when(n["minus"], _key("number", F.lit(False), -size, lacks(n["whole"]), F.concat(lacks(n["rest"]), F.lit("~"))))
                .otherwise(_key("number", F.lit(False), size, n["whole"], n["rest"])))

    shift = F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    parts = _struct(minus=part(1) == "-", digits=F.concat(part(2), part(3)), point=F.length(part(2)) + shift)
    return _let(parts, lambda p: _let(split(p), keyed))


def _instant_key(text: Column, kind: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _INSTANT, i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    parts = _struct(right=text.rlike(_INSTANT), day=F.unix_date(part(1).try_cast("date")).cast("bigint"), h=number(2), m=number(3), s=number(4),
                    rest=F.regexp_replace(part(5), "0+$", ""), zone=part(6))

    def keyed(p):
        away = F.coalesce(F.substring(p["zone"], 2, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(p["zone"], 5, 2).try_cast("int"), F.lit(0)) * 60
        offset = F.when(p["zone"].startswith("-"), -away).when(p["zone"].startswith("+"), away).otherwise(0)
        midnight = (p["h"] == 24) & (p["m"] == 0) & (p["s"] == 0) & (p["rest"] == "")
        fine = p["right"] & p["day"].isNotNull() & (p["m"] < 60) & (p["s"] < 60) & ((p["h"] < 24) | midnight)
        return F.when(fine, _key(kind, p["zone"] != "", p["day"] * 86400 + p["h"] * 3600 + p["m"] * 60 + p["s"] - offset, "", p["rest"]))

    return _let(parts, keyed)


def order_key(text: Column, datatype: Column) -> Column:
    """Key of a literal (see ``before``); NULL if its datatype has no order here or its text is not of it.

    Numbers compare by value across their datatypes, whole and decimal ones exactly; doubles and floats by the
    number that is stored for them. Dates, times and years hold four-digit years. Texts and truth values compare
    among themselves. The key is a large expression: where it is used more than once, put it into a column with
    ``once``.
    """
    is_ = lambda *names: datatype.isin(*[XSD + n for n in names])
    clean = F.trim(text)
    stored = F.when(is_("float"), clean.try_cast("float").cast("string")).otherwise(clean.try_cast("double").cast("string"))
    stored = F.when(clean.rlike(_FLOATING), F.when(~stored.isin("Infinity", "-Infinity"), stored))
    number = (F.when(is_(*INTEGERS), F.when(clean.rlike(r"^[+-]?\d+$"), clean)).when(is_("decimal"), F.when(clean.rlike(_DECIMAL), clean)).when(is_(*FLOATS), stored))
    infinite = F.when(is_(*FLOATS), F.when(clean.isin("INF", "+INF"), _INFINITE).when(clean == "-INF", -_INFINITE))
    # Dates, years and times as instants: what is not of the datatype's form is not of this form either.
    instant = (F.when(is_("dateTime", "dateTimeStamp"), clean).when(is_("date"), F.regexp_replace(clean, r"^(\d{4}-\d\d-\d\d)", "$1T00:00:00"))
               .when(is_("gYear"), F.regexp_replace(clean, r"^(\d{4})", "$1-01-01T00:00:00")).when(is_("time"), F.concat(F.lit("1970-01-01T"), clean)))
    kind = F.when(is_("dateTimeStamp"), "dateTime").otherwise(F.substring(datatype, len(XSD) + 1, 20))
    truth = F.when(is_("boolean"), F.when(clean.isin("true", "1"), 1).when(clean.isin("false", "0"), 0))
    found = _struct(number=number, infinite=infinite, instant=instant, kind=kind, truth=truth, text=F.when(is_("string"), text))
    return _let(found, lambda f: (
        F.when(f["number"].isNotNull(), _number_key(f["number"])).when(f["infinite"].isNotNull(), _key("number", F.lit(False), f["infinite"], "", ""))
        .when(f["instant"].isNotNull(), _instant_key(f["instant"], f["kind"])).when(f["text"].isNotNull(), _key("string", F.lit(False), F.lit(0), f["text"], ""))
        .when(f["truth"].isNotNull(), _key("boolean", F.lit(False), f["truth"], "", ""))))


def before(x: Column, y: Column, strict: bool = True) -> Column:
    """Is x surely less than y (or, not strict, the same)? NULL or False where the two have no order.

    An instant without zone may lie fourteen hours on either side, so beside one with a zone it has an order only
    where they are further apart.
    """
    at = lambda k, more=0: F.struct((k["a"] + more).alias("a"), k["b"].alias("b"), k["c"].alias("c"))
    alike = at(x) < at(y) if strict else at(x) <= at(y)
    return (x["kind"] == y["kind"]) & F.when(x["zoned"] == y["zoned"], alike).otherwise(at(x, ZONE_RANGE) < at(y))
