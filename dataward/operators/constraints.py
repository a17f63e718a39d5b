"""Shape constraints over quads: targets, value checks, logical combinations, reports.

A focus frame has (graph, node, node_kind). Every check returns (graph, node, value) for the values
that break it; a shape collects them as findings. Nested shapes work on conforming *sets*: a node
conforms when it is absent from the violating nodes of the shape.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.functions.lexical import xsd_valid
from dataward.functions.lineage import cut_lineage
from dataward.functions.ordering import XSD, before, order_key
from dataward.operators.graph import RDF_TYPE, path

NODE = ["graph", "node", "node_kind"]
STRING = "http://www.w3.org/2001/XMLSchema#string"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


@dataclass(frozen=True)
class Term:
    """A whole term as a parameter: kind (iri, literal, bnode), text, and of a literal its datatype and language."""
    kind: str
    value: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Shape:
    """One shape: where it applies, the path it looks along (None for the node), what must hold."""
    shape: str
    constraints: tuple = ()                    # (component, parameter) pairs, see ``CHECKS``
    target: tuple | None = None                # ("class", iri) | ("subjectsOf", p) | ("objectsOf", p) | ("node", iri)
    path: object = None
    severity: str = "Violation"
    requirement: str | None = None
    message: str | None = None
    deactivated: bool = False
    properties: tuple = field(default_factory=tuple)   # property shapes that share the focus nodes


# --- targets and values ----------------------------------------------------------------------

def targets(q: DataFrame, target: tuple, superclasses: DataFrame | None = None) -> DataFrame:
    """Focus nodes of a target; class targets follow ``superclasses`` (a is a subclass of b)."""
    kind, term = target
    if kind == "class":
        typed = q.where(F.col("p") == RDF_TYPE)
        exact = typed.where(F.col("o") == term)
        if superclasses is not None:
            below = superclasses.where((F.col("b") == term) & (F.col("a") != term)).select(F.col("a").alias("o")).distinct()
            exact = exact.unionByName(typed.join(below, "o", "left_semi").select(*typed.columns))
        typed = exact
        return typed.select("graph", F.col("s").alias("node"), F.col("s_kind").alias("node_kind")).distinct()
    if kind == "subjectsOf":
        return q.where(F.col("p") == term).select("graph", F.col("s").alias("node"), F.col("s_kind").alias("node_kind")).distinct()
    if kind == "objectsOf":
        return q.where(F.col("p") == term).select("graph", F.col("o").alias("node"), F.col("o_kind").alias("node_kind")).distinct()
    if kind == "node":
        return q.select("graph").distinct().select("graph", F.lit(term).alias("node"), F.lit("iri").alias("node_kind"))
    raise ValueError(f"unknown target: {kind}")


def values_of(q: DataFrame, focus: DataFrame, along) -> DataFrame:
    """(graph, node, node_kind, v, v_kind, datatype, lang): distinct values of each focus node."""
    if along is None:
        none = F.lit(None).cast("string")
        return focus.select(*NODE, F.col("node").alias("v"), F.col("node_kind").alias("v_kind"), none.alias("datatype"), none.alias("lang"))
    pairs = path(q, along).select("graph", F.col("s").alias("node"), F.col("s_kind").alias("node_kind"), F.col("o").alias("v"), F.col("o_kind").alias("v_kind"), "datatype", "lang")
    return pairs.join(focus, NODE, "left_semi")


def _datatype() -> Column:
    return F.when(F.col("v_kind") == "literal", F.when(F.col("lang").isNotNull(), LANG_STRING).otherwise(F.coalesce("datatype", F.lit(STRING))))


def _bad(vals: DataFrame, broken: Column) -> DataFrame:
    return vals.where(F.coalesce(broken, F.lit(True))).select("graph", "node", F.col("v").alias("value"))


def _of_focus(focus: DataFrame, value: Column | None = None) -> DataFrame:
    return focus.select("graph", "node", (value if value is not None else F.lit(None)).cast("string").alias("value"))


def _typed(q: DataFrame, term: str, superclasses: DataFrame | None) -> DataFrame:
    return targets(q, ("class", term), superclasses).select("graph", F.col("node").alias("v"), F.col("node_kind").alias("v_kind"))


# --- checks ----------------------------------------------------------------------------------
# Each takes (q, focus, vals, parameter, context) and returns (graph, node, value).

def min_count(q, focus, vals, n, ctx):
    counted = vals.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("_n"))
    return _of_focus(focus.join(counted, ["graph", "node"], "left").where(F.coalesce("_n", F.lit(0)) < n))


def max_count(q, focus, vals, n, ctx):
    counted = vals.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("_n"))
    return _of_focus(counted.where(F.col("_n") > n))


def datatype(q, focus, vals, term, ctx):
    valid = F.coalesce(xsd_valid(F.col("v"), F.lit(term)), F.lit(True))
    return _bad(vals, ~(F.coalesce(_datatype() == term, F.lit(False)) & valid))


def node_kind(q, focus, vals, kinds, ctx):
    allowed = [kinds] if isinstance(kinds, str) else list(kinds)
    return _bad(vals, ~F.col("v_kind").isin(allowed))


def class_(q, focus, vals, term, ctx):
    return vals.join(_typed(q, term, ctx.get("superclasses")), ["graph", "v", "v_kind"], "left_anti").select("graph", "node", F.col("v").alias("value"))


def _is(term) -> Column:
    """Is the value this term? A plain text with a scheme stands for an IRI, any other for a literal of this text."""
    if isinstance(term, Term):
        if term.kind != "literal":
            return (F.col("v_kind") == term.kind) & (F.col("v") == term.value)
        kind = term.datatype or (LANG_STRING if term.lang else STRING)
        return ((F.col("v_kind") == "literal") & (F.col("v") == term.value) & (_datatype() == kind)
                & F.lower("lang").eqNullSafe(F.lit(term.lang.lower() if term.lang else None)))
    kind = "iri" if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", term) else "literal"
    return (F.col("v_kind") == kind) & (F.col("v") == term)


def in_(q, focus, vals, terms, ctx):
    return _bad(vals, ~F.coalesce(reduce(lambda a, b: a | b, [_is(t) for t in terms], F.lit(False)), F.lit(False)))


def has_value(q, focus, vals, term, ctx):
    return _of_focus(focus.join(vals.where(_is(term)).select("graph", "node"), ["graph", "node"], "left_anti"))


def pattern(q, focus, vals, rule, ctx):
    regex, flags = rule if isinstance(rule, tuple) else (rule, "")
    return _bad(vals, (F.col("v_kind") == "bnode") | ~F.col("v").rlike((f"(?{flags})" if flags else "") + regex))


def min_length(q, focus, vals, n, ctx):
    return _bad(vals, (F.col("v_kind") == "bnode") | (F.length("v") < n))


def max_length(q, focus, vals, n, ctx):
    return _bad(vals, (F.col("v_kind") == "bnode") | (F.length("v") > n))


def language_in(q, focus, vals, tags, ctx):
    tag = F.lower(F.coalesce("lang", F.lit("")))
    match = reduce(lambda a, b: a | b, [(tag == t.lower()) | tag.startswith(t.lower() + "-") for t in tags])
    return _bad(vals, ~match)


def unique_lang(q, focus, vals, on, ctx):
    repeated = vals.where(F.col("lang").isNotNull()).groupBy("graph", "node", F.lower("lang").alias("_l")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return _of_focus(repeated.select("graph", "node").distinct()) if on else _of_focus(focus.where(F.lit(False)))


def _limit(limit) -> Column:
    """Order key of a bound: a number, a ``Term`` literal, or the text of a number or an instant."""
    if isinstance(limit, Term):
        text, kind = limit.value, limit.datatype or STRING
    elif isinstance(limit, str):
        forms = ((r"[+-]?\d+", XSD + "integer"), (r"[+-]?(\d+\.?\d*|\.\d+)", XSD + "decimal"), (r"\d{4}-\d\d-\d\dT.*", XSD + "dateTime"), (r"\d{4}-\d\d-\d\d.*", XSD + "date"))
        text, kind = limit, next((k for f, k in forms if re.fullmatch(f, limit)), STRING)
    else:
        text, kind = format(Decimal(str(limit)), "f"), XSD + "decimal"
    return order_key(F.lit(text), F.lit(kind))


def _bound(holds):
    def check(q, focus, vals, limit, ctx):
        rows = once(vals, {"_key": order_key(F.col("v"), _datatype()), "_limit": _limit(limit)})
        return _bad(rows, ~(F.coalesce(holds(F.col("_key"), F.col("_limit")), F.lit(False)) & (F.col("v_kind") == "literal")))
    return check


def _whole(df: DataFrame) -> DataFrame:
    """Values with what tells their terms apart besides the text."""
    none = F.lit("")
    return df.withColumn("_term", F.when(F.col("v_kind") == "literal", F.concat_ws(" ", _datatype(), F.lower(F.coalesce("lang", none)))).otherwise(none))


_TERM = ["graph", "node", "v", "v_kind", "_term"]


def equals(q, focus, vals, predicate, ctx):
    one, two = _whole(vals), _whole(values_of(q, focus, predicate))
    # One grouping tells which side a term is on; a term with a null part equals none.
    sides = one.select(*_TERM, F.lit(1).alias("_side")).unionByName(two.select(*_TERM, F.lit(2).alias("_side"))).groupBy(*_TERM).agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    unlike = (F.col("_a") == F.col("_b")) | reduce(lambda x, y: x | y, [F.col(c).isNull() for c in _TERM])
    return sides.where(unlike).select("graph", "node", F.col("v").alias("value"))


def disjoint(q, focus, vals, predicate, ctx):
    other = _whole(values_of(q, focus, predicate)).select(*_TERM)
    return _whole(vals).join(other, _TERM, "left_semi").select("graph", "node", F.col("v").alias("value"))


def _less(strict: bool):
    def check(q, focus, vals, predicate, ctx):
        # Per node the least values with and without zone decide, so values are never paired. A value beside
        # which another has no order breaks the rule.
        key = F.when(F.col("v_kind") == "literal", order_key(F.col("v"), _datatype()))
        other = once(values_of(q, focus, predicate), {"_key": key})
        least = other.groupBy("graph", "node").agg(
            F.min(F.when(F.col("_key.zoned"), F.col("_key"))).alias("_zoned"), F.min(F.when(~F.col("_key.zoned"), F.col("_key"))).alias("_plain"),
            F.min("_key.kind").alias("_kind"), F.max("_key.kind").alias("_kind_too"), F.count_if(F.col("_key").isNull()).alias("_odd"))
        rows = once(vals, {"_key": key}).join(least, ["graph", "node"])
        ahead = lambda c: F.col(c).isNull() | F.coalesce(before(F.col("_key"), F.col(c), strict), F.lit(False))
        held = (F.col("_odd") == 0) & (F.col("_kind") == F.col("_kind_too")) & ahead("_zoned") & ahead("_plain")
        return rows.where(~F.coalesce(held, F.lit(False))).select("graph", "node", F.col("v").alias("value")).distinct()
    return check


def _as_focus(vals: DataFrame) -> DataFrame:
    return vals.select("graph", F.col("v").alias("node"), F.col("v_kind").alias("node_kind")).distinct()


def _conforming(q, vals, shape: Shape, ctx) -> DataFrame:
    """Values of ``vals`` that conform to a shape, as (graph, v, v_kind).

    The nodes are read several times below, so they are written once; otherwise each level of nesting
    would multiply the plan.
    """
    nodes = cut_lineage(_as_focus(vals))
    broken = violations(q, nodes, shape, ctx).select("graph", "node").distinct()
    return nodes.join(broken, ["graph", "node"], "left_anti").select("graph", F.col("node").alias("v"), F.col("node_kind").alias("v_kind"))


_VALUE = ["graph", "v", "v_kind"]


def node(q, focus, vals, shape, ctx):
    return vals.join(_conforming(q, vals, shape, ctx), _VALUE, "left_anti").select("graph", "node", F.col("v").alias("value"))


def not_(q, focus, vals, shape, ctx):
    return vals.join(_conforming(q, vals, shape, ctx), _VALUE, "left_semi").select("graph", "node", F.col("v").alias("value"))


def _times(q, vals, shapes, ctx) -> DataFrame:
    hits = reduce(DataFrame.unionByName, [_conforming(q, vals, s, ctx) for s in shapes]).groupBy(*_VALUE).agg(F.count(F.lit(1)).alias("_hits"))
    return vals.join(hits, _VALUE, "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))


def or_(q, focus, vals, shapes, ctx):
    return _times(q, vals, shapes, ctx).where(F.col("_hits") == 0).select("graph", "node", F.col("v").alias("value"))


def and_(q, focus, vals, shapes, ctx):
    return _times(q, vals, shapes, ctx).where(F.col("_hits") < len(shapes)).select("graph", "node", F.col("v").alias("value"))


def xone(q, focus, vals, shapes, ctx):
    return _times(q, vals, shapes, ctx).where(F.col("_hits") != 1).select("graph", "node", F.col("v").alias("value"))


def qualified(q, focus, vals, rule, ctx):
    shape, least, most = (*rule, None)[:3] if len(rule) < 3 else rule
    counted = vals.join(_conforming(q, vals, shape, ctx), _VALUE, "left_semi").groupBy("graph", "node").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    broken = n < (least or 0)
    if most is not None:
        broken = broken | (n > most)
    return _of_focus(focus.join(counted, ["graph", "node"], "left").where(broken))


def closed(q, focus, vals, allowed, ctx):
    extra = q.where(~F.col("p").isin(list(allowed))).select("graph", F.col("s").alias("node"), F.col("s_kind").alias("node_kind"), F.col("p").alias("value"))
    return extra.join(focus, NODE, "left_semi").select("graph", "node", "value").distinct()


CHECKS = {
    "minCount": min_count, "maxCount": max_count, "datatype": datatype, "nodeKind": node_kind, "class": class_, "in": in_,
    "hasValue": has_value, "pattern": pattern, "minLength": min_length, "maxLength": max_length, "languageIn": language_in, "uniqueLang": unique_lang,
    "minInclusive": _bound(lambda v, least: before(least, v, False)), "maxInclusive": _bound(lambda v, most: before(v, most, False)),
    "minExclusive": _bound(lambda v, least: before(least, v)), "maxExclusive": _bound(lambda v, most: before(v, most)),
    "equals": equals, "disjoint": disjoint, "lessThan": _less(True), "lessThanOrEquals": _less(False),
    "node": node, "not": not_, "or": or_, "and": and_, "xone": xone, "qualifiedValueShape": qualified, "closed": closed,
}


def violations(q: DataFrame, focus: DataFrame, shape: Shape, ctx: dict | None = None) -> DataFrame:
    """(graph, node, value, component, shape): what breaks a shape on the given focus nodes."""
    ctx = ctx or {}
    found = []
    if not shape.deactivated:
        vals = values_of(q, focus, shape.path)
        found = [CHECKS[c](q, focus, vals, parameter, ctx).select("graph", "node", "value", F.lit(c).alias("component"), F.lit(shape.shape).alias("shape"))
                 for c, parameter in shape.constraints]
        found += [violations(q, focus, p, ctx) for p in shape.properties]
    if not found:
        return focus.where(F.lit(False)).select("graph", "node", *[F.lit(None).cast("string").alias(c) for c in ("value", "component", "shape")])
    return reduce(DataFrame.unionByName, found)


def validate(q: DataFrame, shapes: list[Shape], superclasses: DataFrame | None = None) -> DataFrame:
    """Findings of all active shapes. Cache ``q`` partitioned by predicate when shapes are many."""
    frames = []
    for s in shapes:
        if s.deactivated:
            continue
        focus = targets(q, s.target, superclasses)
        text = s.path if isinstance(s.path, str) else (None if s.path is None else str(s.path))
        frames.append(violations(q, focus, s, {"superclasses": superclasses}).select(
            "graph", F.col("node").alias("focus_node"), F.lit(text).alias("path"), "value", F.lit(s.severity).alias("severity"),
            F.lit(s.requirement).alias("requirement_id"), "component", "shape", F.lit(s.message).alias("message")))
    return reduce(DataFrame.unionByName, frames)


# --- report ----------------------------------------------------------------------------------

def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings in a fixed order: by their canonical JSON."""
    return findings.orderBy(F.to_json(F.struct(*sorted(findings.columns))))


def report(findings: DataFrame, cap: int, gate: str = "violation") -> DataFrame:
    """Severity counts, overflow flag and verdict per graph; ``gate`` warning also blocks on warnings."""
    count = lambda s: F.count_if(F.col("severity") == s)
    blocked = F.col("violations") > 0
    if gate == "warning":
        blocked = blocked | (F.col("warnings") > 0)
    return findings.groupBy("graph").agg(
        count("Violation").alias("violations"), count("Warning").alias("warnings"), count("Info").alias("infos"), F.count(F.lit(1)).alias("results")).withColumns({
            "overflow": F.col("results") > cap, "conforms": ~blocked})


def capped(findings: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``cap`` findings in order, one row with total and overflow flag)."""
    total = findings.agg(F.count(F.lit(1)).alias("total")).withColumn("overflow", F.col("total") > cap)
    return ordered_findings(findings).limit(cap), total


def result_multiset(findings: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per group: number of results and of distinct signatures, and a digest of the multiset."""
    from dataward.functions.skew import ordered_root
    signed = findings.withColumn("_sig", F.sha2(F.to_json(F.struct(*sorted(cols))), 256))
    distinct = signed.groupBy(*keys).agg(F.count_distinct("_sig").alias("signatures"))
    return ordered_root(signed, keys, "_sig").join(distinct, keys).withColumnsRenamed({"root": "multiset_sha256", "row_count": "results"})


# --- requirements ----------------------------------------------------------------------------

def requirement_of(shapes: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph, node, requirement_id): the requirement of a labelled shape reaches its anonymous parts.

    ``labels``: graph, node, requirement_id. A part with its own label keeps it. Parts lie at any depth; each is
    labelled once, so cycles end as well.
    """
    down = cut_lineage(shapes.where(F.col("o_kind") == "bnode").select("graph", F.col("s").alias("node"), F.col("o").alias("_part")).distinct())
    known = cut_lineage(labels.select("graph", "node", "requirement_id").distinct())
    frontier = known
    while True:
        fresh = frontier.join(down, ["graph", "node"]).select("graph", F.col("_part").alias("node"), "requirement_id").distinct()
        frontier = cut_lineage(fresh.join(known.select("graph", "node"), ["graph", "node"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = cut_lineage(known.unionByName(frontier))


def requirement_inventory(props: DataFrame) -> DataFrame:
    """Requirements from property shapes: cardinality, range, vocabulary, severity and obligation.

    ``props``: requirement_id, path, min_count, max_count, datatype, class, has_value, allowed (array), severity.
    """
    least, most = F.coalesce("min_count", F.lit(0)), F.col("max_count")
    obligation = (F.when((most == 0) & (F.col("severity") == "Violation"), "MUST-NOT").when(most == 0, "SHOULD-NOT")
                  .when(F.col("severity") == "Violation", F.when((least > 0) | F.col("has_value").isNotNull(), "MUST").otherwise("MAY"))
                  .when(F.col("severity") == "Warning", "SHOULD").otherwise("MAY"))
    return props.select("requirement_id", "path", F.concat(least.cast("string"), F.lit(".."), F.coalesce(most.cast("string"), F.lit("*"))).alias("cardinality"),
                        F.coalesce("datatype", "class").alias("range"), F.array_join(F.array_sort("allowed"), " ").alias("vocabulary"), "severity", obligation.alias("obligation"))


def requirement_coverage(requirements: DataFrame, cases: DataFrame) -> DataFrame:
    """Which requirements have positive and negative evidence; the open ones get a blocker id."""
    seen = cases.groupBy("requirement_id").agg(
        F.bool_or(F.col("polarity") == "positive").alias("_pos"), F.bool_or(F.col("polarity") == "negative").alias("_neg"))
    j = requirements.join(seen, "requirement_id", "left").withColumns({
        "positive": F.coalesce("_pos", F.lit(False)), "negative": F.coalesce("_neg", F.lit(False))}).drop("_pos", "_neg")
    blocker = F.concat(F.lit("BLK-"), F.upper(F.substring(F.sha2("requirement_id", 256), 1, 12)))
    return j.withColumn("blocker_id", F.when(~(F.col("positive") & F.col("negative")), blocker))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count(F.lit(1)).alias("requirements"), F.count_if(F.col("positive") & F.col("negative")).alias("covered"),
                        F.count("blocker_id").alias("blockers"))


def runtime_coverage(requirements: DataFrame, profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """Requirements by executable profile with the fixtures that exercised them.

    ``profiles``: profile, requirement_ids (array); ``runs``: profile, requirement_ids, fixture_id, expected.
    """
    planned = profiles.select("profile", F.explode("requirement_ids").alias("requirement_id")).distinct()
    ran = runs.select("profile", "fixture_id", "expected", F.explode("requirement_ids").alias("requirement_id"))
    seen = ran.groupBy("profile", "requirement_id").agg(
        F.count_distinct("fixture_id").alias("fixtures"), F.bool_or(F.col("expected") == "accept").alias("_pos"), F.bool_or(F.col("expected") == "reject").alias("_neg"))
    return (requirements.select("requirement_id").join(planned, "requirement_id", "left").join(seen, ["profile", "requirement_id"], "left")
            .select("requirement_id", "profile", F.coalesce("fixtures", F.lit(0)).alias("fixtures"),
                    F.coalesce("_pos", F.lit(False)).alias("positive"), F.coalesce("_neg", F.lit(False)).alias("negative")))
