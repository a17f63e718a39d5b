"""Requirements read from shape statements, and the validation cases that follow from them.

Shapes are schema-sized, yet nothing here is collected: values that depend on nested anonymous nodes are folded from the
leaves up, one join per level of nesting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.lineage import stored
from dataward.operators.graph import RDF, RDF_TYPE, whole_lists

# The shape vocabulary, and the predicates that a shape may have without constraining anything itself.
SH = "http://www.w3.org/ns/shacl#"
TARGETS = ("targetClass", "targetNode", "targetObjectsOf", "targetSubjectsOf")
CONTAINER = ("deactivated", "description", "ignoredProperties", "message", "name", "order", "property", "severity", "target", *TARGETS)
UNARY = ("inversePath", "zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath")


def fold_up(parts: DataFrame, combine: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(values, open): values of nodes whose parts all have one, and the parts of nodes that never get there.

    ``parts``: graph, node, kind, pos, child, value; the value is null where it is that of the node ``child``. ``combine``
    takes the kind and the values in order of pos. A round settles a level; nodes on cycles, or above them, stay open.
    """
    left = stored(parts)
    done = None
    while True:
        whole = left.groupBy("graph", "node", "kind").agg(F.count(F.lit(1)).alias("_n"), F.count("value").alias("_k"),
                                                          F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_parts")).where("_n = _k")
        fresh = stored(whole.select("graph", "node", combine(F.col("kind"), F.col("_parts.value")).alias("value")))
        done = fresh if done is None else done.unionByName(fresh)
        if fresh.isEmpty():
            return done, left
        known = fresh.select("graph", F.col("node").alias("child"), F.col("value").alias("_v"))
        rest = left.join(fresh.select("graph", "node"), ["graph", "node"], "left_anti").join(known, ["graph", "child"], "left")
        left = stored(rest.select("graph", "node", "kind", "pos", "child", F.coalesce("value", "_v").alias("value")))


def path_texts(q: DataFrame, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(graph, node, path): text of every anonymous path node.

    Sequences are lists, ``(a/b)``; ``^a``, ``(a)*``, ``(a)+`` and ``(a)?`` have one such part, alternatives ``(a|b)`` a list. A
    node that is none of these, and one whose parts lead back to itself, reads ``_:unsupported(node)``; above a loop
    the text of the looping part stands in the text.
    """
    members, heads = lists or whole_lists(q)
    item = members.select("graph", F.col("head").alias("_head"), "pos", F.col("value").alias("child"), F.col("value_kind").alias("child_kind"))
    names = [SH + u for u in (*UNARY, "alternativePath")]
    steps = q.where(F.col("p").isin(names) & (F.col("s_kind") == "bnode")).select("graph", F.col("s").alias("node"), "p", "o", "o_kind").distinct()
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("p"))
    one = steps.groupBy("graph", "node", "p").agg(F.count(F.lit(1)).alias("_n"), F.first("o").alias("o"), F.first("o_kind").alias("o_kind")).where("_n = 1")
    chosen = one.join(heads.select("graph", F.col("head").alias("node")), ["graph", "node"], "left_anti")
    whole = heads.select("graph", F.col("head").alias("o"), F.lit(True).alias("_whole"))
    usable = chosen.join(whole, ["graph", "o"], "left").where((F.col("p") != SH + "alternativePath") | F.col("_whole") | (F.col("o") == RDF + "nil"))
    best = usable.groupBy("graph", "node").agg(F.min_by(F.struct("p", "o", "o_kind"), rank).alias("x")).select("graph", "node", "x.p", "x.o", "x.o_kind")
    unary = best.where(F.col("p") != SH + "alternativePath").select("graph", "node", F.col("p").alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.col("o").alias("child"), F.col("o_kind").alias("child_kind"))
    either = best.where(F.col("p") == SH + "alternativePath")
    empty = either.where(F.col("o") == RDF + "nil").select("graph", "node", F.col("p").alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("child"), F.lit("none").alias("child_kind"))
    options = either.select("graph", "node", F.col("p").alias("kind"), F.col("o").alias("_head")).join(item, ["graph", "_head"]).drop("_head")
    ordered = item.withColumnRenamed("_head", "node").withColumn("kind", F.lit("sequence"))
    parts = unary.unionByName(empty).unionByName(options).unionByName(ordered)
    composed = parts.select("graph", F.col("node").alias("child"), F.lit(True).alias("_composed")).distinct()
    parts = parts.join(composed, ["graph", "child"], "left")
    odd = F.concat(F.lit("_:unsupported("), F.col("child"), F.lit(")"))
    leaf = F.when(F.col("child_kind").isin("iri", "none"), F.col("child")).when((F.col("child_kind") == "literal") | F.col("_composed").isNull(), odd)
    parts = parts.select("graph", "node", "kind", "pos", "child", leaf.alias("value"))

    def combine(kind: Column, values: Column) -> Column:
        inner = F.element_at(values, 1)
        closed = lambda mark: F.concat(F.lit("("), inner, F.lit(mark))
        return (F.when(kind == "sequence", F.concat(F.lit("("), F.array_join(values, "/"), F.lit(")")))
                .when(kind == SH + "alternativePath", F.concat(F.lit("("), F.array_join(values, "|"), F.lit(")")))
                .when(kind == SH + "inversePath", F.concat(F.lit("^"), inner)).when(kind == SH + "zeroOrMorePath", closed(")*"))
                .when(kind == SH + "oneOrMorePath", closed(")+")).otherwise(closed(")?")))

    texts, looped = fold_up(parts, combine)
    # Nodes left over lie on a loop or above one. A loop has no leaf to start from: its own nodes become leaves.
    ring = _on_loop(looped)
    above, _ = fold_up(looped.join(ring, ["graph", "node"], "left_anti").join(ring.select("graph", F.col("node").alias("child"), F.lit(True).alias("_ring")), ["graph", "child"], "left").select(
        "graph", "node", "kind", "pos", "child", F.when(F.col("_ring"), odd).otherwise(F.col("value")).alias("value")), combine)
    rest = ring.select("graph", "node", F.concat(F.lit("_:unsupported("), "node", F.lit(")")).alias("value"))
    return texts.unionByName(above).unionByName(rest).withColumnRenamed("value", "path")


def _on_loop(parts: DataFrame) -> DataFrame:
    """(graph, node) of open parts that lie on a loop, or between loops: those that no open node above leads out of."""
    edges = stored(parts.where("value is null").select("graph", "node", "child").distinct())
    while True:
        # A node that nothing points to is above the loops only.
        low = edges.select("graph", F.col("child").alias("node")).distinct()
        kept = stored(edges.join(low, ["graph", "node"], "left_semi"))
        if kept.count() == edges.count():
            return edges.select("graph", "node").distinct()
        edges = kept


def shape_requirements(q: DataFrame, namespace: str, requirement_id: str) -> DataFrame:
    """One row per constraint: graph, node, kind, owner, requirement_ids, path, minimum, maximum, range, vocabulary,
    severity, obligation.

    ``q``: statements (graph, s, s_kind, p, o, o_kind). Constraints are the named shapes below ``namespace`` that constrain
    something themselves and the property shapes that named shapes hold. ``requirement_id`` is the predicate of ids.

    A severity of its own counts if it is one of the three; several, or another one, give null. Without one, the worst of
    the property shapes below counts, a null being a violation, and without those a violation. Counts need one plain
    whole number, or they are null. Loops of property shapes have no severity.
    """
    # Statements are made and read once, and every join is planned by the size that rows really have.
    q = stored(q)
    sh = lambda *names: F.col("p").isin([SH + n for n in names])
    iri = F.col("o_kind") == "iri"
    term = F.struct("o", "o_kind")
    types = F.array_sort(F.collect_set(F.when(F.col("p") == RDF_TYPE, F.col("o"))))
    pick = lambda cond, value=F.col("o"): F.array_sort(F.collect_set(F.when(cond, value)))
    plain = F.col("p").startswith(SH) & ~sh(*CONTAINER)
    node = q.groupBy("graph", "s", "s_kind").agg(
        types.alias("types"), pick(sh("path"), term).alias("paths"), pick(sh("minCount"), term).alias("mins"), pick(sh("maxCount"), term).alias("maxs"),
        pick(sh("class", "datatype", "nodeKind") & iri).alias("range"), pick(sh("hasValue") & iri).alias("has"), pick(sh("in"), term).alias("ins"),
        pick(sh("severity"), term).alias("own"), pick(F.col("p") == requirement_id, F.when(F.col("o_kind") == "literal", F.col("o"))).alias("requirement_ids"),
        F.bool_or(sh("property")).alias("holds"), F.bool_or(sh(*TARGETS)).alias("targets"), F.bool_or(plain).alias("constrains"))
    whole_number = lambda c: F.when((F.size(c) == 1) & (F.get(c, F.lit(0))["o_kind"] == "literal") & F.get(c, F.lit(0))["o"].rlike(r"^(?:0|[1-9][0-9]{0,15})$"),
                                    F.get(c, F.lit(0))["o"].cast("bigint"))
    safe = lambda c: F.when(c <= 9007199254740991, c)
    node = node.withColumns({"minimum": safe(whole_number(F.col("mins"))), "maximum": safe(whole_number(F.col("maxs")))})
    shaped = F.array_contains("types", SH + "NodeShape"), F.array_contains("types", SH + "PropertyShape")
    node = stored(node.withColumns({
        "root": (F.col("s_kind") == "iri") & F.col("s").startswith(namespace) & (shaped[0] | shaped[1] | F.col("targets")),
        "container": shaped[0] & ~F.col("constrains"), "property_shape": shaped[1]}))
    held = stored(q.where(sh("property") & (F.col("o_kind") != "literal")).select("graph", F.col("s").alias("owner"), F.col("o").alias("node")).distinct())
    roots = node.where("root").select("graph", F.col("s").alias("owner"), "container")
    direct = held.join(roots.select("graph", "owner"), ["graph", "owner"], "left_semi").select("graph", "node", "owner", F.lit(True).alias("direct"))
    tracked = direct.unionByName(roots.where("not container").select("graph", F.col("owner").alias("node"), "owner", F.lit(False).alias("direct")))
    tracked = tracked.groupBy("graph", "node").agg(F.min("owner").alias("owner"), F.bool_or("direct").alias("direct"))

    severities = {SH + "Violation": "Violation", SH + "Warning": "Warning", SH + "Info": "Info"}
    named = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv])
    first = F.get("own", F.lit(0))
    own = F.when(F.size("own") == 0, F.lit(None)).when((F.size("own") == 1) & (first["o_kind"] == "iri"), F.coalesce(F.try_element_at(named, first["o"]), F.lit("?"))).otherwise(F.lit("?"))
    known = node.select("graph", F.col("s").alias("node"), F.coalesce(own, F.when(~F.col("holds"), "Violation")).alias("value"))
    settled = known.where("value is not null")
    below = held.join(known.where("value is null").select("graph", F.col("node").alias("owner")), ["graph", "owner"], "left_semi")
    seen = known.select("graph", "node", F.lit(True).alias("_seen"), F.col("value").alias("_v"))
    parts = below.join(seen, ["graph", "node"], "left").select("graph", F.col("owner").alias("node"), F.lit("worst").alias("kind"), F.lit(0).cast("bigint").alias("pos"),
                                                               F.col("node").alias("child"), F.when(F.col("_seen"), F.col("_v")).otherwise(F.lit("Violation")).alias("value"))
    worst = lambda kind, values: F.when(F.arrays_overlap(values, F.array(F.lit("?"), F.lit("Violation"))), "Violation").when(F.array_contains(values, "Warning"), "Warning").otherwise("Info")
    folded, _ = fold_up(parts, worst)
    severity = settled.unionByName(folded).select("graph", "node", F.when(F.col("value") != "?", F.col("value")).alias("severity"))

    banned = held.join(node.select("graph", F.col("s").alias("node"), F.col("maximum")), ["graph", "node"], "left").groupBy("graph", F.col("owner").alias("node")).agg(
        F.bool_and(F.coalesce(F.col("maximum") == 0, F.lit(False))).alias("all_banned"))
    members, heads = whole_lists(q)
    allowed = q.where(sh("in")).select("graph", F.col("s").alias("node"), F.col("o").alias("head")).join(members.where("value_kind = 'iri'"), ["graph", "head"]).groupBy("graph", "node").agg(
        F.collect_set("value").alias("allowed"))
    texts = path_texts(q, (members, heads))
    rows = tracked.join(node.drop("targets", "root", "container", "constrains").withColumnRenamed("s", "node"), ["graph", "node"], "left").join(severity, ["graph", "node"], "left").join(
        banned, ["graph", "node"], "left").join(allowed, ["graph", "node"], "left")
    path = F.when(F.size("paths") == 1, F.get("paths", F.lit(0)))
    rows = rows.withColumns({"_p": path["o"], "_pk": path["o_kind"]}).join(texts.select("graph", F.col("node").alias("_p"), F.col("path").alias("_text")), ["graph", "_p"], "left")
    written = F.when(F.col("_pk") == "iri", F.col("_p")).when(F.col("_p").isNotNull(), F.coalesce("_text", F.concat(F.lit("_:unsupported("), "_p", F.lit(")"))))
    nil = F.coalesce(F.exists("ins", lambda t: (t["o"] == RDF + "nil") & (t["o_kind"] == "iri")), F.lit(False))
    prohibits = F.coalesce(F.col("maximum") == 0, F.lit(False)) | nil | F.coalesce("all_banned", F.lit(False))
    # A held node that says nothing itself is a plain violation.
    grade = F.when(F.col("own").isNull(), F.lit("Violation")).otherwise(F.col("severity"))
    rows = rows.withColumns({"severity": grade, "_bans": prohibits})
    obligation = (F.when(F.col("severity") == "Info", "MAY").when(F.col("severity") == "Warning", F.when(F.col("_bans"), "SHOULD-NOT").otherwise("SHOULD"))
                  .otherwise(F.when(F.col("_bans"), "MUST-NOT").otherwise("MUST")))
    kind = F.when(F.col("property_shape"), "property-shape").when(F.col("direct"), "direct-property-constraint").otherwise("node-shape")
    none = F.array().cast("array<string>")
    return rows.select("graph", "node", kind.alias("kind"), "owner", F.coalesce("requirement_ids", none).alias("requirement_ids"), written.alias("path"), "minimum", "maximum",
                       F.coalesce("range", none).alias("range"), F.array_sort(F.array_union(F.coalesce("has", none), F.coalesce("allowed", none))).alias("vocabulary"), "severity", obligation.alias("obligation"))


def derive_cases(requirements: DataFrame, fixtures: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, links, faults): every fixture that a requirement names, in every executable profile that it declares.

    ``requirements``: requirement_id, positive_fixture_id, negative_fixture_id, profiles (array). ``fixtures``: fixture_id,
    expected (conforms, violates), sha256, profiles (array). ``profiles``: profile, kind; diagnostic ones do not run.

    ``cases``: case_id, fixture_id, profile, expected, sha256, requirements (a count); ``links``: case_id, requirement_id, one
    row each, as a fixture may serve any number of requirements. ``faults``: code, subject. Fixtures that repeat, are
    missing or expect another outcome than their role give no case.
    """
    named = lambda df, key: df.select(key, F.explode(F.array_distinct("profiles")).alias("profile"))
    runs = profiles.where(F.col("kind") != "diagnostic").select("profile").distinct()
    fault = lambda df, code, subject: df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject")).distinct()
    roles = F.array(F.struct(F.col("positive_fixture_id").alias("fixture_id"), F.lit("conforms").alias("role")), F.struct(F.col("negative_fixture_id").alias("fixture_id"), F.lit("violates").alias("role")))
    asked = requirements.select("requirement_id", F.explode(roles).alias("x")).select("requirement_id", "x.fixture_id", "x.role")
    absent = asked.where("fixture_id is null")
    counts = fixtures.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("_n"), F.first("expected").alias("expected"), F.first("sha256").alias("sha256"))
    joined = asked.where("fixture_id is not null").join(counts, "fixture_id", "left")
    good = joined.where((F.col("_n") == 1) & (F.col("role") == F.col("expected")))
    known = profiles.select("profile").distinct()
    of_fixture = named(fixtures, "fixture_id").join(runs, "profile", "left_semi")
    of_requirement = named(requirements, "requirement_id").join(runs, "profile", "left_semi")
    case_id = F.concat(F.lit("FULL-"), F.col("fixture_id"), F.lit("-"), F.upper("profile"))
    pairs = good.select("requirement_id", "fixture_id").distinct().join(of_fixture, "fixture_id").join(of_requirement, ["requirement_id", "profile"])
    links = pairs.select(case_id.alias("case_id"), "requirement_id", "fixture_id", "profile")
    served = links.groupBy("fixture_id", "profile").agg(F.count(F.lit(1)).alias("requirements"))
    used = good.select("fixture_id", "expected", "sha256").distinct()
    planned = used.join(of_fixture, "fixture_id")
    cases = planned.join(served, ["fixture_id", "profile"]).select(case_id.alias("case_id"), "fixture_id", "profile", "expected", "sha256", "requirements")
    outcome = links.join(used.select("fixture_id", "expected"), "fixture_id").groupBy("requirement_id").agg(
        F.bool_or(F.col("expected") == "conforms").alias("_yes"), F.bool_or(F.col("expected") == "violates").alias("_no"))
    covered = of_requirement.select("requirement_id").distinct().join(outcome, "requirement_id", "left")
    faults = [
        fault(absent, "FIXTURE_MISSING", "requirement_id"), fault(joined.where("_n is null"), "FIXTURE_UNKNOWN", "fixture_id"),
        fault(counts.where("_n > 1"), "FIXTURE_REPEATED", "fixture_id"), fault(joined.where("_n = 1 and role is distinct from expected"), "OUTCOME_MISMATCH", "fixture_id"),
        fault(named(fixtures, "fixture_id").unionByName(named(requirements, "requirement_id").withColumnRenamed("requirement_id", "fixture_id")).join(known, "profile", "left_anti"), "PROFILE_UNKNOWN", "profile"),
        fault(used.join(of_fixture.select("fixture_id"), "fixture_id", "left_anti"), "FIXTURE_WITHOUT_PROFILE", "fixture_id"),
        fault(planned.join(served, ["fixture_id", "profile"], "left_anti").withColumn("case_id", case_id), "CASE_WITHOUT_REQUIREMENT", "case_id"),
        fault(covered.where(~F.coalesce("_yes", F.lit(False))), "NO_POSITIVE_CASE", "requirement_id"), fault(covered.where(~F.coalesce("_no", F.lit(False))), "NO_NEGATIVE_CASE", "requirement_id")]
    found = faults[0]
    for f in faults[1:]:
        found = found.unionByName(f)
    return cases, links.select("case_id", "requirement_id"), found
