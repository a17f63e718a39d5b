"""Safety rules for public graphs, ontology consistency, register checks and road networks.

Each rule is a filter or join over quads that returns (graph, focus_node, path, value, code); values
that might be sensitive are replaced by their digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.functions.geo import parse_gml_point, parse_wkt
from dataward.functions.lexical import xsd_reason
from dataward.functions.lineage import stored
from dataward.functions.net import approved_host, blocked_iri_reason, decoded, host_of, unstable_url_reason
from dataward.functions.sensitive import sensitive_text
from dataward.operators.graph import RDF_TYPE, connected, rdf_list, superclasses

DCT, DCAT, OWL, RDFS = "http://purl.org/dc/terms/", "http://www.w3.org/ns/dcat#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
# Predicates, classes and namespaces of the public graph policy.
PERSONAL_PREDICATES = ("http://www.w3.org/2006/vcard/ns#bday", "http://xmlns.com/foaf/0.1/age", "http://xmlns.com/foaf/0.1/birthday",
                       "http://xmlns.com/foaf/0.1/familyName", "http://xmlns.com/foaf/0.1/givenName")
PERSONAL_CLASSES = ("http://www.w3.org/2006/vcard/ns#Individual", "http://www.w3.org/ns/prov#Person", "http://xmlns.com/foaf/0.1/Person",
                    "http://schema.org/Person", "https://schema.org/Person")
BANNED_PREDICATES = ("http://www.w3.org/2006/vcard/ns#hasTelephone",)
IMPORT_PREDICATES = (OWL + "imports", "http://www.w3.org/ns/shacl#shapesGraph")
PRIVATE_FRAGMENTS = ("approvalevidence", "credentialref", "evidenceid", "providerauthority", "sourcebindingref")
SCHEMA_CLASSES = (OWL + "Ontology", OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty",
                  "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property", "http://www.w3.org/ns/shacl#NodeShape", "http://www.w3.org/ns/shacl#PropertyShape")
SCHEMA_PREDICATES = (RDFS + "domain", RDFS + "range", RDFS + "subClassOf", RDFS + "subPropertyOf", OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "versionIRI", OWL + "versionInfo")
PUBLIC_NAMESPACES = (
    "http://data.europa.eu/930/", "http://data.europa.eu/r5r/", DCT, "http://purl.org/linked-data/sdmx/2009/attribute#", "http://spdx.org/rdf/terms#",
    "http://www.opengis.net/ont/geosparql#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", RDFS, OWL, "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2006/time#",
    "http://www.w3.org/2006/vcard/ns#", "http://www.w3.org/2011/content#", "http://www.w3.org/ns/adms#", DCAT, "http://www.w3.org/ns/dqv#", "http://www.w3.org/ns/locn#",
    "http://www.w3.org/ns/odrl/2/", "http://www.w3.org/ns/org#", "http://www.w3.org/ns/prov#", "http://www.w3.org/ns/sosa/", "http://www.w3.org/ns/ssn/",
    "http://xmlns.com/foaf/0.1/", "https://w3id.org/mobilitydcat-ap#")
GEO_NAMESPACES = ("http://data.europa.eu/930/", "http://www.opengis.net/ont/geosparql#")
GEO_TERMS = ("http://www.w3.org/ns/locn#geometry",)
PUBLIC_SCHEMES = ("http:", "https:", "mailto:")
WKT_LITERAL, GML_LITERAL = "http://www.opengis.net/ont/geosparql#wktLiteral", "http://www.opengis.net/ont/geosparql#gmlLiteral"


_FINDINGS = "array<struct<code: string, _node: string, _class: string>>"


def redacted(col: Column) -> Column:
    return F.concat(F.lit("[redacted:sha256:"), F.substring(F.sha2(col, 256), 1, 16), F.lit("]"))


def bounded(col: Column, limit: int) -> Column:
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(
        F.lit("[omitted:length:"), F.length(col).cast("string"), F.lit(":sha256:"), F.substring(F.sha2(col, 256), 1, 16), F.lit("]")))


def sanitize_value(df: DataFrame, col: str, out: str, limit: int = 20000) -> DataFrame:
    """Diagnostic form of a value: redacted when unsafe, a digest when too long, else unchanged."""
    scheme = F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0))
    staged = blocked_iri_reason(once(df, {"_sensitive": sensitive_text(F.col(col))}), col, "_blocked")
    unsafe = ((scheme != "") & ~scheme.isin("http:", "https:")) | F.col("_blocked").isNotNull() | F.col("_sensitive")
    return staged.withColumn(out, F.when(F.coalesce(unsafe, F.lit(False)), redacted(F.col(col))).otherwise(bounded(F.col(col), limit))).drop("_sensitive", "_blocked")


def _hit(rows: DataFrame, code, value: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return rows.select("graph", F.col("s").alias("focus_node"), F.col("p").alias("path"), (value if value is not None else F.lit(None)).cast("string").alias("value"), code.alias("code"))


def value_cap(q, limit, title_limit=100):
    cap = F.when(F.col("p").isin(DCT + "title", DCT + "description"), min(title_limit, limit)).otherwise(limit)
    many = q.groupBy("graph", "s", "p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cap", cap).where(F.col("_n") > F.col("_cap"))
    return _hit(many, "SEC-COMPLEXITY-001", F.concat(F.lit("[value count exceeds "), F.col("_cap").cast("string"), F.lit("]")))


def personal_terms(q):
    return _hit(q.where(F.col("p").isin(*PERSONAL_PREDICATES) | ((F.col("p") == RDF_TYPE) & F.col("o").isin(*PERSONAL_CLASSES))), "SEC-PUBLIC-005", redacted(F.col("o")))


def banned_predicates(q):
    return _hit(q.where(F.col("p").isin(*BANNED_PREDICATES)), "SEC-PUBLIC-007", redacted(F.col("o")))


def profile_alias(q, profile_iri):
    """Profile markers that name the profile by any other spelling than its canonical IRI."""
    import re
    host = re.match(r"https?://([^/]+)", profile_iri).group(1)
    tail = profile_iri.split(host, 1)[1]
    path = F.regexp_extract("o", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    family = (host_of(F.col("o")) == host) & decoded(path).rlike("^" + re.escape(tail) + r"(?:/|$)")
    canonical = F.col("o").rlike("^" + re.escape(profile_iri) + r"(?:/[^?#]*)?$")
    return _hit(q.where((F.col("p") == DCT + "conformsTo") & (F.col("o_kind") == "iri") & family & ~canonical), "PROFILE-MARKER-003", redacted(F.col("o")))


def unstable_urls(q, hosts):
    return _hit(q.where((F.col("o_kind") == "iri") & unstable_url_reason(F.col("p"), F.col("o"), hosts).isNotNull()), "SEC-PUBLIC-006", redacted(F.col("o")))


def dynamic_imports(q):
    return _hit(q.where(F.col("p").isin(*IMPORT_PREDICATES)), "SEC-PUBLIC-001", redacted(F.col("o")))


def predicate_namespaces(q, extra=()):
    known = reduce(lambda a, b: a | b, [F.col("p").startswith(n) for n in (*PUBLIC_NAMESPACES, *extra)])
    return _hit(q.where(~known), "SEC-PUBLIC-002")


def private_predicates(q):
    named = reduce(lambda a, b: a | b, [F.contains(F.lower("p"), F.lit(f)) for f in PRIVATE_FRAGMENTS])
    return _hit(q.where(named), "SEC-PUBLIC-001", redacted(F.col("o")))


def _iris(q):
    """Each IRI of a statement, with the place it stands in."""
    places = F.array(F.struct(F.lit("s").alias("place"), F.when(F.col("s_kind") == "iri", F.col("s")).alias("iri")), F.struct(F.lit("p").alias("place"), F.col("p").alias("iri")),
                     F.struct(F.lit("o").alias("place"), F.when(F.col("o_kind") == "iri", F.col("o")).alias("iri")), F.struct(F.lit("d").alias("place"), F.col("datatype").alias("iri")))
    return q.select("graph", "s", "p", "o", F.explode(places).alias("x")).select("graph", "s", "p", "o", "x.place", "x.iri").where(F.col("iri").isNotNull())


def role_mailbox_ok(q, allowed, mailbox_predicate, contact_predicate, contact_class):
    """Mailbox statements whose subject is an institutional contact and whose address is allowed."""
    mail = q.where((F.col("p") == mailbox_predicate) & F.col("o").isin(allowed))
    contacts = q.where(F.col("p") == contact_predicate).select("graph", F.col("o").alias("s")).distinct()
    typed = q.where((F.col("p") == RDF_TYPE) & (F.col("o") == contact_class)).select("graph", "s").distinct()
    return mail.join(contacts, ["graph", "s"], "left_semi").join(typed, ["graph", "s"], "left_semi")


def iri_policy(q, hosts, mailboxes=None):
    """IRIs that are relative, use another scheme, name an unapproved host or are blocked.

    Each distinct IRI is judged once and the verdict joined back, so a term used in a third of all
    statements costs one check. Verdicts are stored, so that the join goes by their number.
    """
    iris = _iris(q)
    known = blocked_iri_reason(iris.select("iri").distinct(), "iri")
    scheme = F.lower(F.regexp_extract("iri", r"^[A-Za-z][A-Za-z0-9+.-]*:", 0))
    relative = scheme == ""
    refused = ~relative & (~scheme.isin(*PUBLIC_SCHEMES) | (scheme == "mailto:") | ~approved_host(F.col("iri"), hosts) | F.col("blocked_reason").isNotNull())
    verdict = F.when(relative, "SEC-PUBLIC-004").when(F.coalesce(refused, F.lit(True)), "SEC-PUBLIC-001")
    judged = stored(once(known, {"code": verdict}).select("iri", "code").where(F.col("code").isNotNull()))
    rows = iris.join(judged, "iri")
    if mailboxes is not None:
        ok = mailboxes.select("graph", "s", "p", F.col("o").alias("iri"), F.lit("o").alias("place")).distinct()
        rows = rows.join(ok, ["graph", "s", "p", "iri", "place"], "left_anti")
    return _hit(rows, F.col("code"), redacted(F.col("iri")))


def sensitive_statements(q, mailboxes=None):
    """Secrets or personal data in IRIs and literals; each distinct text is folded and tested once."""
    texts = _iris(q).select("graph", "s", "p", F.col("iri").alias("text"), "place").unionByName(
        q.where(F.col("o_kind") == "literal").select("graph", "s", "p", F.col("o").alias("text"), F.lit("l").alias("place")))
    found = stored(once(texts.select("text").distinct(), {"_hit": sensitive_text(F.col("text"))}).where("_hit").select("text"))
    rows = texts.join(found, "text")
    if mailboxes is not None:
        rows = rows.join(mailboxes.select("graph", "s", "p", F.col("o").alias("text"), F.lit("o").alias("place")).distinct(), ["graph", "s", "p", "text", "place"], "left_anti")
    return _hit(rows, "SEC-PUBLIC-005", redacted(F.col("text"))).distinct()


def geometry_literals(q):
    place = F.when(F.col("p").isin(DCAT + "bbox", DCAT + "centroid"), "GEO-ENCODING-003").when(F.col("p") == "http://www.w3.org/ns/locn#geometry", "GEO-ENCODING-004")
    wkt = q.where((F.col("datatype") == WKT_LITERAL) & parse_wkt(F.col("o")).isNull())
    gml = q.where((F.col("datatype") == GML_LITERAL) & parse_gml_point(F.col("o")).isNull())
    return _hit(wkt, F.coalesce(place, F.lit("GEO-ENCODING-001")), bounded(F.col("o"), 4096)).unionByName(
        _hit(gml, F.coalesce(place, F.lit("GEO-ENCODING-002")), bounded(F.col("o"), 4096)))


def xsd_literals(q):
    return _hit(q.where((F.col("o_kind") == "literal") & xsd_reason(F.col("o"), F.col("datatype")).isNotNull()), "SEM-DATATYPE-001", xsd_reason(F.col("o"), F.col("datatype")))


def literal_length(q, limit):
    return _hit(q.where((F.col("o_kind") == "literal") & (F.length("o") > limit)), "SEC-PUBLIC-001", F.concat(F.lit("[literal length "), F.length("o").cast("string"), F.lit("]")))


def schema_boundary(q):
    return _hit(q.where(((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri") & F.col("o").isin(*SCHEMA_CLASSES)) | F.col("p").isin(*SCHEMA_PREDICATES)), "SEM-DATASET-BOUNDARY-001", bounded(F.col("o"), 4096))


def scoped_key_unique(q):
    """Datasets that share (publisher, identifier) with another; the first by name is not reported.

    Grouped by key with a combinable minimum, so many datasets under one key are never paired. No side of these joins
    is small where the graph is large, though a filter on a compressed file may look so.
    """
    datasets = q.where((F.col("p") == RDF_TYPE) & (F.col("o") == DCAT + "Dataset")).select("graph", "s").distinct()
    publisher = q.where((F.col("p") == DCT + "publisher") & (F.col("o_kind") == "iri")).select("graph", "s", F.col("o").alias("_publisher"))
    identifier = q.where((F.col("p") == DCT + "identifier") & (F.col("o_kind") == "literal")).select("graph", "s", F.col("o").alias("_identifier"))
    keys = datasets.join(publisher.hint("merge"), ["graph", "s"]).join(identifier.hint("merge"), ["graph", "s"]).distinct()
    firsts = keys.groupBy("graph", "_publisher", "_identifier").agg(F.min("s").alias("_first"), F.max("s").alias("_last")).where(F.col("_first") != F.col("_last"))
    rows = keys.join(firsts.hint("merge"), ["graph", "_publisher", "_identifier"]).where(F.col("s") != F.col("_first")).withColumn("p", F.lit(DCT + "identifier"))
    return _hit(rows, "DS-ID-UNIQUE-001", F.col("_identifier"))


def profile_routing(q, exact=()):
    """One finding per subject of a core graph that uses spatial terms."""
    geo = lambda c: reduce(lambda a, b: a | b, [c.startswith(n) for n in GEO_NAMESPACES]) | c.isin(*GEO_TERMS, *exact)
    coverage = (F.col("o_kind") == "literal") & F.col("p").isin(DCAT + "bbox", DCAT + "centroid") & F.col("datatype").isin(WKT_LITERAL, GML_LITERAL)
    uses = (F.coalesce(geo(F.col("s")) & (F.col("s_kind") == "iri"), F.lit(False)) | geo(F.col("p"))
            | F.coalesce(geo(F.col("o")) & (F.col("o_kind") == "iri"), F.lit(False)) | F.coalesce(geo(F.col("datatype")) & ~coverage, F.lit(False)))
    first = q.where(uses).groupBy("graph", "s").agg(F.min("p").alias("p"))
    return _hit(first, "PROFILE-SELECTION-001")


def scan_public_graph(q: DataFrame, policy: dict) -> DataFrame:
    """All safety rules, distinct findings. ``policy``: hosts, stable_hosts, max_values,
    max_literal_length, profile_iri, extra_namespaces, and optionally mailbox settings. The statements are stored
    once, as every rule reads them."""
    q = stored(q)
    mail = role_mailbox_ok(q, **policy["mailboxes"]) if policy.get("mailboxes") else None
    frames = [
        value_cap(q, policy["max_values"]), personal_terms(q), banned_predicates(q), profile_alias(q, policy["profile_iri"]), unstable_urls(q, policy["stable_hosts"]),
        dynamic_imports(q), predicate_namespaces(q, policy.get("extra_namespaces", ())), private_predicates(q), iri_policy(q, policy["hosts"], mail), sensitive_statements(q, mail),
        geometry_literals(q), xsd_literals(q), literal_length(q, policy["max_literal_length"]), schema_boundary(q), scoped_key_unique(q)]
    return reduce(DataFrame.unionByName, frames).distinct()


def portal_defects(q: DataFrame, profile_iri: str) -> DataFrame:
    """(graph, defects): the defect codes of each harvested graph, one pass of flags."""
    from dataward.functions.lexical import xsd_valid
    c, lit = F.col, F.col("o_kind") == "literal"
    some = lambda cond: F.bool_or(F.coalesce(cond, F.lit(False)))
    focus = (c("p") == RDF_TYPE) & c("o").isin(DCAT + "Catalog", DCAT + "CatalogRecord")
    marked = q.where((c("p") == DCT + "conformsTo") & (c("o") == profile_iri)).select("graph", "s").distinct()
    focuses = q.where(focus).select("graph", "s").distinct()
    unmarked = focuses.join(marked, ["graph", "s"], "left_anti").select("graph", F.lit(True).alias("_unmarked")).distinct()
    rules = {
        "PDP-LANG-KR": F.lower("lang") == "kr", "PDP-XSD-DATE-LEXICAL": lit & (c("datatype") == XSD + "date") & ~xsd_valid(c("o"), c("datatype")),
        "PDP-LITERAL-THEME": lit & (c("p") == DCAT + "theme"), "PDP-LITERAL-FREQUENCY": lit & (c("p") == DCT + "accrualPeriodicity"), "PDP-WRONG-FORMAT-PREDICATE": c("p") == DCAT + "format",
        "PDP-EMPTY-MEDIA-TYPE": lit & (c("p") == DCAT + "mediaType") & (F.trim("o") == ""), "PDP-BLANK-PUBLISHER": (c("p") == DCT + "publisher") & (c("o_kind") == "bnode"),
        "PDP-BLANK-CATALOG": (c("p") == RDF_TYPE) & (c("o") == DCAT + "Catalog") & (c("s_kind") == "bnode"), "PDP-COMBINED-KEYWORDS": lit & (c("p") == DCAT + "keyword") & F.contains("o", F.lit(","))}
    flags = q.groupBy("graph").agg(*[some(r).alias(n) for n, r in rules.items()], some(focus).alias("_has_focus")).join(unmarked, "graph", "left")
    no_marker = ~c("_has_focus") | F.coalesce("_unmarked", F.lit(False))
    codes = F.array_compact(F.array(*[F.when(c(f"`{n}`"), F.lit(n)) for n in rules], F.when(no_marker, F.lit("PDP-PROFILE-MARKER-MISSING"))))
    return flags.select("graph", F.array_sort(codes).alias("defects"))


# --- ontology consistency --------------------------------------------------------------------

def _subjects(q, cls):
    return q.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select(F.col("s").alias("term")).distinct()


def domain_range(ontology: DataFrame, data: DataFrame, namespace: str) -> DataFrame:
    """(code, predicate, s, o): local statements that break the declared kind, domain or range.

    What a property declares is one row, so statements meet it once: what it tells by itself becomes codes, and what hangs
    on a class of a node becomes rows that all meet the instances in one join.
    """
    c, iri = F.col, F.col("o_kind") == "iri"
    kind = F.when(c("p") == RDF_TYPE, F.when(c("o").isin(*[OWL + k for k in ("AnnotationProperty", "ObjectProperty", "DatatypeProperty")]), F.substring("o", len(OWL) + 1, 30)))
    named = lambda p: F.when((c("p") == RDFS + p) & iri, F.struct(c("o").alias("cls")))
    declared = ontology.where(kind.isNotNull() | (c("p").isin(RDFS + "domain", RDFS + "range") & iri)).groupBy(c("s").alias("p")).agg(
        F.min(kind).alias("kind"), F.collect_set(named("domain")).alias("domains"), F.collect_set(named("range")).alias("ranges")).where("kind is not null")
    subclass = ontology.where((F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass")) & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    up = superclasses(subclass)
    types = data.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")).select(F.col("s").alias("_node"), F.col("o").alias("a")).distinct()
    # A node is an instance of its types and of all classes above them.
    instance = types.join(up, "a", "left").select("_node", F.explode(F.array_compact(F.array("a", "b"))).alias("_class")).distinct()

    none = F.lit(None).cast("string")
    finding = lambda code, node, cls: F.struct(F.lit(code).alias("code"), node.alias("_node"), cls.alias("_class"))
    # A finding without a class meets no instance; a digest in place of the node spreads such findings over tasks.
    when = lambda condition, code: F.array_compact(F.array(F.when(condition, finding(code, F.xxhash64("p", "s", "o").cast("string"), none))))
    needs = lambda condition, classes, code, node: F.when(condition, F.transform(
        F.filter(classes, lambda x: x["cls"] != RDFS + "Resource"), lambda x: finding(code, node, x["cls"])))
    literal = c("o_kind") == "literal"
    obj, dat = c("kind") == "ObjectProperty", c("kind") == "DatatypeProperty"
    good_obj, good_dat = obj & ~literal, dat & literal
    actual = F.when(F.col("lang").isNotNull(), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(F.coalesce("datatype", F.lit(XSD + "string")))
    bad = F.coalesce(xsd_reason(F.col("o"), F.col("datatype")).isNotNull(), F.lit(False))
    parts = [
        when(c("kind").isNull(), "UNDECLARED_LOCAL_PROPERTY"), when((obj | dat) & (F.size("domains") == 0), "PROPERTY_DOMAIN_MISSING"),
        when(obj & literal, "OBJECT_PROPERTY_LITERAL"), when(dat & ~literal, "DATATYPE_PROPERTY_RESOURCE"), when((good_obj | good_dat) & (F.size("ranges") == 0), "PROPERTY_RANGE_MISSING"),
        when(good_dat & F.exists("ranges", lambda x: (c("_actual") != x["cls"]) | c("_bad")), "DATATYPE_RANGE_MISMATCH"),
        needs(obj | dat, c("domains"), "DOMAIN_TYPE_MISMATCH", c("s")), needs(good_obj, c("ranges"), "RANGE_TYPE_MISMATCH", c("o"))]
    rows = once(data.where(F.col("p").startswith(namespace)).join(declared, "p", "left"), {"_actual": actual, "_bad": F.when(good_dat, bad)})
    found = rows.select("p", "s", "o", F.explode(F.concat(*[F.coalesce(x, F.array().cast(_FINDINGS)) for x in parts])).alias("x")).select(
        "x.code", F.col("p").alias("predicate"), "s", "o", "x._node", "x._class")
    return found.join(instance, ["_node", "_class"], "left_anti").select("code", "predicate", "s", "o").distinct()


def disjoint_pairs(q: DataFrame, relation: str, group_class: str) -> DataFrame:
    """(left, right) pairs declared disjoint, directly or as members of a list."""
    direct = q.where(F.col("p") == relation).select(F.col("s").alias("left"), F.col("o").alias("right"))
    groups = _subjects(q, group_class)
    heads = q.where(F.col("p") == OWL + "members").join(groups.withColumnRenamed("term", "s"), "s", "left_semi").select("graph", F.col("o").alias("head"))
    members, _ = rdf_list(q)
    listed = members.join(heads, ["graph", "head"], "left_semi")
    return direct, listed


def _beside_least(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Keys, left (the least member of a group) and right (each of its other members)."""
    least = rows.groupBy(*keys).agg(F.min(member).alias("left"), F.max(member).alias("_most")).where("left != _most").drop("_most")
    return rows.join(least, keys).where(F.col(member) != F.col("left")).select(*keys, "left", F.col(member).alias("right"))


def disjoint_instances(q: DataFrame) -> DataFrame:
    """(code, s, left, right): resources typed as two disjoint classes.

    A resource with several types from one list has a row for each of them but the least, next to the least:
    all are named, and none are paired with each other.
    """
    direct, listed = disjoint_pairs(q, OWL + "disjointWith", OWL + "AllDisjointClasses")
    types = q.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("cls")).distinct()
    left = direct.join(types.withColumnRenamed("cls", "left"), "left")
    both = left.join(types.withColumnRenamed("cls", "right"), ["s", "right"]).select("s", "left", "right")
    held = types.join(listed.select("graph", "head", F.col("value").alias("cls")).distinct(), "cls")
    in_list = _beside_least(held, ["s", "graph", "head"], "cls").select("s", "left", "right")
    return both.unionByName(in_list).distinct().select(F.lit("DISJOINT_CLASS_INSTANCE").alias("code"), "s", "left", "right")


def disjoint_properties(q: DataFrame) -> DataFrame:
    """(code, s, left, right): subject and value connected by two disjoint properties."""
    direct, listed = disjoint_pairs(q, OWL + "propertyDisjointWith", OWL + "AllDisjointProperties")
    uses = q.select("s", "o", "o_kind", F.col("p").alias("prop")).distinct()
    left = direct.join(uses.withColumnRenamed("prop", "left"), "left")
    both = left.join(uses.withColumnRenamed("prop", "right"), ["s", "o", "o_kind", "right"]).select("s", "left", "right")
    held = uses.join(listed.select("graph", "head", F.col("value").alias("prop")).distinct(), "prop")
    in_list = _beside_least(held, ["s", "o", "o_kind", "graph", "head"], "prop").select("s", "left", "right")
    return both.unionByName(in_list).distinct().select(F.lit("DISJOINT_PROPERTY_ASSERTION").alias("code"), "s", "left", "right")


def same_and_different(q: DataFrame) -> DataFrame:
    """(code, s, left, right): pairs declared both the same and different, in either direction."""
    pair = lambda p: q.where(F.col("p") == OWL + p).select(F.least("s", "o").alias("left"), F.greatest("s", "o").alias("right")).distinct()
    return pair("differentFrom").join(pair("sameAs"), ["left", "right"]).select(F.lit("SAME_AND_DIFFERENT_RESOURCE").alias("code"), F.col("left").alias("s"), "left", "right")


def schema_findings(ontology: DataFrame, namespace: str) -> DataFrame:
    """(code, term, other): imports, property kind conflicts, missing or wrong domain and range,
    prohibited equivalence, equivalent-and-disjoint terms, bad deprecation markers."""
    c = F.col
    out = lambda df, code, term="term", other=None: df.select(F.lit(code).alias("code"), c(term).alias("term"), (c(other) if other else F.lit(None)).cast("string").alias("other"))
    local = lambda k: _subjects(ontology, OWL + k).where(c("term").startswith(namespace))
    objs, dats = local("ObjectProperty"), local("DatatypeProperty")
    props = objs.unionByName(dats).distinct()
    spec = lambda p: ontology.where((c("p") == RDFS + p) & (c("o_kind") == "iri")).select(c("s").alias("term"), c("o").alias("other")).distinct()
    custom = _subjects(ontology, RDFS + "Datatype").select(c("term").alias("other"), F.lit(True).alias("_custom"))
    plain = c("other").startswith(XSD) | c("other").isin(RDFS + "Literal", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
    ranged = spec("range").join(custom, "other", "left").withColumn("_dt", plain | F.coalesce("_custom", F.lit(False)))
    equiv = ontology.where(c("p").isin(OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "sameAs"))
    frames = [
        out(ontology.where(c("p") == OWL + "imports").select(c("s").alias("term"), c("o").alias("other")), "OWL_IMPORTS_PROHIBITED", other="other"),
        out(objs.join(dats, "term", "left_semi"), "PROPERTY_KIND_CONTRADICTION"),
        out(props.join(spec("domain"), "term", "left_anti"), "PROPERTY_DOMAIN_MISSING"), out(props.join(spec("range"), "term", "left_anti"), "PROPERTY_RANGE_MISSING"),
        out(props.join(spec("domain").where(plain), "term"), "PROPERTY_DOMAIN_NOT_CLASS", other="other"),
        out(objs.join(ranged.where("_dt"), "term"), "OBJECT_PROPERTY_DATATYPE_RANGE", other="other"), out(dats.join(ranged.where(~c("_dt")), "term"), "DATATYPE_PROPERTY_RESOURCE_RANGE", other="other"),
        out(equiv.where(c("s").startswith(namespace) | c("o").startswith(namespace)).select(c("s").alias("term"), c("o").alias("other")), "LOCAL_EQUIVALENCE_PROHIBITED", other="other")]
    for eq, relation, group, code in ((OWL + "equivalentClass", OWL + "disjointWith", OWL + "AllDisjointClasses", "EQUIVALENT_DISJOINT_CLASS"),
                                      (OWL + "equivalentProperty", OWL + "propertyDisjointWith", OWL + "AllDisjointProperties", "EQUIVALENT_DISJOINT_PROPERTY")):
        parts = connected(ontology.where(c("p") == eq).select(c("s").alias("a"), c("o").alias("b")))
        direct, listed = disjoint_pairs(ontology, relation, group)
        comp = lambda n: parts.select(c("node").alias(n), c("component").alias(f"_{n}"))
        hit = direct.join(comp("left"), "left", "left").join(comp("right"), "right", "left").where(
            (c("left") == c("right")) | (c("_left") == c("_right"))).select(c("left").alias("term"), c("right").alias("other"))
        in_list = _beside_least(listed.select("graph", "head", "value").distinct().join(comp("value"), "value"), ["graph", "head", "_value"], "value").select(
            c("left").alias("term"), c("right").alias("other"))
        frames.append(out(hit.unionByName(in_list).distinct(), code, other="other"))
    marker = ontology.where(c("p") == OWL + "deprecated")
    fine = (c("o_kind") == "literal") & (c("datatype") == XSD + "boolean") & c("o").isin("true", "false", "1", "0")
    frames.append(out(marker.where(~F.coalesce(fine, F.lit(False))).select(c("s").alias("term"), c("o").alias("other")), "DEPRECATED_MARKER_INVALID", other="other"))
    return reduce(DataFrame.unionByName, frames).distinct()


def deprecated_use(data: DataFrame, deprecated: DataFrame) -> DataFrame:
    """(code, term, s): deprecated terms used as class, property or resource."""
    term = deprecated.select("term").distinct()
    as_class = data.where(F.col("p") == RDF_TYPE).select(F.col("o").alias("term"), "s").join(term, "term", "left_semi").select(F.lit("DEPRECATED_CLASS").alias("code"), "term", "s")
    as_prop = data.select(F.col("p").alias("term"), "s").join(term, "term", "left_semi").select(F.lit("DEPRECATED_PROPERTY").alias("code"), "term", "s")
    places = data.select(F.col("s").alias("term"), "s").unionByName(data.where((F.col("p") != RDF_TYPE) & (F.col("o_kind") != "literal")).select(F.col("o").alias("term"), "s"))
    as_node = places.join(term, "term", "left_semi").select(F.lit("DEPRECATED_RESOURCE").alias("code"), "term", "s")
    return as_class.unionByName(as_prop).unionByName(as_node).distinct()


def term_governance(register: DataFrame, ontology: DataFrame, evidence: DataFrame) -> DataFrame:
    """(term, code): register rows against ontology terms: presence, repeats, every compared column,
    evidence links and the register's order.

    Both sides: term, kind, domain, range, status, version, replaced_by. The register adds evidence_ids
    and row_no.
    """
    compared = {"kind": "KIND_MISMATCH", "domain": "DOMAIN_MISMATCH", "range": "RANGE_MISMATCH", "status": "STATUS_MISMATCH", "version": "VERSION_MISMATCH", "replaced_by": "REPLACEMENT_MISMATCH"}
    from dataward.functions.skew import neighbour
    repeats = register.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("term", F.lit("TERM_DUPLICATE").alias("code"))
    r = register.select("term", F.lit(True).alias("_r"), *[F.col(c).alias("_r_" + c) for c in compared])
    o = ontology.select("term", F.lit(True).alias("_o"), *[F.col(c).alias("_o_" + c) for c in compared])
    j = r.join(o, "term", "full_outer")
    codes = F.array_compact(F.array(
        F.when(F.col("_r").isNull(), F.lit("TERM_NOT_REGISTERED")), F.when(F.col("_o").isNull(), F.lit("TERM_NOT_IN_ONTOLOGY")),
        *[F.when(F.col("_r") & F.col("_o") & ~F.col("_r_" + c).eqNullSafe(F.col("_o_" + c)), F.lit(code)) for c, code in compared.items()],
        F.when(F.col("_r") & (F.col("_r_status") == "deprecated") & F.col("_r_replaced_by").isNull(), F.lit("DEPRECATION_WITHOUT_REPLACEMENT"))))
    drift = j.select("term", F.explode(codes).alias("code")).distinct()
    links = register.select("term", F.explode("evidence_ids").alias("evidence_id"))
    dangling = links.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("term", F.lit("EVIDENCE_UNKNOWN").alias("code")).distinct()
    bare = register.where(F.size("evidence_ids") == 0).select("term", F.lit("EVIDENCE_MISSING").alias("code"))
    near = neighbour(register.select("term", "row_no", F.lit(1).alias("_all"), F.floor(F.col("row_no") / 65536).alias("_block")), ["_all"], ["row_no"], F.col("_block"), {"_before": F.col("term")})
    order = near.where(F.col("term") < F.col("_before")).select("term", F.lit("ORDER_INVALID").alias("code"))
    return reduce(DataFrame.unionByName, [repeats, drift, dangling, bare, order])


def vocabulary_registry(q: DataFrame, sources: DataFrame) -> DataFrame:
    """Concepts of many vocabularies as one register, with fallbacks and a repeat flag.

    ``sources``: graph, category, default_status, default_date.
    """
    skos = "http://www.w3.org/2004/02/skos/core#"
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    concepts = q.groupBy("graph", "s").agg(
        F.bool_or((F.col("p") == RDF_TYPE) & (F.col("o") == skos + "Concept")).alias("_concept"), pick(skos + "notation").alias("_notation"), pick(skos + "prefLabel").alias("label"),
        pick(OWL + "deprecated").alias("_deprecated"), pick("http://www.w3.org/ns/adms#status").alias("_status"), pick(DCT + "issued").alias("_issued"), pick(DCT + "modified").alias("_modified")).where("_concept")
    last = F.element_at(F.split("s", "[/#:]"), -1)
    rows = concepts.join(sources, "graph").select(
        "category", F.col("s").alias("concept"), F.coalesce("_notation", last).alias("notation"), "label",
        F.when(F.col("_deprecated").isin("true", "1"), "deprecated").otherwise(F.coalesce(F.element_at(F.split("_status", "[/#]"), -1), "default_status")).alias("status"),
        F.coalesce("_modified", "_issued", "default_date").alias("dated"))
    repeats = rows.groupBy("category", "notation").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(repeats, ["category", "notation"]).withColumn("repeated", F.col("_n") > 1).drop("_n")


# --- registers -------------------------------------------------------------------------------

def verify_crosswalk(rows: DataFrame, requirements: DataFrame, cases: DataFrame) -> DataFrame:
    """(row_id, code): crosswalk rows against requirements and fixtures.

    ``rows``: row_no, row_id, requirement_ids (text split by ';'), case_ids, projection; ``requirements``:
    requirement_id, projection, evidence_ids; ``cases``: case_id, evidence_id.
    """
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    reqs = rows.select("row_id", F.explode(split(F.col("requirement_ids"))).alias("requirement_id"))
    used = rows.select("row_id", F.explode(split(F.col("case_ids"))).alias("case_id"))
    out = lambda df, code: df.select("row_id", F.lit(code).alias("code")).distinct()
    unknown_req = out(reqs.join(requirements, "requirement_id", "left_anti"), "REQUIREMENT_UNKNOWN")
    unknown_case = out(used.join(cases, "case_id", "left_anti"), "CASE_UNKNOWN")
    repeated = out(reqs.groupBy("row_id", "requirement_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1), "REQUIREMENT_REPEATED")
    # Set equality per row as two anti joins, so no set is ever collected.
    wanted = reqs.join(requirements.select("requirement_id", F.explode("evidence_ids").alias("evidence_id")), "requirement_id").select("row_id", "evidence_id").distinct()
    given = used.join(cases, "case_id").select("row_id", "evidence_id").distinct()
    differing = out(wanted.join(given, ["row_id", "evidence_id"], "left_anti").unionByName(given.join(wanted, ["row_id", "evidence_id"], "left_anti")), "EVIDENCE_SET_MISMATCH")
    drift = out(reqs.join(requirements, "requirement_id").join(rows.select("row_id", F.col("projection").alias("_own")), "row_id").where(~F.col("_own").eqNullSafe(F.col("projection"))), "PROJECTION_DRIFT")
    sequence = out(rows.where(F.col("row_id") != F.format_string("XW-%06d", F.col("row_no"))), "ID_SEQUENCE")
    empty = out(rows.where(F.size(split(F.col("requirement_ids"))) == 0), "REQUIREMENT_MISSING")
    return reduce(DataFrame.unionByName, [unknown_req, unknown_case, repeated, differing, drift, sequence, empty])


# --- road networks ---------------------------------------------------------------------------

NODE_ID = r"^[0-9]{10}$"
HISTORY = r"^(?:NODE|LINK)[0-9]{4}$"
EDITION_KEY = ["network_authority", "network_identifier", "network_version"]


def node_link_findings(nodes: DataFrame, links: DataFrame, node_pattern: str = NODE_ID, link_pattern: str = NODE_ID, history: str = HISTORY) -> DataFrame:
    """(element, code): malformed nodes and links, and links whose ends are no known node."""
    bad_node = nodes.where(~(F.col("node_id").rlike(node_pattern) & F.col("hist_type").rlike(history))).select(F.col("node_id").alias("element"), F.lit("NODE_INVALID").alias("code"))
    fine = (F.col("link_id").rlike(link_pattern) & F.col("f_node").rlike(node_pattern) & F.col("t_node").rlike(node_pattern) & F.col("hist_type").rlike(history) & F.col("hist_remark").rlike(node_pattern))
    bad_link = links.where(~F.coalesce(fine, F.lit(False))).select(F.col("link_id").alias("element"), F.lit("LINK_INVALID").alias("code"))
    ends = links.select("link_id", F.explode(F.array("f_node", "t_node")).alias("node_id"))
    loose = ends.join(nodes.select("node_id"), "node_id", "left_anti").select(F.col("link_id").alias("element"), F.lit("ENDPOINT_MISSING").alias("code")).distinct()
    return reduce(DataFrame.unionByName, [bad_node, bad_link, loose])


def edition_findings(ed: DataFrame, statuses: list[str], successor_statuses: list[str]) -> DataFrame:
    """Editions with the first rule they break: form, lifecycle, repeats, and their successor.

    ``replacement_key`` is the JSON array of the successor's three key parts.
    """
    c = F.col
    key = F.to_json(F.array(*EDITION_KEY))
    rows = ed.withColumn("_key", key)
    by_key = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("checksum").alias("_sums"))
    succ = rows.groupBy("_key").agg(F.min(F.struct(*EDITION_KEY, "status", "valid_from")).alias("_s")).withColumnRenamed("_key", "replacement_key")
    j = rows.join(by_key, "_key").join(succ, "replacement_key", "left")
    has = c("replacement_key").isNotNull()
    blank = lambda n: c(n).isNull() | (F.trim(c(n)) != c(n)) | (c(n) == "")
    rules = [
        (reduce(lambda a, b: a | b, [blank(k) for k in EDITION_KEY]), "NETWORK_IDENTITY_FIELD_INVALID"),
        (~F.coalesce(c("checksum").rlike("^[a-f0-9]{64}$"), F.lit(False)), "NETWORK_CHECKSUM_INVALID"), (~F.coalesce(c("status").isin(statuses), F.lit(False)), "NETWORK_LIFECYCLE_STATUS_INVALID"),
        (c("valid_from").isNull(), "NETWORK_DATE_INVALID"), (c("valid_from") > c("valid_until"), "NETWORK_VALIDITY_INTERVAL_INVALID"),
        (c("status").isin("superseded", "withdrawn") & c("valid_until").isNull(), "NETWORK_TERMINAL_VALIDITY_INVALID"), ((c("status") == "superseded") & ~has, "NETWORK_TERMINAL_REPLACEMENT_INVALID"),
        (c("status").isin("candidate", "current", "withdrawn") & has, "NETWORK_ACTIVE_REPLACEMENT_INVALID"), (c("_sums") > 1, "NETWORK_IDENTITY_CHECKSUM_CONFLICT"), (c("_n") > 1, "NETWORK_IDENTITY_DUPLICATE"),
        (has & c("_s").isNull(), "NETWORK_REPLACEMENT_NOT_FOUND"),
        (has & ((c("_s.network_authority") != c("network_authority")) | (c("_s.network_identifier") != c("network_identifier")) | (c("_s.network_version") == c("network_version"))), "NETWORK_REPLACEMENT_IDENTITY_INVALID"),
        (has & ~c("_s.status").isin(successor_statuses), "NETWORK_LIFECYCLE_TRANSITION_INVALID"), (has & (c("valid_until").isNull() | (c("valid_until") >= c("_s.valid_from"))), "NETWORK_REPLACEMENT_VALIDITY_OVERLAP")]
    code = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        code = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(code)
    return j.select(*ed.columns, code.alias("code"))
