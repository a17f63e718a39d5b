"""Safety rules, ontology checks, registers, road networks, addresses and geometry."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from dataward.functions import geo, net
from dataward.functions import sensitive as X
from dataward.operators import graph_rules as R
from dataward.operators.graph import RDF, RDF_TYPE
from dataward.plans.graph import EX, XSD, iri, statements
from dataward.plans.registry import query
from dataward.plans.text import PERSONAL, SECRETS, quoted
from dataward.sources.tables import table

BASE = "https://data.example.org/"
HOSTS = ["data.example.org", "www.w3.org", "purl.org", "xmlns.com", "www.opengis.net"]
POLICY = {"hosts": HOSTS, "stable_hosts": ["data.example.org"], "max_values": 2, "max_literal_length": 40, "profile_iri": BASE + "profile/main"}
FOAF, VCARD, LOCN = "http://xmlns.com/foaf/0.1/", "http://www.w3.org/2006/vcard/ns#", "http://www.w3.org/ns/locn#"


def text(c):
    return F.col(c).cast("string")


def only(condition, value):
    return F.when(condition, value if not isinstance(value, str) else F.lit(value))


def public_quads(spark, sf):
    """Orders as catalogue entries; every rule is broken by some of them."""
    k = F.col("o_orderkey")
    rows = [
        (R.DCT + "title", F.concat(F.lit("Order "), k.cast("string")), "literal", None, "en"), (R.DCT + "title", only(k % 23 == 14, "Second"), "literal", None, "en"), (R.DCT + "title", only(k % 23 == 14, "Third"), "literal", None, "en"),
        (FOAF + "age", only(k % 10 == 1, "41"), "literal", XSD + "integer", None), (VCARD + "hasTelephone", only(k % 11 == 2, "phone"), "literal", None, None),
        (R.DCAT + "landingPage", only(k % 12 == 3, "http://data.example.org/p"), "iri", None, None), (R.OWL + "imports", only(k % 13 == 4, BASE + "o"), "iri", None, None),
        ("urn:x:local", only(k % 14 == 5, "v"), "literal", None, None), (R.DCT + "sourceBindingRef", only(k % 15 == 6, "v"), "literal", None, None),
        (R.DCT + "relation", only(k % 16 == 7, "http://192.168.0.1/x"), "iri", None, None), (R.DCT + "description", only(k % 17 == 8, "call 010-1234-5678"), "literal", None, None),
        (LOCN + "geometry", only(k % 18 == 9, "POINT(1 2)"), "literal", R.WKT_LITERAL, None), (R.DCT + "issued", only(k % 19 == 10, "2024-02-30"), "literal", XSD + "date", None),
        (R.DCT + "abstract", only(k % 20 == 11, "a literal that is longer than forty characters"), "literal", None, None), (RDF_TYPE, only(k % 21 == 12, R.OWL + "Class"), "iri", None, None),
        (R.DCT + "conformsTo", only(k % 22 == 13, "http://data.example.org/profile/main"), "iri", None, None), (R.DCT + "conformsTo", only(k % 22 == 14, BASE + "profile/main"), "iri", None, None),
        (RDF_TYPE, F.lit(R.DCAT + "Dataset"), "iri", None, None), (R.DCT + "publisher", F.concat(F.lit(BASE + "org/"), F.col("o_orderstatus")), "iri", None, None), (R.DCT + "identifier", text("o_custkey"), "literal", None, None)]
    return statements(table(spark, sf, "orders"), F.concat(F.lit(BASE + "id/"), k.cast("string")), rows)


_RULES = [("SEC-PUBLIC-005", FOAF + "age", "k % 10 = 1"), ("SEC-PUBLIC-007", VCARD + "hasTelephone", "k % 11 = 2"), ("SEC-PUBLIC-006", R.DCAT + "landingPage", "k % 12 = 3"), ("SEC-PUBLIC-001", R.OWL + "imports", "k % 13 = 4"),
          ("SEC-PUBLIC-002", "urn:x:local", "k % 14 = 5"), ("SEC-PUBLIC-001", "urn:x:local", "k % 14 = 5"), ("SEC-PUBLIC-001", R.DCT + "sourceBindingRef", "k % 15 = 6"), ("SEC-PUBLIC-001", R.DCT + "relation", "k % 16 = 7"),
          ("SEC-PUBLIC-005", R.DCT + "description", "k % 17 = 8"), ("GEO-ENCODING-004", LOCN + "geometry", "k % 18 = 9"), ("SEM-DATATYPE-001", R.DCT + "issued", "k % 19 = 10"), ("SEC-PUBLIC-001", R.DCT + "abstract", "k % 20 = 11"),
          ("SEM-DATASET-BOUNDARY-001", RDF_TYPE, "k % 21 = 12"), ("PROFILE-MARKER-003", R.DCT + "conformsTo", "k % 22 = 13"), ("SEC-COMPLEXITY-001", R.DCT + "title", "k % 23 = 14")]


@query("public_graph_scan", "with o as (select *, o_orderkey as k, min('https://data.example.org/id/' || o_orderkey) over (partition by o_custkey, o_orderstatus) as first_s from orders) " + " union all ".join(
    f"select '{code}' as code, '{path}' as path, count(*) as findings from o where {cond}" for code, path, cond in _RULES) +
    " union all select 'DS-ID-UNIQUE-001', 'http://purl.org/dc/terms/identifier', count(*) from o where 'https://data.example.org/id/' || o_orderkey <> first_s")
def public_graph_scan(spark, sf):
    return R.scan_public_graph(public_quads(spark, sf), POLICY).groupBy("code", "path").agg(F.count(F.lit(1)).alias("findings"))


@query("profile_routing", """select 'https://data.example.org/id/' || o_orderkey as focus_node from orders where o_orderkey % 18 = 9""")
def profile_routing(spark, sf):
    return R.profile_routing(public_quads(spark, sf)).select("focus_node")


@query("role_mailboxes", """select 'urn:x:s' || s_suppkey as s from supplier where s_suppkey % 3 = 0 and s_nationkey in (select c_nationkey from customer) and s_acctbal > 0""")
def role_mailboxes(spark, sf):
    sup = table(spark, sf, "supplier")
    q = statements(sup, iri("s", "s_suppkey"), [
        (VCARD + "hasEmail", F.when(F.col("s_suppkey") % 3 == 0, "mailto:office@data.example.org").otherwise("mailto:someone@data.example.org"), "iri", None, None),
        (RDF_TYPE, only(F.col("s_acctbal") > 0, VCARD + "Organization"), "iri", None, None)])
    q = q.unionByName(statements(sup, iri("d", "s_suppkey"), [(R.DCAT + "contactPoint", iri("s", "s_suppkey"), "iri", None, None)]))
    return R.role_mailbox_ok(q, ["mailto:office@data.example.org"], VCARD + "hasEmail", R.DCAT + "contactPoint", VCARD + "Organization").select("s")


@query("sanitized_values", f"""select doc_id, case when regexp_matches(text, '{quoted(SECRETS)}') or regexp_matches(text, '{quoted(PERSONAL)}')
      or lower(regexp_extract(text, '^[A-Za-z][A-Za-z0-9+.-]*:')) not in ('', 'http:', 'https:') then '[redacted:sha256:' || substr(sha256(text), 1, 16) || ']'
    when length(text) > 1500 then '[omitted:length:' || length(text) || ':sha256:' || substr(sha256(text), 1, 16) || ']' else text end as shown from documents""")
def sanitized_values(spark, sf):
    return R.sanitize_value(table(spark, sf, "documents").select("doc_id", "text"), "text", "shown", 1500).select("doc_id", "shown")


@query("portal_defects", """with o as (select o_custkey as g, bool_or(o_orderpriority = '1-URGENT') as kr, bool_or(o_orderpriority = '2-HIGH') as dt, bool_or(o_orderpriority = '3-MEDIUM') as th, bool_or(o_totalprice > 400000) as kw,
    bool_or(o_orderstatus = 'F') as bl, bool_or(o_orderpriority = '5-LOW') as focus, bool_or(o_orderpriority = '5-LOW' and o_orderkey % 3 > 0) as un from orders group by 1)
  select 'g' || g as graph, concat_ws(',', case when bl then 'PDP-BLANK-PUBLISHER' end, case when kw then 'PDP-COMBINED-KEYWORDS' end, case when kr then 'PDP-LANG-KR' end, case when th then 'PDP-LITERAL-THEME' end,
    case when not focus or un then 'PDP-PROFILE-MARKER-MISSING' end, case when dt then 'PDP-XSD-DATE-LEXICAL' end) as defects from o""")
def portal_defects(spark, sf):
    o, pr = table(spark, sf, "orders"), F.col("o_orderpriority")
    q = statements(o, iri("o", "o_orderkey"), [
        (R.DCT + "title", F.lit("t"), "literal", None, F.when(pr == "1-URGENT", "kr").otherwise("en")), (R.DCT + "issued", only(pr == "2-HIGH", "2024-13-01"), "literal", XSD + "date", None), (R.DCAT + "theme", only(pr == "3-MEDIUM", "roads"), "literal", None, None),
        (R.DCAT + "keyword", F.when(F.col("o_totalprice") > 400000, "a,b").otherwise("a"), "literal", None, None), (R.DCT + "publisher", only(F.col("o_orderstatus") == "F", "b1"), "bnode", None, None),
        (RDF_TYPE, only(pr == "5-LOW", R.DCAT + "Catalog"), "iri", None, None), (R.DCT + "conformsTo", only((pr == "5-LOW") & (F.col("o_orderkey") % 3 == 0), "urn:x:profile"), "iri", None, None)], F.concat(F.lit("g"), text("o_custkey")))
    return R.portal_defects(q, "urn:x:profile").select("graph", F.array_join("defects", ",").alias("defects"))


NS = "urn:x:def#"


def ontology(spark, sf):
    """Parts as ontology terms of every kind."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    term = F.concat(F.lit(NS + "t"), k.cast("string"))
    nth = lambda n: F.concat(F.lit(NS + "c"), (k % n).cast("string"))
    kind = F.when(k % 3 == 0, R.OWL + "ObjectProperty").when(k % 3 == 1, R.OWL + "DatatypeProperty").otherwise(R.OWL + "AnnotationProperty")
    return statements(p, term, [
        (RDF_TYPE, only(k % 17 != 5, kind), "iri", None, None), (R.RDFS + "domain", only(k % 7 != 2, nth(5)), "iri", None, None),
        (R.RDFS + "range", F.when(k % 11 == 4, F.lit(None)).when(k % 3 == 1, F.lit(XSD + "integer")).otherwise(nth(4)), "iri", None, None),
        (R.OWL + "deprecated", F.when(k % 13 == 1, "true").when(k % 13 == 2, "yes"), "literal", XSD + "boolean", None)])


def class_tree(spark, sf):
    """Five classes: c1 below c0, c3 below c2, c2 below c0."""
    up = F.when(F.col("r_regionkey") == 3, NS + "c2").when(F.col("r_regionkey").isin(1, 2), NS + "c0")
    return statements(table(spark, sf, "region"), F.concat(F.lit(NS + "c"), text("r_regionkey")), [(R.RDFS + "subClassOf", up, "iri", None, None)])


def instance_data(spark, sf):
    """Line items as statements with local predicates over typed customers."""
    l = table(spark, sf, "lineitem")
    c = lambda n: F.concat(F.lit(EX + "i"), (F.col("l_suppkey") * 7 % n).cast("string"))
    data = l.select(F.lit("main").alias("graph"), c(50).alias("s"), F.lit("iri").alias("s_kind"), F.concat(F.lit(NS + "t"), text("l_partkey")).alias("p"),
                    F.when(F.col("l_linenumber") % 2 == 0, c(40)).otherwise(text("l_orderkey")).alias("o"), F.when(F.col("l_linenumber") % 2 == 0, "iri").otherwise("literal").alias("o_kind"),
                    F.when(F.col("l_linenumber") % 2 == 1, F.when(F.col("l_linenumber") == 1, XSD + "integer").otherwise(XSD + "string")).alias("datatype"), F.lit(None).cast("string").alias("lang")).distinct()
    types = statements(table(spark, sf, "customer"), iri("i", "c_custkey"), [(RDF_TYPE, F.concat(F.lit(NS + "c"), (F.col("c_custkey") % 5).cast("string")), "iri", None, None)])
    return data.unionByName(types)


@query("domain_range", """with d as (select distinct l_suppkey * 7 % 50 as s, l_partkey as k, case when l_linenumber % 2 = 0 then 'urn:x:i' || (l_suppkey * 7 % 40) else cast(l_orderkey as varchar) end as o, l_linenumber % 2 = 1 as lit,
      case when l_linenumber = 1 then 'integer' when l_linenumber % 2 = 1 then 'string' end as dt, case when l_linenumber % 2 = 0 then l_suppkey * 7 % 40 end as ot from lineitem),
  inst as (select * from (values (0, 0), (1, 1), (1, 0), (2, 2), (2, 0), (3, 3), (3, 2), (3, 0), (4, 4)) t(cls, sup)), u as (select *, k % 17 <> 5 as decl, k % 3 as kind from d),
  f as (select 'UNDECLARED_LOCAL_PROPERTY' as code, k, s, o from u where not decl
    union all select 'PROPERTY_DOMAIN_MISSING', k, s, o from u where decl and kind < 2 and k % 7 = 2
    union all select 'DOMAIN_TYPE_MISMATCH', k, s, o from u where decl and kind < 2 and k % 7 <> 2 and not exists (select 1 from inst where cls = s % 5 and sup = k % 5)
    union all select 'OBJECT_PROPERTY_LITERAL', k, s, o from u where decl and kind = 0 and lit union all select 'DATATYPE_PROPERTY_RESOURCE', k, s, o from u where decl and kind = 1 and not lit
    union all select 'PROPERTY_RANGE_MISSING', k, s, o from u where decl and k % 11 = 4 and ((kind = 0 and not lit) or (kind = 1 and lit))
    union all select 'RANGE_TYPE_MISMATCH', k, s, o from u where decl and kind = 0 and not lit and k % 11 <> 4 and not exists (select 1 from inst where cls = ot % 5 and sup = k % 4)
    union all select 'DATATYPE_RANGE_MISMATCH', k, s, o from u where decl and kind = 1 and lit and k % 11 <> 4 and dt <> 'integer')
  select code, count(distinct (k, s, o)) as findings from f group by 1""")
def domain_range(spark, sf):
    found = R.domain_range(ontology(spark, sf).unionByName(class_tree(spark, sf)), instance_data(spark, sf), NS)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


@query("schema_findings", """with t as (select p_partkey as k, p_partkey % 3 as kind, p_partkey % 17 <> 5 as decl from part)
  select 'PROPERTY_DOMAIN_MISSING' as code, count(*) as findings from t where decl and kind < 2 and k % 7 = 2 union all select 'PROPERTY_RANGE_MISSING', count(*) from t where decl and kind < 2 and k % 11 = 4
  union all select 'DEPRECATED_MARKER_INVALID', count(*) from t where k % 13 = 2 union all select 'LOCAL_EQUIVALENCE_PROHIBITED', count(*) from t where k % 50 = 7
  union all select 'EQUIVALENT_DISJOINT_CLASS', count(*) from t where k % 100 = 7""")
def schema_findings(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    term = lambda d: F.concat(F.lit(NS + "t"), (k + d).cast("string"))
    extra = statements(p, term(0), [(R.OWL + "equivalentClass", only(k % 50 == 7, term(1)), "iri", None, None), (R.OWL + "disjointWith", only(k % 100 == 7, term(1)), "iri", None, None)])
    return R.schema_findings(ontology(spark, sf).unionByName(extra), NS).groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


@query("disjoint_instances", """with t as (select distinct o_custkey as s, o_orderpriority as cls from orders)
  select 'urn:x:c' || s as s from t where cls in ('1-URGENT', '5-LOW') group by s having count(*) = 2
  union select 'urn:x:c' || s from t where cls in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') group by s having count(*) > 1""")
def disjoint_instances(spark, sf):
    types = statements(table(spark, sf, "orders"), iri("c", "o_custkey"), [(RDF_TYPE, F.col("o_orderpriority"), "iri", None, None)])
    r, k = table(spark, sf, "region"), F.col("r_regionkey")
    cells = F.element_at(F.array(*[F.lit(x) for x in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")]), (k + 1).cast("int"))
    facts = statements(r.where(k == 0), F.lit("1-URGENT"), [(R.OWL + "disjointWith", F.lit("5-LOW"), "iri", None, None)]).unionByName(
        statements(r.where(k == 0), F.lit("group"), [(RDF_TYPE, F.lit(R.OWL + "AllDisjointClasses"), "iri", None, None), (R.OWL + "members", F.lit("l0"), "bnode", None, None)])).unionByName(
        statements(r.where(k < 3), F.concat(F.lit("l"), text("r_regionkey")), [(RDF + "first", cells, "iri", None, None),
                   (RDF + "rest", F.when(k < 2, F.concat(F.lit("l"), (k + 1).cast("string"))).otherwise(RDF + "nil"), "bnode", None, None)]).withColumn("s_kind", F.lit("bnode")))
    return R.disjoint_instances(types.unionByName(facts)).select("s").distinct()


@query("disjoint_members", """with t as (select distinct o_custkey as s, o_orderpriority as cls from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')),
  m as (select *, min(cls) over (partition by s) as least from t) select 'urn:x:c' || s as s, least as first_class, cls as other_class from m where cls <> least""")
def disjoint_members(spark, sf):
    """Customers with several classes of one disjoint list: every class beside the first, none left out.

    The list is the tail of a longer one that is not a disjointness.
    """
    types = statements(table(spark, sf, "orders"), iri("c", "o_custkey"), [(RDF_TYPE, F.col("o_orderpriority"), "iri", None, None)])
    r, k = table(spark, sf, "region"), F.col("r_regionkey")
    cells = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")]), (k + 1).cast("int"))
    facts = statements(r.where(k == 0), F.lit("group"), [(RDF_TYPE, F.lit(R.OWL + "AllDisjointClasses"), "iri", None, None), (R.OWL + "members", F.lit("l1"), "bnode", None, None)]).unionByName(
        statements(r.where(k < 4), F.concat(F.lit("l"), text("r_regionkey")), [(RDF + "first", cells, "iri", None, None),
                   (RDF + "rest", F.when(k < 3, F.concat(F.lit("l"), (k + 1).cast("string"))).otherwise(RDF + "nil"), "bnode", None, None)]).withColumn("s_kind", F.lit("bnode")))
    return R.disjoint_instances(types.unionByName(facts)).select("s", F.col("left").alias("first_class"), F.col("right").alias("other_class"))


@query("disjoint_properties", """select distinct 'urn:x:c' || a.o_custkey as s from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderstatus = 'F' and b.o_orderstatus = 'O' and a.o_orderkey % 7 = b.o_orderkey % 7""")
def disjoint_properties(spark, sf):
    q = statements(table(spark, sf, "orders"), iri("c", "o_custkey"), [(EX + "F", only(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 7).cast("string")), "literal", None, None), (EX + "O", only(F.col("o_orderstatus") == "O", (F.col("o_orderkey") % 7).cast("string")), "literal", None, None)])
    facts = statements(table(spark, sf, "region").where(F.col("r_regionkey") == 0), F.lit(EX + "F"), [(R.OWL + "propertyDisjointWith", F.lit(EX + "O"), "iri", None, None)])
    return R.disjoint_properties(q.unionByName(facts)).select("s").distinct()


@query("same_and_different", """with p as (select distinct least(o_custkey, o_orderkey % 500) as a, greatest(o_custkey, o_orderkey % 500) as b, o_orderstatus as st from orders where o_orderstatus <> 'P')
  select 'urn:x:c' || least(cast(x.a as varchar), cast(x.b as varchar)) as left_node, 'urn:x:c' || greatest(cast(x.a as varchar), cast(x.b as varchar)) as right_node from p x join p y on x.a = y.a and x.b = y.b and x.st = 'F' and y.st = 'O'""")
def same_and_different(spark, sf):
    other = F.concat(F.lit(EX + "c"), (F.col("o_orderkey") % 500).cast("string"))
    q = statements(table(spark, sf, "orders"), iri("c", "o_custkey"), [(R.OWL + "sameAs", only(F.col("o_orderstatus") == "F", other), "iri", None, None), (R.OWL + "differentFrom", only(F.col("o_orderstatus") == "O", other), "iri", None, None)])
    return R.same_and_different(q).select(F.col("left").alias("left_node"), F.col("right").alias("right_node"))


@query("deprecated_use", """with d as (select distinct l_suppkey * 7 % 50 as s, l_partkey as k from lineitem) select 'DEPRECATED_PROPERTY' as code, count(distinct (s, k)) as findings from d where k % 13 = 1
  union all select 'DEPRECATED_CLASS', count(*) from customer where c_custkey % 5 = 3""")
def deprecated_use(spark, sf):
    old = ontology(spark, sf).where((F.col("p") == R.OWL + "deprecated") & (F.col("o") == "true")).select(F.col("s").alias("term"))
    third = table(spark, sf, "region").where(F.col("r_regionkey") == 3).select(F.concat(F.lit(NS + "c"), text("r_regionkey")).alias("term"))
    return R.deprecated_use(instance_data(spark, sf), old.unionByName(third)).groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


@query("term_governance", """with t as (select p_partkey as k, p_size as z from part), f as (
  select k, unnest([case when k % 10 = 3 then 'TERM_NOT_REGISTERED' end, case when k % 10 = 4 then 'TERM_NOT_IN_ONTOLOGY' end, case when k % 10 not in (3, 4) and k % 7 = 1 then 'DOMAIN_MISMATCH' end,
    case when k % 10 not in (3, 4) and k % 9 = 2 then 'STATUS_MISMATCH' end, case when k % 10 <> 3 and k % 9 = 2 then 'DEPRECATION_WITHOUT_REPLACEMENT' end, case when k % 10 <> 3 and z = 5 then 'EVIDENCE_MISSING' end,
    case when k % 10 <> 3 and z % 8 = 6 then 'EVIDENCE_UNKNOWN' end]) as code from t) select 'term-' || lpad(cast(k as varchar), 8, '0') as term, code from f where code is not null""")
def term_governance(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    term = F.format_string("term-%08d", k).alias("term")
    none = F.lit(None).cast("string")
    rest = [F.lit("1.0").alias("version"), none.alias("replaced_by")]
    z = F.col("p_size")
    evidence_ids = F.when(z == 5, F.array().cast("array<string>")).when(z % 8 == 6, F.array(F.lit("ev-x"))).otherwise(F.array(F.lit("ev-1")))
    reg = p.where(k % 10 != 3).select(term, F.lit("Class").alias("kind"), F.when(k % 7 == 1, "other").otherwise("d").alias("domain"), F.lit("r").alias("range"), F.when(k % 9 == 2, "deprecated").otherwise("stable").alias("status"), *rest,
                                      evidence_ids.alias("evidence_ids"), k.alias("row_no"))
    ont = p.where(k % 10 != 4).select(term, F.lit("Class").alias("kind"), F.lit("d").alias("domain"), F.lit("r").alias("range"), F.lit("stable").alias("status"), *rest)
    ev = table(spark, sf, "region").where(F.col("r_regionkey") == 1).select(F.concat(F.lit("ev-"), text("r_regionkey")).alias("evidence_id"))
    return R.term_governance(reg, ont, ev)


@query("vocabulary_registry", """with t as (select p_partkey as k, p_brand as b, case when p_partkey % 3 = 0 then p_type else cast(p_partkey as varchar) end as notation, case when p_size % 10 = 0 then 'deprecated' when p_size % 10 = 1 then 'retired' else 'valid' end as status,
    case when p_partkey % 4 = 0 then '2024-02-02' when p_partkey % 4 = 1 then '2024-01-01' else '2020-01-01' end as dated from part)
  select b as category, 'urn:x:concept/' || k as concept, notation, status, dated, count(*) over (partition by b, notation) > 1 as repeated from t""")
def vocabulary_registry(spark, sf):
    p, k, z = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    skos = "http://www.w3.org/2004/02/skos/core#"
    q = statements(p, F.concat(F.lit("urn:x:concept/"), k.cast("string")), [
        (RDF_TYPE, F.lit(skos + "Concept"), "iri", None, None), (skos + "notation", only(k % 3 == 0, F.col("p_type")), "literal", None, None), (skos + "prefLabel", F.col("p_name"), "literal", None, "en"),
        (R.OWL + "deprecated", only(z % 10 == 0, "true"), "literal", XSD + "boolean", None), ("http://www.w3.org/ns/adms#status", only(z % 10 == 1, "urn:x:status/retired"), "iri", None, None),
        (R.DCT + "issued", only(k % 4 < 2, "2024-01-01"), "literal", XSD + "date", None), (R.DCT + "modified", only(k % 4 == 0, "2024-02-02"), "literal", XSD + "date", None)], F.col("p_brand"))
    sources = p.select(F.col("p_brand").alias("graph"), F.col("p_brand").alias("category"), F.lit("valid").alias("default_status"), F.lit("2020-01-01").alias("default_date")).distinct()
    return R.vocabulary_registry(q, sources).select("category", "concept", "notation", "status", "dated", "repeated")


@query("crosswalk_findings", """with w as (select o_orderkey as k, o_custkey as c, o_custkey as r1, o_custkey + 1 as r2, o_custkey + case when o_orderkey % 5 = 0 then 2 else 0 end as c1, o_custkey + 1 as c2, o_orderpriority as pr, o_orderkey % 40 as own from orders),
  mx as (select count(*) as n from customer), f as (
  select k, unnest([case when r2 >= n then 'REQUIREMENT_UNKNOWN' end, case when c2 >= n or c1 >= n then 'CASE_UNKNOWN' end, case when pr = '5-LOW' then 'REQUIREMENT_REPEATED' end,
    case when k % 6 = 2 then 'ID_SEQUENCE' end, case when k % 40 <> 0 then 'PROJECTION_DRIFT' end,
    case when c1 <> r1 then 'EVIDENCE_SET_MISMATCH' end]) as code from w, mx)
  select 'XW-' || lpad(cast(case when k % 6 = 2 then k + 500000 else k end as varchar), 6, '0') as row_id, code from f where code is not null""")
def crosswalk_findings(spark, sf):
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    cust = table(spark, sf, "customer").select(text("c_custkey").alias("id"))
    ids = F.concat_ws(";", c.cast("string"), F.when(F.col("o_orderpriority") == "5-LOW", c.cast("string")), (c + 1).cast("string"))
    rows = o.select(k.alias("row_no"), F.format_string("XW-%06d", F.when(k % 6 == 2, k + 500000).otherwise(k)).alias("row_id"), ids.alias("requirement_ids"),
                    F.concat_ws(";", (c + F.when(k % 5 == 0, 2).otherwise(0)).cast("string"), (c + 1).cast("string")).alias("case_ids"), F.when(k % 40 == 0, "same").otherwise("other").alias("projection"))
    reqs = cust.select(F.col("id").alias("requirement_id"), F.lit("same").alias("projection"), F.array("id").alias("evidence_ids"))
    return R.verify_crosswalk(rows, reqs, cust.select(F.col("id").alias("case_id"), F.col("id").alias("evidence_id")))


@query("node_link_findings", """with n as (select p_partkey as k from part) , l as (select distinct l_orderkey as o, l_linenumber as n, l_partkey as f, l_suppkey as t from lineitem)
  select lpad(cast(k as varchar), 10, '0') || case when k % 50 = 3 then 'x' else '' end as element, 'NODE_INVALID' as code from n where k % 50 = 3
  union all select lpad(cast(o * 10 + n as varchar), 10, '0'), 'LINK_INVALID' from l where t % 9 = 4 union all select distinct lpad(cast(o * 10 + n as varchar), 10, '0'), 'ENDPOINT_MISSING' from l where f % 50 = 3 or t % 50 = 3""")
def node_link_findings(spark, sf):
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    k = F.col("p_partkey")
    nodes = table(spark, sf, "part").select(F.concat(pad(k), F.when(k % 50 == 3, "x").otherwise("")).alias("node_id"), F.lit("NODE0001").alias("hist_type"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    links = l.select(pad(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link_id"), pad(F.col("l_partkey")).alias("f_node"), pad(F.col("l_suppkey")).alias("t_node"),
                     F.when(F.col("l_suppkey") % 9 == 4, "ROAD1").otherwise("LINK0001").alias("hist_type"), F.lit("0000000001").alias("hist_remark"))
    return R.node_link_findings(nodes, links)


@query("edition_findings", """select p_partkey, case when p_partkey % 20 = 3 then 'NETWORK_CHECKSUM_INVALID' when p_partkey % 20 = 5 then 'NETWORK_VALIDITY_INTERVAL_INVALID' when p_partkey % 20 = 7 then 'NETWORK_TERMINAL_REPLACEMENT_INVALID'
    when p_partkey % 20 = 9 then 'NETWORK_ACTIVE_REPLACEMENT_INVALID' when p_partkey % 20 = 11 then 'NETWORK_REPLACEMENT_NOT_FOUND' when p_partkey % 20 = 13 then 'NETWORK_REPLACEMENT_IDENTITY_INVALID'
    when p_partkey % 20 = 15 then 'NETWORK_REPLACEMENT_VALIDITY_OVERLAP' when p_partkey % 2 = 1 and p_partkey + 1 > (select max(p_partkey) from part) then 'NETWORK_REPLACEMENT_NOT_FOUND' end as code from part""")
def edition_findings(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    m = k % 20
    group = F.floor((k + 1) / 2).cast("string")
    day = lambda s: F.lit(s).cast("date")
    odd = k % 2 == 1
    succ = F.to_json(F.array(F.lit("authority"), group, (k + 1).cast("string")))
    other = F.to_json(F.array(F.lit("authority"), F.floor((k + 3) / 2).cast("string"), (k + 2).cast("string")))
    key = F.when(m == 7, None).when(m == 11, F.lit('["a","b","c"]')).when(m == 13, other).when(odd, succ)
    ed = p.select("p_partkey", F.lit("authority").alias("network_authority"), group.alias("network_identifier"), k.cast("string").alias("network_version"),
                  F.when(m == 3, "bad").otherwise(F.sha2(k.cast("string"), 256)).alias("checksum"), F.when(m == 9, "withdrawn").when(odd, "superseded").otherwise("current").alias("status"),
                  F.when(m == 5, day("2025-01-01")).when(odd, day("2020-01-01")).otherwise(day("2024-06-01")).alias("valid_from"),
                  F.when(m == 15, day("2024-06-01")).when(odd, day("2024-05-31")).alias("valid_until"), key.alias("replacement_key"))
    return R.edition_findings(ed, ["candidate", "current", "superseded", "withdrawn"], ["current", "superseded"]).select("p_partkey", "code")


# --- addresses, links, geometry --------------------------------------------------------------

def _class_sql(v):
    blocks = sorted(net.IPV4_BLOCKS, key=lambda b: -ipaddress.ip_network(b[0]).prefixlen)
    cases = " ".join(f"when {v} between {int(ipaddress.ip_network(p).network_address)} and {int(ipaddress.ip_network(p).broadcast_address)} then {str(g).lower()}" for p, g in blocks)
    return f"case {cases} else true end"


@query("ip_classes", f"""with a as (select o_orderkey, (o_orderkey * 2654435761 + o_custkey) % 4294967296 as v from orders) select o_orderkey, {_class_sql('v')} as is_global from a""")
def ip_classes(spark, sf):
    v = (F.col("o_orderkey") * 2654435761 + F.col("o_custkey")) % 4294967296
    octets = [F.shiftright(v, n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)]
    return net.ip_class(table(spark, sf, "orders").select("o_orderkey", F.concat_ws(".", *octets).alias("host")), "host").select("o_orderkey", "is_global")


def links(spark, sf):
    n, url = F.col("page_id") % 9, F.col("url")
    made = (F.when(n == 1, "http://user:pw@data.example.org/x").when(n == 2, "https://data.example.org/x?access_token=abc").when(n == 3, "http://10.1.2.3/x").when(n == 4, "http://intranet/x")
            .when(n == 5, "https://service.internal/x").when(n == 6, "https://data.example.org/x?mail=joe%40mail.example.com").when(n == 7, "https://data.example.org/a%zz").when(n == 8, "http://[::1]/x"))
    return table(spark, sf, "pages").select("page_id", F.coalesce(made, url).alias("iri"))


_LINK = "case page_id % 9 when 1 then 'userinfo' when 2 then 'sensitive-query' when 3 then 'non-global-host' when 4 then 'non-global-host' when 5 then 'non-global-host' when 6 then 'sensitive-query-value' when 7 then 'invalid-url-encoding' when 8 then 'non-global-host' end"


@query("blocked_links", f"select page_id, {_LINK} as blocked_reason from pages")
def blocked_links(spark, sf):
    return net.blocked_iri_reason(links(spark, sf), "iri").select("page_id", "blocked_reason")


@query("unstable_urls", """select page_id, case when not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:\\S+$') then 'invalid-public-url' when not starts_with(url, 'https:') then 'non-https-public-url' when regexp_matches(url, '[?#].') then 'query-or-fragment'
  when regexp_extract(url, '^https://([^/?#:]*)', 1) not like '%.example.org' then 'unapproved-public-host' end as reason from pages""")
def unstable_urls(spark, sf):
    pages = table(spark, sf, "pages")
    own = F.when(net.host_of(F.col("url")).endswith(".example.org"), F.regexp_replace("url", r"^(https?://)[^/?#]*", "$1data.example.org")).otherwise(F.col("url"))
    return pages.select("page_id", net.unstable_url_reason(F.lit(net.STABLE_PREDICATES[0]), own, ["data.example.org"]).alias("reason"))


@query("resource_references", """select page_id, case page_id % 7 when 1 then 'CREDENTIAL_FIELD' when 2 then 'CREDENTIAL_VALUE' when 3 then 'USERINFO' when 4 then 'CREDENTIAL_QUERY' when 5 then 'CREDENTIAL_FRAGMENT' end as ref_problem from pages""")
def resource_references(spark, sf):
    n = F.col("page_id") % 7
    value = (F.when(n == 2, "Bearer abcdef").when(n == 3, "https://me:pw@store.example.org/x").when(n == 4, "https://store.example.org/x?sig%3D=1&my.token=2").when(n == 5, "https://store.example.org/x#%20password%3Dabc").otherwise("bucket-7"))
    ref = F.create_map(F.when(n == 1, "apiKey").otherwise("path"), value)
    return X.safe_resource_ref(table(spark, sf, "pages").select("page_id", ref.alias("ref")), "ref").select("page_id", "ref_problem")


@query("encoded_reference_names", """select page_id, case when page_id % 6 in (1, 2, 3) then 'CREDENTIAL_QUERY' end as ref_problem from pages""")
def encoded_reference_names(spark, sf):
    """Names of query parts that are written in escapes or full width, one that cannot be decoded, and harmless ones."""
    n = F.col("page_id") % 6
    part = (F.when(n == 1, "%74oken=abc").when(n == 2, "a=1&%E2%80%8B=2&ap%69%5Fk%65y=x").when(n == 3, "\uff54\uff4f\uff4b\uff45\uff4e=1").when(n == 4, "%ZZ=1").otherwise("p%61ge=1"))
    ref = F.create_map(F.lit("path"), F.concat(F.lit("https://store.example.org/x?"), part))
    return X.safe_resource_ref(table(spark, sf, "pages").select("page_id", ref.alias("ref")), "ref").select("page_id", "ref_problem")


@query("wkt_geometries", """select o_orderkey, case when o_orderkey % 6 = 3 or o_orderkey % 6 = 5 then null when o_orderkey % 6 = 4 then 'polygon' when o_orderkey % 6 < 2 then 'point' else 'linestring' end as type,
  case when o_orderkey % 6 = 3 or o_orderkey % 6 = 5 then null when o_orderkey % 6 = 4 then 4 when o_orderkey % 6 < 2 then 1 else 2 end as positions from orders""")
def wkt_geometries(spark, sf):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    x, y = (k % 180).cast("string"), (k % 90).cast("string")
    crs = F.lit("<http://www.opengis.net/def/crs/OGC/1.3/CRS84> ")
    body = (F.when(m < 2, F.concat(F.lit("POINT("), x, F.lit(" "), y, F.lit(")"))).when(m == 2, F.concat(F.lit("LINESTRING("), x, F.lit(" "), y, F.lit(", 1e1 -2.5)")))
            .when(m == 3, F.concat(F.lit("LINESTRING("), x, F.lit(" "), y, F.lit(")"))).when(m == 4, F.lit("POLYGON((0 0, 1 0, 1 1, 0 0))")).otherwise("POLYGON((0 0, 1 0, 1 1, 0 1))"))
    g = geo.parse_wkt(F.concat(crs, body))
    return table(spark, sf, "orders").select("o_orderkey", g.alias("g")).select("o_orderkey", F.col("g.type").alias("type"), F.when(F.col("g").isNotNull(), F.size("g.coords")).alias("positions"))


@query("mercator_positions", """select o_orderkey, round(radians(o_orderkey % 360 - 180) * 6378137.0, 3) + 0.0::double as x, round(ln(tan(radians(o_orderkey % 170 - 85) / 2 + pi() / 4)) * 6378137.0, 3) + 0.0::double as y from orders""")
def mercator_positions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 360 - 180).cast("double").alias("lon"), (F.col("o_orderkey") % 170 - 85).cast("double").alias("lat"))
    out = geo.reproject(o, "lat", "lon", "http://www.opengis.net/def/crs/EPSG/0/4326", "http://www.opengis.net/def/crs/EPSG/0/3857", ("x", "y"))
    return out.select("o_orderkey", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query("round_trip_errors", """select count(*) as positions, true as all_small from orders""")
def round_trip_errors(spark, sf):
    o = table(spark, sf, "orders").select((33 + F.col("o_orderkey") % 1000 / 100).alias("lat"), (124 + F.col("o_custkey") % 800 / 100).alias("lon"))
    err = geo.round_trip_error(o, "lat", "lon", "http://www.opengis.net/def/crs/EPSG/0/4326", "http://www.opengis.net/def/crs/EPSG/0/5179")
    return err.agg(F.count(F.lit(1)).alias("positions"), F.bool_and(F.col("round_trip_error") < 1e-6).alias("all_small"))
