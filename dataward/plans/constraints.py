"""Shape constraints over the customer graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.operators import constraints as C
from dataward.operators.graph import RDF_TYPE
from dataward.plans.graph import EX, XSD, iri, nested_shapes, quads, statements
from dataward.plans.registry import query
from dataward.sources.tables import table

CUSTOMER = ("class", EX + "Customer")


def shape_query(name, component, parameter, sql, path=None, target=CUSTOMER):
    """Register one component check; the SQL lists (focus_node, value)."""
    @query(f"constraint_{name}", sql)
    def run(spark, sf):
        shape = C.Shape(f"{EX}shape:{name}", ((component, parameter),), target, path)
        return C.validate(quads(spark, sf), [shape]).select("focus_node", "value", "component")
    return run


def _sql(component, where, value="cast(null as varchar)", table_name="customer", focus="'urn:x:c' || c_custkey"):
    return f"select {focus} as focus_node, {value} as value, '{component}' as component from {table_name} where {where}"


shape_query("min_count", "minCount", 2, _sql("minCount", "true"), EX + "nation")
shape_query("max_count", "maxCount", 0, _sql("maxCount", "true", table_name="nation", focus="'urn:x:n' || n_nationkey"), EX + "region", ("class", EX + "Nation"))
shape_query("datatype", "datatype", XSD + "decimal", _sql("datatype", "true", "c_name"), EX + "name")
shape_query("node_kind", "nodeKind", ("bnode", "literal"), _sql("nodeKind", "true", "'urn:x:n' || c_nationkey"), EX + "nation")
shape_query("class", "class", EX + "Region", _sql("class", "true", "'urn:x:n' || c_nationkey"), EX + "nation")
shape_query("in", "in", tuple(f"{EX}n{i}" for i in range(20)), _sql("in", "c_nationkey >= 20", "'urn:x:n' || c_nationkey"), EX + "nation")
shape_query("has_value", "hasValue", "BUILDING", _sql("hasValue", "c_mktsegment <> 'BUILDING'"), EX + "segment")
shape_query("pattern", "pattern", ("^customer#0+1", "i"), _sql("pattern", "not regexp_matches(c_name, '^Customer#0+1')", "c_name"), EX + "name")
shape_query("min_length", "minLength", 9, _sql("minLength", "length(c_mktsegment) < 9", "c_mktsegment"), EX + "segment")
shape_query("max_length", "maxLength", 8, _sql("maxLength", "length(c_mktsegment) > 8", "c_mktsegment"), EX + "segment")
shape_query("language_in", "languageIn", ("en", "fr"), _sql("languageIn", "c_custkey % 4 = 0", "c_mktsegment"), EX + "segment")
shape_query("unique_lang", "uniqueLang", True, """select 'urn:x:r' || n_regionkey as focus_node, cast(null as varchar) as value, 'uniqueLang' as component from nation group by 1 having count(*) > 1""",
            ("seq", ("inv", EX + "region"), EX + "label"), ("class", EX + "Region"))
shape_query("min_inclusive", "minInclusive", 0, _sql("minInclusive", "c_acctbal < 0", "cast(cast(c_acctbal as decimal(12,2)) as varchar)"), EX + "balance")
shape_query("max_exclusive", "maxExclusive", 5000, _sql("maxExclusive", "cast(c_acctbal as decimal(12,2)) >= 5000", "cast(cast(c_acctbal as decimal(12,2)) as varchar)"), EX + "balance")
shape_query("inverse_path", "minCount", 70, """select 'urn:x:n' || n_nationkey as focus_node, cast(null as varchar) as value, 'minCount' as component from nation
  where (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) < 70""", ("inv", EX + "nation"), ("class", EX + "Nation"))
shape_query("closed", "closed", (RDF_TYPE, EX + "name", EX + "nation", EX + "segment"), _sql("closed", "true", "'urn:x:balance'"))
shape_query("subjects_of", "hasValue", EX + "r1", """select 'urn:x:n' || n_nationkey as focus_node, cast(null as varchar) as value, 'hasValue' as component from nation where n_regionkey <> 1""", EX + "region", ("subjectsOf", EX + "region"))
shape_query("objects_of", "minCount", 1, """select distinct 'urn:x:r' || n_regionkey as focus_node, cast(null as varchar) as value, 'minCount' as component from nation""", EX + "name", ("objectsOf", EX + "region"))
shape_query("target_node", "maxCount", 1, """select 'urn:x:r1' as focus_node, cast(null as varchar) as value, 'maxCount' as component where (select count(*) from nation where n_regionkey = 1) > 1""", ("inv", EX + "region"), ("node", EX + "r1"))

_EAST = C.Shape("east", (("in", (EX + "r1", EX + "r2")),), path=EX + "region")
_LOW = C.Shape("low", (("in", tuple(f"{EX}n{i}" for i in range(10))),))
shape_query("node_shape", "node", _EAST, _sql("node", "n_regionkey not in (1, 2)", "'urn:x:n' || c_nationkey", "customer join nation on n_nationkey = c_nationkey"), EX + "nation")
shape_query("not_shape", "not", _EAST, _sql("not", "n_regionkey in (1, 2)", "'urn:x:n' || c_nationkey", "customer join nation on n_nationkey = c_nationkey"), EX + "nation")
shape_query("or_shapes", "or", (_EAST, _LOW), _sql("or", "n_regionkey not in (1, 2) and n_nationkey >= 10", "'urn:x:n' || c_nationkey", "customer join nation on n_nationkey = c_nationkey"), EX + "nation")
shape_query("and_shapes", "and", (_EAST, _LOW), _sql("and", "not (n_regionkey in (1, 2) and n_nationkey < 10)", "'urn:x:n' || c_nationkey", "customer join nation on n_nationkey = c_nationkey"), EX + "nation")
shape_query("xone_shapes", "xone", (_EAST, _LOW), _sql("xone", "(n_regionkey in (1, 2)) = (n_nationkey < 10)", "'urn:x:n' || c_nationkey", "customer join nation on n_nationkey = c_nationkey"), EX + "nation")
shape_query("qualified", "qualifiedValueShape", (C.Shape("rich", (("minInclusive", 5000),), path=EX + "balance"), 30, None), """select 'urn:x:n' || n_nationkey as focus_node, cast(null as varchar) as value, 'qualifiedValueShape' as component from nation
  where (select count(*) from customer where c_nationkey = n_nationkey and cast(c_acctbal as decimal(12,2)) >= 5000) + (select count(*) from supplier where s_nationkey = n_nationkey and cast(s_acctbal as decimal(12,2)) >= 5000) < 30""", ("inv", EX + "nation"), ("class", EX + "Nation"))


def order_quads(spark, sf):
    """Orders with two dates and two amounts to compare."""
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    until = F.date_format(F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 5 - 1).cast("int")), "yyyy-MM-dd")
    return statements(o, iri("o", "o_orderkey"), [
        (RDF_TYPE, F.lit(EX + "Order"), "iri", None, None), (EX + "from", day, "literal", XSD + "date", None), (EX + "until", until, "literal", XSD + "date", None),
        (EX + "status", F.col("o_orderstatus"), "literal", None, None), (EX + "state", F.when(F.col("o_custkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")), "literal", None, None)])


def order_query(name, component, parameter, path, sql):
    @query(f"constraint_{name}", sql)
    def run(spark, sf):
        shape = C.Shape(name, ((component, parameter),), ("class", EX + "Order"), path)
        return C.validate(order_quads(spark, sf), [shape]).select("focus_node", "value", "component")
    return run


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
order_query("less_than_or_equals", "lessThanOrEquals", EX + "until", EX + "from", f"select 'urn:x:o' || o_orderkey as focus_node, {_DAY} as value, 'lessThanOrEquals' as component from orders where o_custkey % 5 = 0")
order_query("less_than", "lessThan", EX + "until", EX + "from", f"select 'urn:x:o' || o_orderkey as focus_node, {_DAY} as value, 'lessThan' as component from orders where o_custkey % 5 <= 1")
order_query("equals", "equals", EX + "state", EX + "status", """select 'urn:x:o' || o_orderkey as focus_node, unnest([o_orderstatus, 'F']) as value, 'equals' as component from orders where o_custkey % 3 = 0 and o_orderstatus <> 'F'""")
order_query("disjoint", "disjoint", EX + "state", EX + "status", """select 'urn:x:o' || o_orderkey as focus_node, o_orderstatus as value, 'disjoint' as component from orders where o_custkey % 3 <> 0 or o_orderstatus = 'F'""")

#: Beyond what a double can tell apart: 2^53 + 1.
BIG = 9007199254740993


def typed_quads(spark, sf):
    """Orders with whole numbers beyond 2^53, long decimals, and instants with and without zone."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    big = (F.lit(BIG - 2) + k % 5).cast("string")
    cents = F.concat(F.when(k % 2 == 0, "-").otherwise(""), F.lit("12345678901234567890.00000000000000000"), (k % 3).cast("string"))
    hour = lambda c: F.lpad((c % 24).cast("string"), 2, "0")
    stamp = lambda c, zone: F.concat(F.lit("2024-05-01T"), hour(c), F.lit(":00:00"), zone)
    begin = stamp(k, F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+09:00").otherwise(""))
    end = F.concat(F.lit("2024-05-0"), (1 + k % 2).cast("string"), F.lit("T"), hour(F.col("o_custkey")), F.lit(":00:00.5"), F.when(k % 4 < 2, "Z").otherwise(""))
    return statements(o, iri("o", "o_orderkey"), [
        (RDF_TYPE, F.lit(EX + "Order"), "iri", None, None), (EX + "big", big, "literal", XSD + "integer", None), (EX + "cents", cents, "literal", XSD + "decimal", None),
        (EX + "begin", begin, "literal", XSD + "dateTime", None), (EX + "end", end, "literal", XSD + "dateTime", None),
        (EX + "code", (k % 7).cast("string"), "literal", XSD + "integer", None), (EX + "label", (k % 7).cast("string"), "literal", None, None),
        (EX + "page", F.concat(F.lit(EX + "p"), (k % 2).cast("string")), "iri", None, None), (EX + "page", F.concat(F.lit(EX + "p"), (k % 3).cast("string")), "literal", None, None)])


def typed_query(name, component, parameter, path, sql):
    @query(f"typed_{name}", sql)
    def run(spark, sf):
        return C.validate(typed_quads(spark, sf), [C.Shape(name, ((component, parameter),), ("class", EX + "Order"), path)]).select("focus_node", "value")
    return run


_BIG = f"cast({BIG - 2} + o_orderkey % 5 as varchar)"
for _name, _component, _broken in (("min_exclusive", "minExclusive", f"{BIG - 2} + o_orderkey % 5 <= {BIG}"), ("max_inclusive", "maxInclusive", f"{BIG - 2} + o_orderkey % 5 > {BIG}"),
                                   ("min_inclusive", "minInclusive", f"{BIG - 2} + o_orderkey % 5 < {BIG}"), ("max_exclusive", "maxExclusive", f"{BIG - 2} + o_orderkey % 5 >= {BIG}")):
    typed_query(_name, _component, BIG, EX + "big", f"select 'urn:x:o' || o_orderkey as focus_node, {_BIG} as value from orders where {_broken}")
typed_query("long_decimals", "minInclusive", C.Term("literal", "-12345678901234567890.000000000000000001", XSD + "decimal"), EX + "cents",
            """select 'urn:x:o' || o_orderkey as focus_node, case when o_orderkey % 2 = 0 then '-' else '' end || '12345678901234567890.00000000000000000' || (o_orderkey % 3) as value from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 2""")
_INSTANTS = """i as (select o_orderkey as k, timestamp '2024-05-01' + (o_orderkey % 24) * interval 1 hour as local, o_orderkey % 3 < 2 as zoned,
    timestamp '2024-05-01' + (o_orderkey % 24) * interval 1 hour - case when o_orderkey % 3 = 1 then interval 9 hour else interval 0 hour end as b,
    timestamp '2024-05-01 00:00:00.5' + (o_orderkey % 2) * interval 1 day + (o_custkey % 24) * interval 1 hour as e, o_orderkey % 4 < 2 as ended from orders)"""
typed_query("instants", "lessThan", EX + "end", EX + "begin", f"""with {_INSTANTS} select 'urn:x:o' || k as focus_node, strftime(local, '%Y-%m-%dT%H:%M:%S') || case k % 3 when 0 then 'Z' when 1 then '+09:00' else '' end as value from i
  where not case when zoned = ended then b < e else b + interval 14 hour < e end""")
typed_query("bound_instants", "maxInclusive", C.Term("literal", "2024-05-01T12:00:00Z", XSD + "dateTime"), EX + "begin", f"""with {_INSTANTS} select 'urn:x:o' || k as focus_node,
  strftime(local, '%Y-%m-%dT%H:%M:%S') || case k % 3 when 0 then 'Z' when 1 then '+09:00' else '' end as value from i where not case when zoned then b <= timestamp '2024-05-01 12:00:00' else b + interval 14 hour < timestamp '2024-05-01 12:00:00' end""")
typed_query("equal_terms", "equals", EX + "label", EX + "code", """select 'urn:x:o' || o_orderkey as focus_node, cast(o_orderkey % 7 as varchar) as value from orders, range(2)""")
typed_query("disjoint_terms", "disjoint", EX + "label", EX + "code", """select 'urn:x:o' || o_orderkey as focus_node, 'x' as value from orders where false""")
typed_query("has_iri", "hasValue", EX + "p1", EX + "page", """select 'urn:x:o' || o_orderkey as focus_node, cast(null as varchar) as value from orders where o_orderkey % 2 = 0""")
typed_query("in_literals", "in", (C.Term("literal", EX + "p1"), C.Term("iri", EX + "p0")), EX + "page", """select 'urn:x:o' || o_orderkey as focus_node, 'urn:x:p1' as value from orders where o_orderkey % 2 = 1
  union all select 'urn:x:o' || o_orderkey, 'urn:x:p' || o_orderkey % 3 from orders where o_orderkey % 3 <> 1""")
typed_query("in_datatypes", "in", (C.Term("literal", "1", XSD + "integer"), C.Term("literal", "2")), EX + "code", """select 'urn:x:o' || o_orderkey as focus_node, cast(o_orderkey % 7 as varchar) as value from orders where o_orderkey % 7 <> 1""")

SHAPES = [
    C.Shape("balance", (("minInclusive", 0), ("datatype", XSD + "decimal")), CUSTOMER, EX + "balance", "Violation", "REQ-1"),
    C.Shape("segment", (("languageIn", ("en",)),), CUSTOMER, EX + "segment", "Warning", "REQ-2"),
    C.Shape("idle", (("minCount", 99),), CUSTOMER, EX + "name", deactivated=True)]


@query("validation_report", """select 'main' as graph, count(*) filter (where c_acctbal < 0) as violations, count(*) filter (where c_custkey % 4 = 0) as warnings,
  count(*) filter (where c_acctbal < 0) + count(*) filter (where c_custkey % 4 = 0) > 100 as overflow, false as conforms from customer""")
def validation_report(spark, sf):
    return C.report(C.validate(quads(spark, sf), SHAPES), 100).select("graph", "violations", "warnings", "overflow", "conforms")


@query("capped_findings", """select 'urn:x:c' || c_custkey as focus_node from customer where c_acctbal < 0 order by 1 limit 25""")
def capped_findings(spark, sf):
    found = C.validate(quads(spark, sf), [C.Shape("balance", (("minInclusive", 0),), CUSTOMER, EX + "balance")])
    return C.capped(found.select("focus_node"), 25)[0]


@query("result_multiset", """select component, count(*) as results, count(distinct c_mktsegment) as signatures from (
  select 'minInclusive' as component, c_mktsegment from customer where c_acctbal < 0 union all select 'languageIn', c_mktsegment from customer where c_custkey % 4 = 0) group by 1""")
def result_multiset(spark, sf):
    found = C.validate(quads(spark, sf), SHAPES)
    seg = table(spark, sf, "customer").select(iri("c", "c_custkey").alias("focus_node"), F.col("c_mktsegment").alias("segment"))
    return C.result_multiset(found.join(seg, "focus_node"), ["component"], ["segment", "severity"]).select("component", "results", "signatures")


@query("requirement_propagation", """select node, 'REQ-' || p_size as requirement_id from part, lateral (values ('urn:x:p' || p_partkey), ('m' || p_partkey), ('l' || p_partkey)) t(node)""")
def requirement_propagation(spark, sf):
    labels = table(spark, sf, "part").select(F.lit("main").alias("graph"), iri("p", "p_partkey").alias("node"), F.concat(F.lit("REQ-"), F.col("p_size").cast("string")).alias("requirement_id"))
    return C.requirement_of(nested_shapes(spark, sf), labels).select("node", "requirement_id")


@query("requirement_inventory", """select 'REQ-' || p_partkey as requirement_id, (p_size % 3) || '..' || case when p_size % 4 = 3 then '*' else cast(p_size % 4 as varchar) end as cardinality,
  case when p_size % 2 = 0 then 'xsd:string' else 'Dataset' end as range, case when p_size % 5 = 0 then 'a b' else '' end as vocabulary,
  case when p_size % 4 = 0 and p_partkey % 2 = 0 then 'MUST-NOT' when p_size % 4 = 0 then 'SHOULD-NOT' when p_partkey % 2 = 0 then case when p_size % 3 > 0 then 'MUST' else 'MAY' end else 'SHOULD' end as obligation from part""")
def requirement_inventory(spark, sf):
    p = F.col("p_size")
    none = F.lit(None).cast("string")
    props = table(spark, sf, "part").select(
        F.concat(F.lit("REQ-"), F.col("p_partkey").cast("string")).alias("requirement_id"), F.lit("dct:title").alias("path"), (p % 3).alias("min_count"), F.when(p % 4 != 3, p % 4).alias("max_count"),
        F.when(p % 2 == 0, "xsd:string").alias("datatype"), F.when(p % 2 != 0, "Dataset").alias("class"), none.alias("has_value"),
        F.when(p % 5 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("allowed"), F.when(F.col("p_partkey") % 2 == 0, "Violation").otherwise("Warning").alias("severity"))
    return C.requirement_inventory(props).select("requirement_id", "cardinality", "range", "vocabulary", "obligation")


@query("requirement_coverage", """with c as (select l_partkey as k, bool_or(l_returnflag = 'A' and l_quantity > 46) as p, bool_or(l_returnflag = 'R' and l_quantity > 46) as n from lineitem group by 1)
  select 'REQ-' || p_partkey as requirement_id, coalesce(p, false) as positive, coalesce(n, false) as negative,
    case when not (coalesce(p, false) and coalesce(n, false)) then 'BLK-' || upper(substr(sha256('REQ-' || p_partkey), 1, 12)) end as blocker_id from part left join c on k = p_partkey""")
def requirement_coverage(spark, sf):
    name = lambda c: F.concat(F.lit("REQ-"), F.col(c).cast("string")).alias("requirement_id")
    cases = table(spark, sf, "lineitem").select(name("l_partkey"), F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 46), "positive").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 46), "negative").alias("polarity"))
    return C.requirement_coverage(table(spark, sf, "part").select(name("p_partkey")), cases)


@query("runtime_coverage", """with r as (select s_suppkey % 7 as req, l_linenumber as profile, count(distinct l_partkey) as fixtures, bool_or(l_returnflag = 'A') as p, bool_or(l_returnflag = 'R') as n
    from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
  select req, 'p' || profile as profile, fixtures, p as positive, n as negative from r""")
def runtime_coverage(spark, sf):
    reqs = table(spark, sf, "supplier").select((F.col("s_suppkey") % 7).alias("requirement_id")).distinct()
    profiles = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("profile"), F.sequence(F.lit(0), F.lit(6)).cast("array<bigint>").alias("requirement_ids")).distinct()
    runs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("profile"), F.array(F.col("l_suppkey") % 7).alias("requirement_ids"), F.col("l_partkey").alias("fixture_id"),
        F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "R", "reject").otherwise("other").alias("expected"))
    return C.runtime_coverage(reqs, profiles, runs).select(F.col("requirement_id").alias("req"), "profile", "fixtures", "positive", "negative")
