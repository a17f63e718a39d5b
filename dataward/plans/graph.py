"""Graph operators over statements made of customers, suppliers, nations, regions and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.operators import graph as G
from dataward.plans.registry import query
from dataward.sources.tables import table

EX = "urn:x:"
XSD = "http://www.w3.org/2001/XMLSchema#"


def text(c):
    return F.col(c).cast("string")


def statements(df: DataFrame, subject, rows, graph=None) -> DataFrame:
    """Quads from ``rows``: (predicate, value, kind, datatype, lang) per row of ``df``."""
    s = lambda v: v.cast("string")
    cells = F.array(*[F.struct(F.lit(p).alias("p"), s(v).alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("datatype"),
                               (lang if not isinstance(lang, (str, type(None))) else F.lit(lang)).cast("string").alias("lang")) for p, v, kind, dt, lang in rows])
    return df.select((graph if graph is not None else F.lit("main")).alias("graph"), subject.alias("s"), F.lit("iri").alias("s_kind"), F.explode(cells).alias("x")).select(
        "graph", "s", "s_kind", "x.p", "x.o", "x.o_kind", "x.datatype", "x.lang").where(F.col("o").isNotNull())


def iri(prefix, c):
    return F.concat(F.lit(EX + prefix), text(c))


def quads(spark, sf) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    kind = lambda name: (G.RDF_TYPE, F.lit(EX + name), "iri", None, None)
    customer = statements(t("customer"), iri("c", "c_custkey"), [
        kind("Customer"), (EX + "name", F.col("c_name"), "literal", XSD + "string", None), (EX + "nation", iri("n", "c_nationkey"), "iri", None, None),
        (EX + "balance", F.col("c_acctbal").cast("decimal(12,2)"), "literal", XSD + "decimal", None), (EX + "segment", F.col("c_mktsegment"), "literal", None, F.when(F.col("c_custkey") % 4 == 0, "ko").otherwise("en"))])
    supplier = statements(t("supplier"), iri("s", "s_suppkey"), [
        kind("Supplier"), (EX + "name", F.col("s_name"), "literal", XSD + "string", None), (EX + "nation", iri("n", "s_nationkey"), "iri", None, None),
        (EX + "balance", F.col("s_acctbal").cast("decimal(12,2)"), "literal", XSD + "decimal", None)])
    nation = statements(t("nation"), iri("n", "n_nationkey"), [kind("Nation"), (EX + "label", F.col("n_name"), "literal", None, "en"), (EX + "region", iri("r", "n_regionkey"), "iri", None, None)])
    region = statements(t("region"), iri("r", "r_regionkey"), [kind("Region"), (EX + "label", F.col("r_name"), "literal", None, "en")])
    return customer.unionByName(supplier).unionByName(nation).unionByName(region)


@query("bgp_customers_by_region", """select 'urn:x:c' || c_custkey as customer, 'urn:x:n' || n_nationkey as nation, r_name as label
  from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def bgp_customers_by_region(spark, sf):
    return G.flat(G.bgp(quads(spark, sf), [("?customer", G.RDF_TYPE, EX + "Customer"), ("?customer", EX + "nation", "?nation"),
                                           ("?nation", EX + "region", "?_r"), ("?_r", EX + "label", "?label")]).drop("_r"))


@query("optional_balance", """select 'urn:x:n' || n_nationkey as nation, 'urn:x:s' || s_suppkey as supplier from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000""")
def optional_balance(spark, sf):
    q = quads(spark, sf)
    rich = q.where((F.col("p") == EX + "nation") & F.col("s").startswith(EX + "s")).join(
        q.where((F.col("p") == EX + "balance") & (F.expr("try_cast(o as decimal(12,2))") > 9000)).select("s"), "s", "left_semi").select(*q.columns)
    nations = G.bgp(q, [("?nation", G.RDF_TYPE, EX + "Nation")])
    return G.flat(G.optional(nations, rich, ("?supplier", EX + "nation", "?nation")))


@query("pattern_filters", """select 'urn:x:s' || a.s_suppkey as left_one, 'urn:x:s' || b.s_suppkey as right_one from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey
  where a.s_name like 'Supplier#00000000%' and a.s_nationkey in (3, 7, 11)""")
def pattern_filters(spark, sf):
    q = quads(spark, sf).where(~F.col("s").startswith(EX + "c"))
    df = G.bgp(q, [("?left_one", EX + "name", "?name"), ("?left_one", EX + "nation", "?n"), ("?right_one", EX + "nation", "?n")])
    df = G.values(G.starts_with(G.different(df, "left_one", "right_one"), "name", "Supplier#00000000"), "n", [EX + "n3", EX + "n7", EX + "n11"])
    return G.flat(df.select("left_one", "right_one"))


@query("ask_region", """select exists (select 1 from nation where n_regionkey = 2) as answer""")
def ask_region(spark, sf):
    return G.ask(quads(spark, sf), [("?n", EX + "region", EX + "r2")])


@query("path_sequence", """select distinct 'urn:x:r' || n_regionkey as s, 'urn:x:c' || c_custkey as o from customer join nation on n_nationkey = c_nationkey
  union select 'urn:x:r' || n_regionkey, 'urn:x:s' || s_suppkey from supplier join nation on n_nationkey = s_nationkey""")
def path_sequence(spark, sf):
    return G.path(quads(spark, sf), ("inv", ("seq", EX + "nation", EX + "region"))).select("s", "o")


@query("path_optional", """with e as (select 'urn:x:n' || n_nationkey as s, 'urn:x:r' || n_regionkey as o from nation), n as (select s from e union select o from e)
  select s, o from e union select s, s from n""")
def path_optional(spark, sf):
    q = quads(spark, sf).where(F.col("p") == EX + "region")
    return G.path(q, ("opt", EX + "region")).select("s", "o")


def part_tree(spark, sf) -> DataFrame:
    """Each part points to the part at a third of its number: a tree of logarithmic depth."""
    return table(spark, sf, "part").where(F.col("p_partkey") > 0).select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 3).alias("b"))


@query("closure_tree", """with recursive t(a, b) as (select p_partkey, p_partkey // 3 from part where p_partkey > 0 union all select t.a, t.b // 3 from t where t.b > 0)
  select a, cast(b as bigint) as b from t""")
def closure_tree(spark, sf):
    return G.closure(part_tree(spark, sf))


@query("path_plus_star", """with recursive t(a, b) as (select p_partkey, p_partkey // 3 from part where p_partkey > 0 union all select t.a, t.b // 3 from t where t.b > 0)
  select 'plus' as form, count(*) as pairs from t union all select 'star', count(*) + (select count(*) from part) from t""")
def path_plus_star(spark, sf):
    q = statements(table(spark, sf, "part").where(F.col("p_partkey") > 0), iri("p", "p_partkey"), [(EX + "part_of", F.concat(F.lit(EX + "p"), F.floor(F.col("p_partkey") / 3).cast("string")), "iri", None, None)])
    count = lambda form: G.path(q, (form, EX + "part_of")).agg(F.count(F.lit(1)).alias("pairs")).select(F.lit(form).alias("form"), "pairs")
    return count("plus").unionByName(count("star"))


@query("superclass_pairs", """with recursive e as (select s_suppkey as a, s_suppkey // 2 as b from supplier where s_suppkey > 0), t(a, b) as (select a, b from e union all select t.a, t.b // 2 from t where t.b > 0)
  select a, cast(b as bigint) as b from t union select s_suppkey, s_suppkey from supplier""")
def superclass_pairs(spark, sf):
    e = table(spark, sf, "supplier").where(F.col("s_suppkey") > 0).select(F.col("s_suppkey").alias("a"), F.floor(F.col("s_suppkey") / 2).alias("b"))
    return G.superclasses(e)


@query("connected_components", """with recursive e0 as (select distinct o_custkey as a, o_custkey - o_custkey % 8 + o_orderkey % 8 as b from orders),
  e as (select a, b from e0 union select b, a from e0), r(node, c) as (select a, a from e union select r.node, e.b from r join e on e.a = r.c)
  select node, min(c) as component from r group by 1""")
def connected_components(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - F.col("o_custkey") % 8 + F.col("o_orderkey") % 8).alias("b"))
    return G.connected(edges)


@query("connected_parts", """select p_partkey as node, p_partkey % 7 as component from part""")
def connected_parts(spark, sf):
    e = table(spark, sf, "part").where(F.col("p_partkey") >= 7).select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 7).alias("b"))
    return G.connected(e)


@query("replacement_chains", """with d as (select p_partkey as k, case p_partkey % 8 when 1 then null when 2 then p_partkey when 3 then p_partkey + 1 when 4 then p_partkey - 1 when 5 then p_partkey - 1 when 6 then p_partkey + 1 when 7 then 0 end as nxt from part where p_partkey % 8 > 0),
  mx as (select max(p_partkey) as m from part)
  select k as node, 'REPLACEMENT_MISSING' as code from d where nxt is null
  union all select k, 'SELF_REPLACEMENT' from d where k % 8 = 2
  union all select k, 'REPLACEMENT_CYCLE' from d where k % 8 = 2 or (k % 8 = 3 and k + 1 <= (select m from mx)) or k % 8 = 4
  union all select k, 'TERMINAL_MISSING' from d where k % 8 in (2, 4, 5) or (k % 8 = 3 and k + 1 <= (select m from mx))""")
def replacement_chains(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    nxt = (F.when(k % 8 == 2, k).when(k % 8 == 3, k + 1).when(k % 8 == 4, k - 1).when(k % 8 == 5, k - 1).when(k % 8 == 6, k + 1).when(k % 8 == 7, 0))
    terms = p.select(k.alias("node"), (k % 8 > 0).alias("deprecated"))
    return G.replacement_chains(terms, p.select(k.alias("a"), nxt.cast("bigint").alias("b")).where(F.col("b").isNotNull()))


def list_quads(spark, sf) -> DataFrame:
    """Parts as linked lists of fifty."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    last = k % 50 == 49
    after = F.when(last, G.RDF + "nil").otherwise(F.concat(F.lit("cell"), (k + 1).cast("string")))
    q = statements(p, F.concat(F.lit("cell"), k.cast("string")), [(G.RDF + "first", F.col("p_name"), "literal", None, None), (G.RDF + "rest", after, "bnode", None, None)])
    return q.withColumn("s_kind", F.lit("bnode"))


@query("rdf_lists", """select 'cell' || (p_partkey // 50 * 50) as head, cast(p_partkey % 50 as bigint) as pos, p_name as value from part""")
def rdf_lists(spark, sf):
    members, _ = G.rdf_list(list_quads(spark, sf))
    return members.select("head", "pos", "value")


@query("rdf_list_faults", """select 'cell' || p_partkey as cell, 'LIST_CYCLE' as code from part where p_partkey % 10 < 5 union all select 'cell' || p_partkey, 'LIST_CARDINALITY' from part where p_partkey % 10 = 7""")
def rdf_list_faults(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    after = F.when(k % 10 == 4, F.concat(F.lit("cell"), (k - 4).cast("string"))).when(k % 10 < 4, F.concat(F.lit("cell"), (k + 1).cast("string"))).otherwise(G.RDF + "nil")
    second = F.when(k % 10 == 7, F.lit("again"))
    q = statements(p, F.concat(F.lit("cell"), k.cast("string")), [(G.RDF + "first", F.col("p_name"), "literal", None, None), (G.RDF + "first", second, "literal", None, None), (G.RDF + "rest", after, "bnode", None, None)])
    return G.rdf_list(q.withColumn("s_kind", F.lit("bnode")))[1].select("cell", "code")


def graphs_by_segment(spark, sf) -> DataFrame:
    return statements(table(spark, sf, "customer"), iri("c", "c_custkey"), [
        (G.RDF_TYPE, F.lit(EX + "Customer"), "iri", None, None), (EX + "name", F.col("c_name"), "literal", XSD + "string", None)], F.col("c_mktsegment"))


@query("graph_digest", """with l as (select distinct c_mktsegment as g, sha256(unnest(['<urn:x:c' || c_custkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:x:Customer> .',
    '<urn:x:c' || c_custkey || '> <urn:x:name> "' || c_name || '" .'])) as d from customer),
  c as (select g, d as p, d || ':1' as v, 1 as n from l), l1 as (select g, substr(p, 1, 5) as q, sha256(string_agg(v, chr(10) order by p)) as v, sum(n) as n from c group by 1, 2),
  l2 as (select g, substr(q, 1, 2) as r, sha256(string_agg(v, chr(10) order by q)) as v, sum(n) as n from l1 group by 1, 2)
  select g as graph, sha256(string_agg(v, chr(10) order by r)) as sha256, cast(sum(n) as bigint) as quads from l2 group by 1""")
def graph_digest(spark, sf):
    q = graphs_by_segment(spark, sf)
    return G.graph_digest(q.unionByName(q))


@query("same_graphs", """select 2 as graphs, 2 as digests, false as equal union all select 2, 1, true""")
def same_graphs(spark, sf):
    q = graphs_by_segment(spark, sf)
    copy = q.withColumn("graph", F.lit("copy")).unionByName(q.withColumn("graph", F.lit("first")))
    other = q.where(F.col("graph") == "BUILDING").withColumn("graph", F.lit("a")).unionByName(q.where(F.col("graph") == "MACHINERY").withColumn("graph", F.lit("b")))
    return G.same_graphs(copy).unionByName(G.same_graphs(other))


@query("union_of_graphs", """select 'merged' as graph, count(*) as quads, count(distinct s) as subjects from (select distinct '_:' || c_mktsegment || '_b' || (c_custkey % 40) as s, c_nationkey as o from customer)""")
def union_of_graphs(spark, sf):
    q = statements(table(spark, sf, "customer"), F.concat(F.lit("b"), (F.col("c_custkey") % 40).cast("string")), [(EX + "nation", iri("n", "c_nationkey"), "iri", None, None)], F.col("c_mktsegment")).withColumn("s_kind", F.lit("bnode"))
    merged = G.union_graphs(G.scope_blanks(q, F.col("graph")), name="merged")
    return merged.groupBy("graph").agg(F.count(F.lit(1)).alias("quads"), F.count_distinct("s").alias("subjects"))


def nested_shapes(spark, sf) -> DataFrame:
    """Parts as named nodes over two levels of anonymous ones that depend on brand and size alone."""
    p, k = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    top = statements(p, iri("p", "p_partkey"), [(EX + "shape", F.concat(F.lit("m"), k), "bnode", None, None)])
    mid = statements(p, F.concat(F.lit("m"), k), [(EX + "inner", F.concat(F.lit("l"), k), "bnode", None, None), (EX + "brand", F.col("p_brand"), "literal", None, None)]).withColumn("s_kind", F.lit("bnode"))
    low = statements(p, F.concat(F.lit("l"), k), [(EX + "size", text("p_size"), "literal", None, None)]).withColumn("s_kind", F.lit("bnode"))
    return top.unionByName(mid).unionByName(low)


@query("node_signatures", """select count(distinct (p_brand, p_size)) as signatures, count(*) as nodes from part""")
def node_signatures(spark, sf):
    sig = G.node_signature(nested_shapes(spark, sf)).where(F.col("s").startswith(EX + "p"))
    return sig.agg(F.count_distinct("signature").alias("signatures"), F.count(F.lit(1)).alias("nodes"))


@query("anonymous_anchors", """select 'm' || p_partkey as node, 'urn:x:p' || p_partkey || '|urn:x:shape' as anchor from part union all select 'l' || p_partkey, 'urn:x:p' || p_partkey || '|urn:x:shape|urn:x:inner' from part""")
def anonymous_anchors(spark, sf):
    return G.anchors(nested_shapes(spark, sf)).select("node", "anchor")


@query("rdf_shared_tails", """with p as (select p_partkey as k, p_name as v from part), m as (select max(p_partkey) as m from part)
  select 'cell' || (k // 50 * 50) as head, cast(k % 50 as bigint) as pos, v as value from p
  union all select 'side' || (k // 50 * 50 + 20), 1 + k % 50 - 20, v from p, m where k % 50 >= 20
  union all select 'side' || k, 0, 'side of ' || v from p where k % 50 = 20
  union all select 'cell' || (k // 50 * 50 + 35), k % 50 - 35, v from p where k % 50 >= 35""")
def rdf_shared_tails(spark, sf):
    """Lists that others join in the middle, and a middle that is itself pointed to: all have their whole tails."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    cell = F.concat(F.lit("cell"), k.cast("string"))
    side = statements(p.where(k % 50 == 20), F.concat(F.lit("side"), k.cast("string")), [(G.RDF + "first", F.concat(F.lit("side of "), F.col("p_name")), "literal", None, None), (G.RDF + "rest", cell, "bnode", None, None)]).withColumn("s_kind", F.lit("bnode"))
    use = statements(p.where(k % 50 == 35), iri("p", "p_partkey"), [(EX + "parts", cell, "bnode", None, None)])
    members, _ = G.rdf_list(list_quads(spark, sf).unionByName(side).unionByName(use))
    return members.select("head", "pos", "value")


@query("rdf_open_ends", """select 'cell' || p_partkey as cell, case when p_partkey % 20 = 9 then 'LIST_OPEN' else 'LIST_CYCLE' end as code from part where p_partkey % 20 = 9 or p_partkey % 20 >= 10""")
def rdf_open_ends(spark, sf):
    """Lists of ten: every other one ends at a node that is no cell, the others run into a cycle of their last three."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    after = F.when(k % 20 == 9, F.lit("nowhere")).when(k % 20 == 19, F.concat(F.lit("cell"), (k - 2).cast("string"))).otherwise(F.concat(F.lit("cell"), (k + 1).cast("string")))
    q = statements(p, F.concat(F.lit("cell"), k.cast("string")), [(G.RDF + "first", F.col("p_name"), "literal", None, None), (G.RDF + "rest", after, "bnode", None, None)])
    return G.rdf_list(q.withColumn("s_kind", F.lit("bnode")))[1].select("cell", "code")


@query("signature_classes", """select 'n' || p_partkey as s, 'n' || min(p_partkey) over (partition by p_partkey % 12, p_partkey % 4 = 3, case when p_partkey % 4 = 3 then p_size end) as like_node from part where p_partkey % 4 = 3
  union all select 'n' || p_partkey, 'n' || min(p_partkey) over (partition by p_partkey % 12) from part where p_partkey % 4 < 3""")
def signature_classes(spark, sf):
    """Anonymous nodes in rings of twelve kinds and beside them: which nodes are alike.

    Of every four nodes three lie on a ring whose nodes tell their place, the fourth holds a size.
    """
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    node = F.concat(F.lit("n"), k.cast("string"))
    ring = F.concat(F.lit("n"), F.when(k % 4 == 2, k - 2).otherwise(k + 1).cast("string"))
    q = statements(p, node, [(EX + "kind", (k % 12).cast("string"), "literal", None, None)]).unionByName(
        statements(p.where(k % 4 < 3), node, [(EX + "next", ring, "bnode", None, None)])).unionByName(
        statements(p.where(k % 4 == 3), node, [(EX + "size", text("p_size"), "literal", None, None)])).withColumn("s_kind", F.lit("bnode"))
    sig = G.node_signature(q)
    number = F.substring("s", 2, 20).cast("bigint")
    least = sig.groupBy("signature").agg(F.min(number).alias("_n"))
    return sig.join(least, "signature").select("s", F.concat(F.lit("n"), F.col("_n").cast("string")).alias("like_node"))


def chain_edges(spark, sf) -> DataFrame:
    """Parts as chains of five hundred towards the lower number, with a few bridges between chains."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    down = p.where(k % 500 != 0).select(k.alias("a"), (k - 1).alias("b"))
    return down.unionByName(p.where((k % 500 == 100) & (k >= 500)).select(k.alias("a"), (k - 400).alias("b")))


_CHAIN = """e as (select p_partkey as a, p_partkey - 1 as b from part where p_partkey % 500 <> 0 union all select p_partkey, p_partkey - 400 from part where p_partkey % 500 = 100 and p_partkey >= 500)"""


@query("reach_chains", f"""with recursive {_CHAIN}, r as (select p_partkey as start, p_partkey as node from part where p_partkey % 500 = 250 union select r.start, e.b from r join e on e.a = r.node) select start, node from r""")
def reach_chains(spark, sf):
    """What every asked node reaches along chains that no round follows link by link."""
    return G.reach_pairs(chain_edges(spark, sf), table(spark, sf, "part").where("p_partkey % 500 = 250").select(F.col("p_partkey").alias("node")))


@query("cycle_nodes", """select p_partkey as node, p_partkey % 40 < 13 as on_ring from part, (select max(p_partkey) as m from part) where p_partkey // 40 * 40 + 12 <= m and p_partkey % 40 <= 12
  or (p_partkey // 40 * 40 + 39 <= m and p_partkey % 40 between 30 and 39)""")
def cycle_nodes(spark, sf):
    """Rings of thirteen with tails, and rings of ten alone, by blocks of forty parts."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    ring = p.where(k % 40 < 12).select(k.alias("a"), (k + 1).alias("b")).unionByName(p.where(k % 40 == 12).select(k.alias("a"), (k - 12).alias("b")))
    tail = p.where((k % 40 > 12) & (k % 40 < 30)).select(k.alias("a"), F.when(k % 40 == 13, k - 13).otherwise(k - 1).alias("b"))
    alone = p.where((k % 40 >= 30) & (k % 40 < 39)).select(k.alias("a"), (k + 1).alias("b")).unionByName(p.where(k % 40 == 39).select(k.alias("a"), (k - 9).alias("b")))
    found = G.on_cycles(ring.unionByName(tail).unionByName(alone))
    return found.select("node", (F.col("node") % 40 < 13).alias("on_ring"))
