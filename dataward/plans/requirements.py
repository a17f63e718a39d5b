"""Requirements from shapes made of parts, cases derived for them from suppliers, and the decisions on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.operators import requirements as R
from dataward.operators.diff import decision_matrix
from dataward.operators.graph import RDF, RDF_TYPE
from dataward.plans.registry import query
from dataward.sources.tables import table

NS, REQ = "urn:sh:", "urn:x:requirementId"
#: Path steps in the order in which the nodes of a chain take them.
STEPS = ("inversePath", "zeroOrMorePath", "oneOrMorePath", "zeroOrOnePath")


def shape_quads(spark, sf):
    """A node shape per part with one property shape, whose path nests up to four steps, sometimes in a list."""
    k, z = F.col("p_partkey"), F.col("p_size")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    depth = z % 5
    leaf = F.when((k % 11 == 0) & (depth > 0), F.struct(t("c", k, "_0").alias("o"), F.lit("bnode").alias("kind"))).otherwise(F.struct(t("urn:x:p", z).alias("o"), F.lit("iri").alias("kind")))
    top = F.when(depth > 0, F.struct(t("c", k, "_0").alias("o"), F.lit("bnode").alias("kind"))).otherwise(leaf)
    listed, either = (k % 3 == 0) | (k % 6 == 1), k % 6 == 1
    path = F.when(either, F.struct(t("a", k).alias("o"), F.lit("bnode").alias("kind"))).when(listed, F.struct(t("l", k, "_0").alias("o"), F.lit("bnode").alias("kind"))).otherwise(top)

    def row(s, s_kind, p, o, o_kind, when=None):
        cell = F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"),
                        (F.lit(o_kind) if isinstance(o_kind, str) else o_kind).alias("o_kind"))
        return cell if when is None else F.when(when, cell)

    shape, prop, cell0, cell1 = t(NS + "N", k), t("p", k), t("l", k, "_0"), t("l", k, "_1")
    sh = R.SH
    fixed = [
        row(shape, "iri", RDF_TYPE, F.lit(sh + "NodeShape"), "iri"), row(shape, "iri", sh + "targetClass", t("urn:x:T", z % 7), "iri"), row(shape, "iri", sh + "property", prop, "bnode"),
        row(shape, "iri", sh + "closed", F.lit("true"), "literal", k % 4 == 0), row(prop, "bnode", RDF_TYPE, F.lit(sh + "PropertyShape"), "iri", k % 8 == 0),
        row(prop, "bnode", sh + "path", path["o"], path["kind"]), row(prop, "bnode", sh + "minCount", z % 3, "literal", z % 6 != 0), row(prop, "bnode", sh + "maxCount", z % 4, "literal", z % 4 != 3),
        row(prop, "bnode", sh + "minCount", F.lit("9"), "literal", z % 10 == 1), row(prop, "bnode", sh + "datatype", F.lit("urn:x:string"), "iri", z % 2 == 0), row(prop, "bnode", sh + "class", t("urn:x:K", z % 3), "iri"),
        row(prop, "bnode", sh + "hasValue", F.lit("urn:x:v"), "iri", z % 5 == 1), row(prop, "bnode", sh + "in", t("i", k, "_0"), "bnode", z % 9 == 2), row(prop, "bnode", sh + "in", F.lit(RDF + "nil"), "iri", z % 9 == 3),
        row(t("i", k, "_0"), "bnode", RDF + "first", F.lit("urn:x:w"), "iri", z % 9 == 2), row(t("i", k, "_0"), "bnode", RDF + "rest", t("i", k, "_1"), "bnode", z % 9 == 2),
        row(t("i", k, "_1"), "bnode", RDF + "first", F.lit("urn:x:b"), "iri", z % 9 == 2), row(t("i", k, "_1"), "bnode", RDF + "rest", F.lit(RDF + "nil"), "iri", z % 9 == 2),
        row(prop, "bnode", sh + "severity", F.when(k % 5 == 1, sh + "Info").otherwise(sh + "Warning"), "iri", k % 5 < 3), row(prop, "bnode", sh + "severity", F.lit(sh + "Violation"), "iri", k % 20 == 2),
        row(prop, "bnode", REQ, t("REQ-", k), "literal"), row(t("a", k), "bnode", sh + "alternativePath", cell0, "bnode", either),
        row(cell0, "bnode", RDF + "first", F.lit("urn:x:first"), "iri", listed), row(cell0, "bnode", RDF + "rest", cell1, "bnode", listed),
        row(cell1, "bnode", RDF + "first", top["o"], top["kind"], listed), row(cell1, "bnode", RDF + "rest", F.lit(RDF + "nil"), "iri", listed)]
    steps = F.array(*[F.lit(sh + s) for s in STEPS])
    chain = F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth.cast("int") - 1), lambda j: F.struct(
        t("c", k, "_", j).alias("s"), F.lit("bnode").alias("s_kind"), F.get(steps, ((k + j) % 4).cast("int")).alias("p"),
        F.when(j < depth - 1, t("c", k, "_", j + 1)).otherwise(leaf["o"]).alias("o"), F.when(j < depth - 1, F.lit("bnode")).otherwise(leaf["kind"]).alias("o_kind"))))
    cells = F.concat(F.array_compact(F.array(*fixed)), F.coalesce(chain, F.array().cast("array<struct<s:string,s_kind:string,p:string,o:string,o_kind:string>>")))
    return table(spark, sf, "part").select(F.explode(cells).alias("x")).select(F.lit("main").alias("graph"), "x.*")


_CHAIN = """steps as (select p_partkey as k, p_size as z, p_size % 5 as d from part),
  chain as (select k, z, d, d as j, 'urn:x:p' || z as t from steps where not (k % 11 = 0 and d > 0) union all
    select k, z, d, j - 1, case (k + j - 1) % 4 when 0 then '^' || t when 1 then '(' || t || ')*' when 2 then '(' || t || ')+' else '(' || t || ')?' end from chain where j > 0),
  tops as (select k, z, t from chain where j = 0 union all select k, z, '_:unsupported(c' || k || '_0)' from steps where k % 11 = 0 and d > 0)"""


@query("shape_requirements", f"""with recursive {_CHAIN},
  b as (select k, z, case when k % 6 = 1 then '(urn:x:first|' || t || ')' when k % 3 = 0 then '(urn:x:first/' || t || ')' else t end as path, case when z % 10 = 1 then null when z % 6 = 0 then null else z % 3 end as least,
    case when z % 4 <> 3 then z % 4 end as most, case when k % 20 = 2 then null when k % 5 = 1 then 'Info' when k % 5 in (0, 2) then 'Warning' else 'Violation' end as severity from tops),
  p as (select 'p' || k as node, case when k % 8 = 0 then 'property-shape' else 'direct-property-constraint' end as kind, 'urn:sh:N' || k as owner, 'REQ-' || k as requirements, path, least as minimum, most as maximum,
    'urn:x:K' || (z % 3) || case when z % 2 = 0 then ' urn:x:string' else '' end as range,
    concat_ws(' ', case when z % 9 = 2 then 'urn:x:b' end, case when z % 5 = 1 then 'urn:x:v' end, case when z % 9 = 2 then 'urn:x:w' end) as vocabulary, severity, most = 0 or z % 9 = 3 as bans, k from b),
  n as (select owner as node, 'node-shape' as kind, owner, '' as requirements, null as path, null as minimum, null as maximum, '' as range, '' as vocabulary, coalesce(severity, 'Violation') as severity, maximum is not distinct from 0 as bans, k from p where k % 4 = 0)
  select node, kind, owner, requirements, path, cast(minimum as bigint) as minimum, cast(maximum as bigint) as maximum, range, vocabulary, severity,
    case when severity = 'Info' then 'MAY' when severity = 'Warning' then 'SHOULD' else 'MUST' end || case when coalesce(bans, false) and severity is distinct from 'Info' then '-NOT' else '' end as obligation
  from (select * from p union all select * from n)""")
def shape_requirements(spark, sf):
    found = R.shape_requirements(shape_quads(spark, sf), NS, REQ)
    joined = lambda c: F.array_join(c, " ").alias(c)
    return found.select("node", "kind", "owner", F.array_join("requirement_ids", " ").alias("requirements"), "path", "minimum", "maximum", joined("range"), joined("vocabulary"), "severity", "obligation")


def case_tables(spark, sf):
    """Parts as requirements, suppliers as fixtures, regions and nations as profiles."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    n = 100
    reqs = table(spark, sf, "part").select(
        F.concat(F.lit("REQ-"), k.cast("string")).alias("requirement_id"), F.when(k % 97 != 0, F.concat(F.lit("F"), (k % n).cast("string"))).alias("positive_fixture_id"),
        F.concat(F.lit("F"), (k * 7 % (n + 3)).cast("string")).alias("negative_fixture_id"), F.array(name(k % 5), name(F.col("p_size") % 25)).alias("profiles"))
    again = F.explode(F.when(s % 50 == 49, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    fixtures = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", again.alias("_copy")).select(
        F.concat(F.lit("F"), s.cast("string")).alias("fixture_id"), F.when(s % 3 == 0, "violates").otherwise("conforms").alias("expected"), F.sha2(s.cast("string"), 256).alias("sha256"),
        F.array(name(F.col("s_nationkey")), name(s % 26)).alias("profiles"))
    profiles = table(spark, sf, "nation").select(name(F.col("n_nationkey")).alias("profile"), F.when(F.col("n_nationkey") % 6 == 5, "diagnostic").otherwise("released").alias("kind"))
    return reqs, fixtures, profiles


_CASES = """q as (select 'REQ-' || p_partkey as r, case when p_partkey % 97 <> 0 then 'F' || (p_partkey % 100) end as pos, 'F' || (p_partkey * 7 % 103) as neg, list_distinct(['p' || (p_partkey % 5), 'p' || (p_size % 25)]) as ps from part),
  fx as (select 'F' || s_suppkey as f, case when s_suppkey % 3 = 0 then 'violates' else 'conforms' end as expected, sha256(cast(s_suppkey as varchar)) as h, list_distinct(['p' || s_nationkey, 'p' || (s_suppkey % 26)]) as ps, s_suppkey % 50 = 49 as twice from supplier),
  pr as (select 'p' || n_nationkey as p, n_nationkey % 6 <> 5 as runs from nation),
  a as (select r, pos as f, 'conforms' as role, ps from q union all select r, neg, 'violates', ps from q),
  g as (select a.r, a.f, fx.expected, fx.h, fx.ps as fps, a.ps as rps from a join fx on fx.f = a.f where not twice and role = expected),
  k as (select distinct r, f, expected, h, p from (select r, f, expected, h, rps, unnest(fps) as p from g) x where list_contains(rps, p) and p in (select p from pr where runs))"""


@query("derived_cases", f"""with {_CASES} select 'FULL-' || f || '-' || upper(p) as case_id, f as fixture_id, p as profile, any_value(expected) as expected, any_value(h) as sha256, count(*) as requirements from k group by 1, 2, 3""")
def derived_cases(spark, sf):
    return R.derive_cases(*case_tables(spark, sf))[0]


@query("derived_case_faults", f"""with {_CASES}, pl as (select distinct f, p from (select f, unnest(fps) as p from g) x where p in (select p from pr where runs)),
  rq as (select distinct r from (select r, unnest(ps) as p from q) x where p in (select p from pr where runs))
  select 'FIXTURE_MISSING' as code, r as subject from a where f is null union select 'FIXTURE_UNKNOWN', f from a where f is not null and f not in (select f from fx) union select 'FIXTURE_REPEATED', f from fx where twice
  union select 'OUTCOME_MISMATCH', a.f from a join fx on fx.f = a.f where not twice and role <> expected
  union select 'PROFILE_UNKNOWN', p from (select unnest(ps) as p from q union all select unnest(ps) from fx) x where p not in (select p from pr)
  union select 'FIXTURE_WITHOUT_PROFILE', f from g where f not in (select f from pl) union select 'CASE_WITHOUT_REQUIREMENT', 'FULL-' || f || '-' || upper(p) from pl where (f, p) not in (select f, p from k)
  union select 'NO_POSITIVE_CASE', r from rq where r not in (select r from k where expected = 'conforms') union select 'NO_NEGATIVE_CASE', r from rq where r not in (select r from k where expected = 'violates')""")
def derived_case_faults(spark, sf):
    return R.derive_cases(*case_tables(spark, sf))[2]


@query("derived_decisions", f"""with {_CASES}, c as (select distinct f, p, expected, cast(substr(f, 2) as bigint) as s from k),
  e as (select 'FULL-F' || l_suppkey || '-P' || (l_orderkey % 25) as case_id, count(distinct l_linenumber % 3) as answered, count(distinct l_returnflag = 'R') as decisions, bool_or(l_returnflag = 'R') as bad from lineitem group by 1)
  select 'FULL-' || f || '-' || upper(p) as case_id, expected, case when coalesce(answered, 0) < 3 then 'incomplete' when decisions > 1 then 'disagree' when bad <> (expected = 'violates') then 'unexpected' else 'agreed' end as verdict
  from c left join e on e.case_id = 'FULL-' || f || '-' || upper(p)""")
def derived_decisions(spark, sf):
    """Order lines stand for the engines' answers on the derived cases."""
    cases = R.derive_cases(*case_tables(spark, sf))[0]
    answers = table(spark, sf, "lineitem").select(
        F.concat(F.lit("FULL-F"), F.col("l_suppkey").cast("string"), F.lit("-P"), (F.col("l_orderkey") % 25).cast("string")).alias("case_id"), (F.col("l_linenumber") % 3).alias("engine"),
        F.when(F.col("l_returnflag") == "R", "violates").otherwise("conforms").alias("decision"))
    return decision_matrix(cases, answers, 3).select("case_id", "expected", "verdict")
