"""Text rules over ``documents``, ``conversations`` and ``pages``, always over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.functions import redaction as RD
from dataward.functions import sensitive as X
from dataward.operators import scans as S
from dataward.operators import text as T
from dataward.plans.registry import query
from dataward.sources.tables import table


def marked_up(spark, sf):
    """Documents as marked-up reports: every line keeps its words and gets a role by its number."""
    lines = F.split("text", "\n", -1)

    def role(x, i):
        m = (i + F.col("doc_id").cast("int")) % 12
        plain = F.concat(F.lit("x "), F.regexp_replace(x, r"[^a-zA-Z ]", ""))
        return (F.when(m == 0, F.concat(F.lit("# "), plain)).when(m == 1, F.concat(F.lit("## "), (i % 5).cast("string"), F.lit(". "), plain)).when(m == 2, F.concat(F.lit("### "), plain))
                .when(m == 3, F.concat(F.lit("- "), plain)).when(m == 4, F.lit("```")).when(m == 5, F.lit("")).when(m == 6, F.concat(F.lit("> "), plain))
                .when(m == 7, F.lit("| a | b |")).when(m == 8, F.lit("must hold SRC-1")).when(m == 9, F.lit("claims 25 % growth by NASA")).otherwise(plain))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(lines, role), "\n").alias("text"))


def typed(spark, sf):
    return T.line_types(marked_up(spark, sf))


_LINES = """ln as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
  r as (select doc_id, i, (i + doc_id) % 12 as m, 'x ' || regexp_replace(l, '[^a-zA-Z ]', '', 'g') as p from ln),
  f as (select *, sum(case when m = 4 then 1 else 0 end) over (partition by doc_id order by i) as fences from r),
  ty as (select *, i + 1 as line_no, case when m = 4 then 'fence' when fences % 2 = 1 then 'code' else case m when 0 then 'heading' when 1 then 'heading' when 2 then 'heading' when 3 then 'list' when 5 then 'blank' when 6 then 'blockquote' when 7 then 'table' else 'prose' end end as type,
    case m when 8 then 'must hold SRC-1' when 9 then 'claims 25 % growth by NASA' when 1 then (i % 5) || '. ' || p else p end as t0 from f),
  t as (select *, type in ('table', 'blockquote', 'code', 'blank', 'fence') as skip, trim(t0) as txt, case when type = 'heading' then m + 1 end as level from ty)"""


@query("numbered_lines", """select doc_id, count(*) as lines, cast(sum(length(l)) as bigint) as chars from (select doc_id, unnest(string_split(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10))) as l from documents) group by 1""")
def numbered_lines(spark, sf):
    return T.read_lines(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("raw")).alias("chars"))


@query("line_types", f"with {_LINES} select doc_id, line_no, type, level as heading_level, skip from t")
def line_types(spark, sf):
    return typed(spark, sf).select("doc_id", "line_no", "type", "heading_level", "skip")


@query("heading_findings", f"""with {_LINES}, h as (select *, lag(level) over w as bl, row_number() over w as o from t where type = 'heading' window w as (partition by doc_id order by line_no)),
  ones as (select doc_id, list(line_no order by line_no) as a from h where level = 1 group by 1), d as (select doc_id, min(line_no) filter (where type <> 'blank') as f from t group by 1),
  pd as (select d.doc_id, f, a, coalesce(len(a), 0) as n from d left join ones using (doc_id)), s as (select *, cast(i % 5 as bigint) as num from h where level = 2),
  s2 as (select *, coalesce(lag(num) over (partition by doc_id order by line_no) + 1, 1) as ex from s)
  select doc_id, coalesce(a[2], a[1], f, 1) as line_no, 'STR001' as rule, 'H1_COUNT' as detail from pd where n <> 1
  union all select h.doc_id, line_no, 'STR001', 'H1_NOT_FIRST' from h join pd on pd.doc_id = h.doc_id where n = 1 and o = 1 and level <> 1
  union all select doc_id, line_no, 'STR001', 'LEVEL_SKIPPED' from h where level > bl + 1 union all select doc_id, line_no, 'STR002', 'H2_SEQUENCE' from s2 where num <> ex""")
def heading_findings(spark, sf):
    return T.heading_findings(typed(spark, sf))


@query("evidence_proximity", f"""with {_LINES}, b as (select *, type in ('blank', 'heading') as br, sum(case when type in ('blank', 'heading') then 1 else 0 end) over (partition by doc_id order by line_no) as bc from t)
  select c.doc_id, c.line_no, coalesce(bool_or(k.line_no is not null and (k.line_no = c.line_no or (k.type = 'prose' and case when k.line_no > c.line_no then k.bc - cast(k.br as integer) - c.bc else c.bc - cast(c.br as integer) - k.bc end = 0))), false) as supported
  from b c left join b k on k.doc_id = c.doc_id and k.line_no between c.line_no - 3 and c.line_no + 3 and not k.skip and k.m = 8 where not c.skip and c.m = 9 group by 1, 2""")
def evidence_proximity(spark, sf):
    return T.near_marker(typed(spark, sf), r"\d+(?:\.\d+)?\s*%", r"SRC-[A-Z0-9-]+", r"(?i)^(?:evidence|source)\s*:", 3)


@query("acronym_findings", f"""with {_LINES}, u as (select doc_id, line_no, unnest(regexp_extract_all(txt, '\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*\\b')) as acronym from t where not skip)
  select doc_id, acronym, min(line_no) as line_no from u where acronym not in ('USA') and not regexp_matches(acronym, '^(?:(?:SRC|ADR|REQ|OPEN|C|T)-[A-Z0-9-]+|[PGL]\\d+|H[1-6]|[A-Z]|I{{1,3}}|IV|V|VI{{0,3}}|IX|X|AGREED|VERIFIED|FINALIZED|ERROR|MUST|GET|POST|PUT|PATCH|DELETE|AS-IS|TO-BE)$') group by 1, 2""")
def acronym_findings(spark, sf):
    return T.acronym_findings(typed(spark, sf), ["USA"])


@query("duplicate_sentences", f"""with {_LINES}, n as (select doc_id, line_no, trim(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g')) as s from t where not skip and type in ('prose', 'list') and length(txt) >= 40),
  g as (select doc_id, s, min(line_no) as first_line from n group by 1, 2) select doc_id, line_no, first_line from n join g using (doc_id, s) where line_no > first_line""")
def duplicate_sentences(spark, sf):
    return T.duplicate_sentences(typed(spark, sf))


@query("line_findings", f"""with {_LINES} select doc_id, line_no, unnest(list_filter([case when regexp_matches(txt, '(?i)\\bthe\\b') then 'R1' end, case when type = 'list' and regexp_matches(txt, 'n$') then 'R2' end,
    case when length(txt) > 120 then 'REG107' end, case when contains(txt, 'growth') then 'TRM103' end], lambda x: x is not null)) as rule from t where not skip and txt <> ''""")
def line_findings(spark, sf):
    rules = [T.LineRule("R1", r"(?i)\bthe\b"), T.LineRule("R2", "n$", only_lists=True)]
    return T.ordered_diagnostics(T.line_findings(typed(spark, sf), rules, 120, {"growth": "increase"})).select("doc_id", "line_no", "rule")


@query("text_profile", f"""with {_LINES}, c as (select * from t where not skip)
  select 'lines' as measure, 'all' as item, count(*) as value from t union all select 'lines', 'content', count(*) from c where txt <> '' union all select 'heading', cast(level as varchar), count(*) from c where level is not null group by level
  union all select 'list', '-', count(*) from c where type = 'list' union all select 'ending', case when regexp_matches(txt, '[aeiou]$') then 'vowel' else 'other' end, count(*) from c where txt <> '' group by 2
  union all select 'term', 'growth', count(*) from c where m = 9 union all select 'list_length', 'median', cast(quantile_disc(length(txt), 0.5) as bigint) from c where type = 'list'
  union all select 'list_length', 'p90', cast(quantile_disc(length(txt), 0.9) as bigint) from c where type = 'list' union all select 'list_length', 'max', cast(max(length(txt)) as bigint) from c where type = 'list'""")
def text_profile(spark, sf):
    return T.text_profile(typed(spark, sf), ["growth"], {"vowel": "[aeiou]$"})


@query("rule_severities", """select distinct source || '/' || lang as path, rule, case when rule = 'R1' then case when source = 'src1' and lang = 'de' then 'off' when source = 'src1' then 'info' else 'error' end else case when lang = 'fr' then 'warning' else 'off' end end as severity
  from documents, lateral (values ('R1'), ('R2')) v(rule)""")
def rule_severities(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("path")).distinct()
    return T.rule_config(docs, ["R1", "R2"], {"R1": "error"}, [
        {"files": ["src1/**"], "rules": {"R1": "info"}}, {"files": ["**/fr"], "rules": {"R2": "warning"}}, {"files": ["src1/d?"], "rules": {"R1": "off"}}])


@query("lint_gate", """select count(*) filter (where toxic = 1) as errors, count(*) filter (where toxic = 0 and quality = 0) as warnings, count(*) filter (where toxic = 0 and quality = 1) as infos,
  count(*) filter (where toxic = 1) = 0 and count(*) filter (where toxic = 0 and quality = 0) <= 1000000 as passed from labels""")
def lint_gate(spark, sf):
    found = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("info").alias("severity"))
    return T.lint_gate(found, "error", 1000000)


@query("blocked_claims")
def blocked_claims(spark, sf):
    return T.blocked_claims(table(spark, sf, "documents"), ["and the", "As Is", "the-best", "le la"])


#: The patterns of functions/sensitive.py for a dialect without look-behind.
SECRETS = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:authorization\s*:\s*bearer\s+[A-Za-z0-9._~+/=-]+)|(?:^|[^0-9A-Z])(?:AKIA|ASIA)[0-9A-Z]{16}(?:[^0-9A-Z]|$)|\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b|(?i:\b(?:binding|secret|vault)://)|(?i:\bjdbc:[a-z0-9]+:)"
PERSONAL = r"\b\d{6}[- ]?[1-8]\d{6}\b|(?:\+82\s*(?:\(\s*0\s*\)\s*)?1[016789]|01[016789])[-. ]?\d{3,4}[-. ]?\d{4}\b|(?:\+82[-. ]*(?:\(\s*0\s*\)[-. ]*)?(?:2|[3-6][1-5]|70))[-. ]?\d{3,4}[-. ]?\d{4}\b|\b0(?:2|[3-6][1-5]|70)[-. ]?\d{3,4}[-. ]?\d{4}\b|\b0\d{1,2}[-. ]\d{3,4}[-. ]\d{4}\b|(?i:[^\s<>@]+@[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?(?:[.][A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?)+\b)"


def quoted(p):
    return p.replace("'", "''")


@query("sensitive_documents", f"""select doc_id, regexp_matches(text, '{quoted(SECRETS)}') as has_secret, regexp_matches(text, '{quoted(PERSONAL)}') as has_personal from documents""")
def sensitive_documents(spark, sf):
    return X.sensitive_kinds(table(spark, sf, "documents"), "text").select("doc_id", "has_secret", "has_personal")


@query("redacted_conversations", f"""select conv_id, turn, regexp_replace(text, '(?i)(?:bearer\\s+[a-z0-9._~+/-]+=*|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?:password|secret|token|api[-_]?key)\\s*[=:]\\s*\\S+)', '[REDACTED]', 'g') as text from conversations""")
def redacted_conversations(spark, sf):
    return RD.redact(table(spark, sf, "conversations"), ["text"]).select("conv_id", "turn", "text")


@query("span_attributes", """select event_id, 'service.name=web' || case when event_type = 'error' then ',error.type=[REDACTED]' else '' end as attributes from events""")
def span_attributes(spark, sf):
    e = table(spark, sf, "events")
    attrs = F.create_map(F.lit("service.name"), F.lit("web"), F.lit("user.password"), F.lit("x"), F.lit("tenant_id"), F.col("user_id").cast("string"),
                         F.when(F.col("event_type") == "error", "error.type").otherwise("other.key"), F.lit("token=abc"))
    kept = RD.allow_attributes(attrs)
    return e.select("event_id", F.array_join(F.transform(F.map_entries(kept), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("attributes"))


@query("nested_secrets", """select event_id, 'record.items[0].apiKey' as path, 'INLINE_SECRET_FIELD' as code from events where event_id % 7 = 1 union all select event_id, 'record.items[1]', 'INLINE_SECRET_VALUE' from events where event_id % 11 = 2""")
def nested_secrets(spark, sf):
    n = F.col("event_id")
    item = F.concat(F.lit('{"'), F.when(n % 7 == 1, "apiKey").otherwise("name"), F.lit('":"v"}'))
    doc = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"items":['), item, F.lit(',"'), F.when(n % 11 == 2, "password=hunter22").otherwise("plain"), F.lit('"]}'))
    return X.scan_nested_secrets(table(spark, sf, "events").select("event_id", doc.alias("doc")), "doc", ["event_id"])


def scan_reports(spark, sf):
    """Orders as artifacts; their lines are the findings, in arrays of fixed width."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    vuln = F.when(k % 3 == 0, F.array(F.struct(F.lit("CVE-1").alias("VulnerabilityID"), F.when(p > 400000, "high").when(p > 300000, "low").alias("Severity"))))
    conf = F.when(k % 4 == 0, F.array(F.struct(F.lit("CFG-1").alias("ID"), F.lit("MEDIUM").alias("Severity"))))
    sec = F.when(k % 50 == 0, F.array(F.struct(F.lit("SEC-1").alias("RuleID"), F.lit(None).cast("string").alias("Severity"))))
    result = F.struct(F.lit("image").alias("Target"), vuln.alias("Vulnerabilities"), conf.alias("Misconfigurations"), sec.alias("Secrets"))
    return table(spark, sf, "orders").select(k.cast("string").alias("artifact"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("databaseUpdatedAt"), F.array(result).alias("Results"))


@query("scan_findings", """select scanner, severity, count(*) as findings from (select 'vulnerability' as scanner, case when o_totalprice > 400000 then 'HIGH' when o_totalprice > 300000 then 'LOW' else 'UNKNOWN' end as severity from orders where o_orderkey % 3 = 0
  union all select 'misconfiguration', 'MEDIUM' from orders where o_orderkey % 4 = 0 union all select 'secret', 'CRITICAL' from orders where o_orderkey % 50 = 0) group by 1, 2""")
def scan_findings(spark, sf):
    return S.scan_findings(scan_reports(spark, sf)).groupBy("scanner", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("scan_gate", """with b as (select *, case when o_orderkey % 3 = 0 and (o_totalprice > 400000 or o_totalprice <= 300000) then 1 else 0 end + case when o_orderkey % 50 = 0 then 1 else 0 end as n from orders)
  select cast(o_orderkey as varchar) as artifact, n as blocking, case when o_orderdate > timestamp '1999-01-01 00:05:00' or o_orderdate < timestamp '1999-01-01' - to_hours(24000) then 'stale' when n > 0 then 'blocked' else 'pass' end as decision from b""")
def scan_gate(spark, sf):
    return S.scan_gate(scan_reports(spark, sf), "1999-01-01 00:00:00", 24000)
