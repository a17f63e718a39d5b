"""Report language rules over ``documents``: every line is kept whole, marks are put before, behind or between lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.functions.lineage import stored
from dataward.operators import report_rules as R
from dataward.operators import text as T
from dataward.plans.registry import query
from dataward.sources.tables import table

CODE_MARK = "```"
TERMS = {"Nation": "nation", "the ": "The "}


def reported(spark, sf):
    """Documents as reports. Line ``i`` keeps all its characters; its number decides which marks stand around it."""
    lines = F.split("text", "\n", -1)

    def role(x, i):
        m, nl = (i + F.col("doc_id")) % 17, F.lit("\n")
        put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return (F.when(m == 0, put("# ", x)).when(m == 1, put("### 1.1 원문 인용\n", x)).when(m == 2, put("#### ", x)).when(m == 3, put("- ", x))
                .when(m == 5, put("## ", (i % 5 + 1).cast("string"), ". ", x)).when(m == 6, put(CODE_MARK + "\n", x, "\n" + CODE_MARK)).when(m == 7, put("\n> ", x))
                .when(m == 8, put("| ", x, " |")).when(m == 9, put(x, "\n검증: 통과 SRC-1")).when(m == 10, put(x, " 25 %"))
                .when(m == 11, put("- Connector는 반드시 안전해야 함\n", F.when(i % 2 == 0, "- 시험: 오류 0건\n").otherwise(""), x))
                .when(m == 12, put("<!-- report-style-disable-next-line REG106,REG108: reviewed -->\n강력한 ", x, " 12%")).when(m == 13, put("- 메타데이터 연계 고도화\n", x))
                .when(m == 14, put(x, nl, x)).when(m == 15, put("오늘은 확인했습니다.\n대상 문장: ", x)).when(m == 16, put("### 추가 범위\n", x)).otherwise(x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(lines, role), "\n").alias("text"))


def typed(spark, sf):
    return T.line_types(reported(spark, sf))


def _q(pattern: str) -> str:
    """A pattern as an SQL string, without look-around."""
    return "'" + pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace(r"(?<!\d)", "(?:^|[^0-9])").replace("'", "''") + "'"


def _masked(x: str) -> str:
    for pattern, to in (("<!--.*?-->", " "), ("`[^`]*`", " "), (r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[([^\]]+)\]\(([^\)]*)\)", r"\1"), (r"https?://[^\s)>]+", " "), ("[*_~]", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"trim({x})"


_HEADING = "'^ {0,3}(#{1,6})(?:[ \\t]+(.*)|[ \\t]*)$'"
_LIST = "'^(\\s*)([-+*]|\\d+\\.)\\s+(.+)$'"
_LINES = f"""src as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: case (j - 1 + doc_id) % 17
    when 0 then '# ' || x when 1 then '### 1.1 원문 인용' || chr(10) || x when 2 then '#### ' || x when 3 then '- ' || x when 5 then '## ' || ((j - 1) % 5 + 1) || '. ' || x
    when 6 then '{CODE_MARK}' || chr(10) || x || chr(10) || '{CODE_MARK}' when 7 then chr(10) || '> ' || x when 8 then '| ' || x || ' |' when 9 then x || chr(10) || '검증: 통과 SRC-1'
    when 10 then x || ' 25 %' when 11 then '- Connector는 반드시 안전해야 함' || chr(10) || case when (j - 1) % 2 = 0 then '- 시험: 오류 0건' || chr(10) else '' end || x
    when 12 then '<!-- report-style-disable-next-line REG106,REG108: reviewed -->' || chr(10) || '강력한 ' || x || ' 12%' when 13 then '- 메타데이터 연계 고도화' || chr(10) || x
    when 14 then x || chr(10) || x when 15 then '오늘은 확인했습니다.' || chr(10) || '대상 문장: ' || x when 16 then '### 추가 범위' || chr(10) || x else x end), chr(10)) as t from documents),
  r as (select doc_id, unnest(string_split(t, chr(10))) as raw, generate_subscripts(string_split(t, chr(10)), 1) as line_no from src),
  f as (select *, regexp_matches(raw, '^ {{0,3}}(```|~~~)') as fence, sum(case when regexp_matches(raw, '^ {{0,3}}(```|~~~)') then 1 else 0 end) over (partition by doc_id order by line_no) as n from r),
  y as (select *, case when fence then 'fence' when n % 2 = 1 then 'code' when trim(raw) = '' then 'blank' when regexp_matches(raw, {_HEADING}) then 'heading'
      when not regexp_matches(raw, {_LIST}) and regexp_matches(raw, '^(?: {{4}}|\\t)') then 'code' when regexp_matches(raw, '^\\s*\\|.*\\|\\s*$') then 'table' when regexp_matches(raw, '^\\s*>') then 'blockquote'
      when regexp_matches(trim(raw), '^<!--.*-->$') then 'comment' when regexp_matches(raw, {_LIST}) then 'list' else 'prose' end as type from f),
  x as (select *, case when type = 'heading' then length(regexp_extract(raw, {_HEADING}, 1)) end as level, case type when 'heading' then {_masked(f"regexp_extract(raw, {_HEADING}, 2)")}
      when 'list' then {_masked(f"regexp_extract(raw, {_LIST}, 3)")} else {_masked("raw")} end as txt, {_masked("raw")} as masked from y),
  q as (select *, type = 'heading' and regexp_matches(txt, {_q(T.QUOTED_SECTION)}) as opens from x),
  hs as (select * from q where type = 'heading'),
  iv as (select a.doc_id, a.line_no as s, min(b.line_no) as e from hs a left join hs b on b.doc_id = a.doc_id and b.line_no > a.line_no and (b.level <= a.level or b.opens) where a.opens group by 1, 2),
  t as (select q.*, type in ('table', 'blockquote', 'comment', 'code', 'blank', 'fence') or (type <> 'heading' and iv.s is not null) or regexp_matches(masked, {_q(T.QUOTED_LINE)}) as skip
    from q left join iv on iv.doc_id = q.doc_id and q.line_no > iv.s and (iv.e is null or q.line_no < iv.e))"""


@query("report_line_types", f"with {_LINES} select doc_id, line_no, type, level as heading_level, case when type = 'heading' then txt end as heading_text, sha256(raw) as raw_sha256, skip from t")
def report_line_types(spark, sf):
    return typed(spark, sf).select("doc_id", "line_no", "type", "heading_level", "heading_text", F.sha2("raw", 256).alias("raw_sha256"), "skip")


def _place(pattern: str) -> str:
    at = "^(.*?)" + pattern
    return f"case when regexp_matches(raw, {_q(at)}) then length(regexp_extract(raw, {_q(at)}, 1)) + 1 else 1 end"


def _rule(r: R.ReportRule) -> str:
    """A rule as an SQL expression: its column, or null where the line keeps it."""
    at = "case " + " ".join(f"when regexp_matches(txt, {_q(p)}) then {_place(p) if r.placed else '1'}" for p in r.patterns) + " end"
    holds = (["type = 'list'"] if r.only_lists else []) + (["type <> 'heading'"] if r.not_headings else []) + ([f"not regexp_matches(txt, {_q(r.unless)})"] if r.unless else [])
    if r.near:
        holds.append("not evident" if r.near == R.EVIDENCE else "not accepted")
    return f"{{'rule': '{r.rule_id}', 'col_no': case when {' and '.join(holds or ['true'])} then {at} end}}"


def _near(name: str, near: tuple[str, str]) -> str:
    marker, label = near
    return (f"{name} as (select distinct c.doc_id, c.line_no from br c join br k on k.doc_id = c.doc_id and k.line_no between c.line_no - 3 and c.line_no + 3 and not k.skip and regexp_matches(k.raw, {_q(marker)}) "
            f"where c.line_no = k.line_no or ((case when k.line_no > c.line_no then k.upto - cast(k.b as integer) - c.upto else c.upto - cast(c.b as integer) - k.upto end) = 0 "
            f"and case when c.type = 'list' then k.type = 'list' and regexp_matches(k.txt, {_q(label)}) else k.type = 'prose' or regexp_matches(k.txt, {_q(label)}) end))")


_POLITE = "regexp_replace(txt, '[.!?]+$', '')"
_FINDINGS = f"""with {_LINES}, br as (select *, type in ('blank', 'heading') as b, sum(case when type in ('blank', 'heading') then 1 else 0 end) over (partition by doc_id order by line_no) as upto,
    string_split(coalesce(lag(regexp_extract(raw, '<!--\\s*report-style-disable-next-line\\s+([A-Z0-9,-]+)\\s*:\\s*.+?\\s*-->', 1)) over (partition by doc_id order by line_no), ''), ',') as off from t),
  {_near("ev", R.EVIDENCE)}, {_near("ac", R.ACCEPTANCE)},
  nm as (select doc_id, line_no, trim(regexp_replace(lower(txt), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as s from t where not skip and type in ('prose', 'list') and length(txt) >= 40 and not regexp_matches(txt, '^근거\\s*:')),
  rp as (select doc_id, line_no, min(line_no) over (partition by doc_id, s) as first_line from nm),
  j as (select br.*, ev.line_no is not null as evident, ac.line_no is not null as accepted, rp.line_no > rp.first_line as again from br left join ev using (doc_id, line_no) left join ac using (doc_id, line_no)
    left join rp using (doc_id, line_no) where not skip and txt <> ''),
  h as (select doc_id, line_no, off, unnest([{", ".join(_rule(r) for r in R.REPORT_RULES)},
    {{'rule': 'REG102', 'col_no': case when regexp_matches({_POLITE}, '{R.POLITE}') or (regexp_matches({_POLITE}, '(?:니다|니까)$') and unicode(substr({_POLITE}, -3, 1)) between 44032 and 55203
      and (unicode(substr({_POLITE}, -3, 1)) - 44032) % 28 = 17) then {_place(R.POLITE_PLACE)} end}},
    {{'rule': 'REG107', 'col_no': case when length(txt) > 180 then 1 end}}, {{'rule': 'REG109', 'col_no': case when again then 1 end}},
    {{'rule': 'REG108', 'col_no': case when len(string_split(txt, '및')) > 3 or len(string_split(txt, ',')) > 5 or len(string_split(txt, '(')) > 3 then 1 end}},
    {", ".join(f"{{'rule': 'TRM103', 'col_no': case when contains(txt, '{v}') then greatest(1, strpos(raw, '{v}')) end}}" for v in TERMS)}]) as u from j)
  select doc_id, line_no, cast(u.col_no as integer) as col_no, u.rule as rule from h where u.col_no is not null and not list_contains(off, u.rule) and not list_contains(off, 'ALL')"""


@query("report_findings", _FINDINGS)
def report_findings(spark, sf):
    return R.report_findings(typed(spark, sf), terms=TERMS)


@query("report_sections", f"""with {_LINES}, h as (select *, lag(level) over w as bl, row_number() over w as o from t where type = 'heading' window w as (partition by doc_id order by line_no)),
  d as (select doc_id, min(line_no) filter (where type <> 'blank') as f, list(line_no order by line_no) filter (where level = 1) as a, min(line_no) filter (where level = 2) as h2,
    coalesce(bool_or(type = 'heading' and line_no <= 30 and regexp_matches(txt, '{R.PURPOSE}')), false) as named from t group by 1),
  s as (select *, try_cast(nullif(regexp_extract(txt, '^(\\d+)\\.\\s', 1), '') as bigint) as num from h where level = 2),
  s2 as (select *, coalesce(lag(num) over (partition by doc_id order by line_no) + 1, 1) as ex from s where num is not null)
  select doc_id, coalesce(a[2], a[1], f, 1) as line_no, 'STR001' as rule from d where coalesce(len(a), 0) <> 1
  union all select doc_id, line_no, 'STR001' from h join d using (doc_id) where len(a) = 1 and o = 1 and level <> 1
  union all select doc_id, line_no, 'STR001' from h where level > bl + 1 union all select doc_id, line_no, 'STR002' from s where num is null union all select doc_id, line_no, 'STR002' from s2 where num <> ex
  union all select doc_id, line_no, 'STR003' from h where level >= 3 and not regexp_matches(txt, '^\\d+(?:\\.\\d+)+\\.?\\s|^[A-Z]{{1,8}}-\\d+[A-Z]?(?:-\\d+)?\\.\\s|^[가-힣]\\.\\s|^\\(\\d+\\)\\s')
  union all select doc_id, coalesce(h2, f, 1), 'STR004' from d where not named""")
def report_sections(spark, sf):
    # Lines are typed once; both sets of rules read the stored headings.
    heads = stored(T.outline(typed(spark, sf)))
    return T.heading_findings(heads).select("doc_id", "line_no", "rule").unionByName(R.section_findings(heads))


@query("report_acronyms", f"""with {_LINES}, v as (select doc_id, line_no, txt from t where not skip),
  u as (select doc_id, line_no, unnest(regexp_extract_all(txt, '\\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*\\b')) as acronym from v),
  m as (select doc_id, unnest(list_concat(regexp_extract_all(txt, '[A-Za-z][A-Za-z0-9\\s-]{{2,}}\\(([A-Z][A-Z0-9-]{{1,9}})\\)', 1), regexp_extract_all(txt, '\\([^()]{{2,}},\\s*([A-Z][A-Z0-9-]{{1,9}})\\)', 1))) as acronym, line_no from v),
  g as (select doc_id, acronym, min(line_no) as at from m group by 1, 2),
  n as (select doc_id, acronym, min(line_no) as line_no from u where not regexp_matches(acronym, {_q(T.IDENTIFIER)}) group by 1, 2)
  select doc_id, acronym, line_no from n left join g using (doc_id, acronym) where g.at is null or line_no < g.at""")
def report_acronyms(spark, sf):
    return T.acronym_findings(typed(spark, sf), [])


@query("report_profile", f"""with {_LINES}, c as (select * from t where not skip), l as (select length(txt) as n from c where type = 'list')
  select 'lines' as measure, 'all' as item, count(*) as value from t union all select 'lines', 'content', count(*) from c where txt <> '' union all select 'heading', cast(level as varchar), count(*) from c where level is not null group by level
  union all select 'list', '-', count(*) from c where type = 'list' union all select 'ending', case when regexp_matches(txt, '(?:함|임|음|됨)$') then 'noun' when regexp_matches(txt, '다[.]?$') then 'plain' else 'other' end, count(*) from c where txt <> '' group by 2
  union all select 'term', '강력한', cast(sum(len(string_split(txt, '강력한')) - 1) as bigint) from c where contains(txt, '강력한') having count(*) > 0
  union all select 'list_length', 'median', cast(quantile_disc(n, 0.5) as bigint) from l union all select 'list_length', 'p90', cast(quantile_disc(n, 0.9) as bigint) from l union all select 'list_length', 'max', cast(max(n) as bigint) from l""")
def report_profile(spark, sf):
    return T.text_profile(typed(spark, sf), ["강력한"], {"noun": "(?:함|임|음|됨)$", "plain": "다[.]?$"})
