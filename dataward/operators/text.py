"""Document text: numbered lines, line types, structure rules, evidence proximity, profiles, claims.

Windows here are per document. A document is one text cell, so its lines are bounded by the size of
a cell, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.functions.barrier import once
from dataward.functions.unicode import nfkc, nfkd

# Line forms, metadata labels, acronyms that need no definition, the suppression mark, and the headings and
# lines that quote text in order to criticise it.
FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*)|[ \t]*)$"
LIST = r"^(\s*)([-+*]|\d+\.)\s+(.+)$"
REPORT_MARKER = r"^\s*(□|○|ㅇ|•|⦁)\s*(.+)$"
METADATA = r"(?i)^(?:작성일|작성 기준|기준일|상태|단계|작성자|프로파일|분석 대상|분석 범위|관련 결정|문서 ID|버전|Date|Status|Version):\s+\S"
LINK_DEFINITION = r"^\s*\[[^\]]+\]:\s+\S"
TABLE_DELIMITER = r"^\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
SKIPPED = ("table", "blockquote", "comment", "metadata", "link-definition", "code", "blank", "fence", "front-matter", "heading-underline")
# Word bounds are those of ASCII words; the engine's own bounds depend on its version.
ACRONYM = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*(?![A-Za-z0-9_])"
# A name starts where its run of letters starts, so a line is read once however long it is.
DEFINITION = (r"(?:(?<![A-Za-z0-9\s-])[0-9\s-]*+[A-Za-z][A-Za-z0-9\s-]{2,}+\(([A-Z][A-Z0-9-]{1,9})\)"
              r"|\([^()]{2,}?,\s*([A-Z][A-Z0-9-]{1,9})\))")
IDENTIFIER = (r"^(?:(?:SRC|ADR|REQ|OPEN|C|T)-[A-Z0-9-]+|[PGL]\d+|H[1-6]|[A-Z]|I{1,3}|IV|V|VI{0,3}|IX|X|AGREED|VERIFIED|FINALIZED|ERROR|MUST"
              r"|GET|POST|PUT|PATCH|DELETE|AS-IS|TO-BE)$")
QUOTED_SECTION = r"(?:금지(?:할)?(?: 기술)? (?:설명|문장|주장|표현)|나쁜 예|교체 전|원문 인용)"
QUOTED_LINE = r"(?:대상 문장|금지 주장|원문 인용|나쁨|교체 전)\s*:"
SUPPRESSION = r"<!--\s*report-style-disable-next-line\s+([A-Z0-9,-]+)\s*:\s*(.+?)\s*-->"


def read_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, raw): numbered lines of whole texts, counted from 1."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    return docs.select(key, F.posexplode(F.split(clean, "\n", -1)).alias("_i", "raw")).select(key, (F.col("_i") + 1).alias("line_no"), "raw")


def mask_inline(col: Column) -> Column:
    """Text without comments, code, images, link targets, bare links and emphasis marks."""
    for pattern, to in ((r"<!--.*?-->", " "), (r"(`+).*?\1", " "), (r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[([^\]]+)\]\(([^\)]*)\)", "$1"), (r"https?://[^\s)>]+", " "), (r"[*_~]", "")):
        col = F.regexp_replace(col, pattern, to)
    return col


def _spans(lines: Column) -> Column:
    """Front matter, comment and fence spans of a document, found by folding over the few lines that
    can open or close one."""
    t = lambda x: F.trim(x)
    mark = lambda x, i: F.struct(
        i.alias("i"), (t(x) == "---").alias("rule"), F.contains(x, F.lit("-->")).alias("ends"),
        (t(x).startswith("<!--") & ~F.contains(t(x), F.lit("-->"))).alias("begins"), F.regexp_extract(x, FENCE, 1).alias("fence"),
        (F.trim(F.regexp_extract(x, FENCE, 2)) == "").alias("bare"))
    marks = F.filter(F.transform(lines, mark), lambda m: m["rule"] | m["ends"] | m["begins"] | (m["fence"] != ""))
    front = t(F.get(lines, F.lit(0))) == "---"
    none = F.array().cast("array<struct<a:int,b:int,kind:string>>")
    state = lambda mode, fence, at, spans: F.struct(mode.alias("mode"), fence.alias("fence"), at.alias("at"), spans.alias("spans"))
    start = state(F.when(front, "front-matter").otherwise("none"), F.lit(""), F.lit(0), none)

    def step(s, m):
        same = (F.substring(m["fence"], 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(m["fence"]) >= F.length(s["fence"])) & m["bare"]
        closes = (F.when(s["mode"] == "front-matter", m["rule"] & (m["i"] > 0)).when(s["mode"] == "comment", m["ends"])
                  .when(s["mode"] == "fence", (m["fence"] != "") & same).otherwise(False))
        opens = F.when(s["mode"] == "none", F.when(m["begins"], "comment").when(m["fence"] != "", "fence"))
        span = F.array(F.struct(s["at"].alias("a"), m["i"].alias("b"), s["mode"].alias("kind")))
        return (F.when(closes, state(F.lit("none"), F.lit(""), F.lit(0), F.concat(s["spans"], span)))
                .when(opens.isNotNull(), state(opens, m["fence"], m["i"], s["spans"])).otherwise(s))

    def finish(s):
        rest = F.array(F.struct(s["at"].alias("a"), F.lit(2147483647).alias("b"), s["mode"].alias("kind")))
        return F.when(s["mode"] == "none", s["spans"]).otherwise(F.concat(s["spans"], rest))

    return F.aggregate(marks, start, step, finish)


def line_types(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with type, heading level and text, list marker, indent and content, and skip flag.

    Spans that need state are folded once per document; everything else looks at a line and its
    neighbours. A heading that announces quoted text opens a section, in which only headings are not skipped, up
    to the next heading of its level or above; a later such heading takes its place. So a line is quoted if all
    headings since the last such heading lie deeper: two running values over the lines.
    """
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    whole = once(docs.select(key, F.split(clean, "\n", -1).alias("_lines")), {"_spans": _spans(F.col("_lines"))})
    rows = whole.select(key, "_spans", F.posexplode("_lines").alias("_i", "raw"))
    inside = F.get(F.filter("_spans", lambda s: F.col("_i").between(s["a"], s["b"])), F.lit(0))
    rows = once(rows, {"_span": inside}).drop("_spans")
    raw, trimmed = F.col("raw"), F.trim("raw")
    span_type = (F.when(F.col("_span.kind") == "fence", F.when((F.col("_i") == F.col("_span.a")) | (F.col("_i") == F.col("_span.b")), "fence").otherwise("code"))
                 .otherwise(F.col("_span.kind")))
    is_list = raw.rlike(LIST)
    atx = raw.rlike(HEADING)
    indented = ~is_list & raw.rlike(r"^(?: {4}|\t)")
    meta = (F.col("_i") < 15) & trimmed.rlike(METADATA)
    own = (F.when(indented, "code").when(raw.rlike(r"^\s*\|.*\|\s*$"), "table").when(raw.rlike(r"^\s*>"), "blockquote").when(trimmed.rlike(r"^<!--[\s\S]*-->$"), "comment")
           .when(raw.rlike(LINK_DEFINITION), "link-definition").when(meta, "metadata").when(is_list | raw.rlike(REPORT_MARKER), "list").otherwise("prose"))
    rows = once(rows.select(key, (F.col("_i") + 1).alias("line_no"), "_i", "raw", "_span"), {
        "_st": span_type, "_own": own, "_atx": atx & F.col("_span").isNull(), "_delimits": raw.rlike(TABLE_DELIMITER), "_piped": F.contains(raw, F.lit("|")), "_blank": trimmed == "",
        "_rule": F.substring(F.regexp_extract("raw", r"^ {0,3}(=+|-+)\s*$", 1), 1, 1),
        "_may": ~atx & F.col("_span").isNull() & raw.rlike(r"^ {0,3}\S")}).drop("_i", "_span")
    # All windows below have one order, and nothing between them disturbs it: the lines are sorted once, and with them only the text itself.
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda value: F.last(value, ignorenulls=True).over(upto)
    rows = rows.withColumns({"_below": F.coalesce(F.lead("_rule").over(w), F.lit("")), "_heads": F.coalesce(F.lead("_delimits").over(w), F.lit(False)), "_after": F.coalesce(F.lag("_piped").over(w), F.lit(False))})
    # A table body runs from its delimiter over the following lines that hold a pipe.
    starts = (F.col("_delimits") & F.col("_after")) | (F.col("_heads") & F.col("_piped"))
    rows = rows.withColumn("_tabled", F.coalesce(last(F.when(starts, True).when(~F.col("_piped") | F.col("_blank"), False)), F.lit(False)))
    rows = rows.withColumn("_setext", F.col("_may") & (F.col("_own") == "prose") & ~F.col("_tabled") & (F.col("_below") != ""))
    rows = rows.withColumn("_under", F.coalesce(F.lag("_setext").over(w), F.lit(False)))
    kind = (F.when(F.col("_st").isNotNull(), F.col("_st")).when(F.col("_under"), "heading-underline").when(F.col("_blank"), "blank")
            .when(F.col("_atx") | F.col("_setext"), "heading").when(F.col("_tabled") & (F.col("_own") != "code"), "table").otherwise(F.col("_own")))
    level = F.when(F.col("_atx"), F.length(F.regexp_extract("raw", HEADING, 1))).otherwise(F.when(F.col("_below") == "=", 1).otherwise(2))
    heading = F.trim(mask_inline(F.when(F.col("_atx"), F.regexp_replace(F.regexp_extract("raw", HEADING, 2), r"[ \t]+#+[ \t]*$", "")).otherwise(trimmed)))
    out = rows.withColumn("type", kind)
    is_head, listed = F.col("type") == "heading", F.col("type") == "list"
    out = out.withColumn("_level", F.when(is_head, level)).withColumn("_quotes", F.coalesce(F.when(is_head, heading.rlike(QUOTED_SECTION)), F.lit(False)))
    out = out.withColumn("_top", last(F.when(F.col("_quotes"), F.col("_level"))))
    quoted = F.coalesce(last(F.when(F.col("_quotes"), True).when(F.col("_level") <= F.col("_top"), False)), F.lit(False))
    out = out.withColumn("_quoted", quoted & ~is_head).withColumn("masked", F.trim(mask_inline(raw)))
    return out.select(
        key, "line_no", "raw", "type", F.col("_level").alias("heading_level"), F.when(is_head, heading).alias("heading_text"),
        F.when(listed, F.when(is_list, F.regexp_extract("raw", LIST, 2)).otherwise(F.regexp_extract("raw", REPORT_MARKER, 1))).alias("list_marker"),
        F.when(listed, F.when(is_list, F.length(F.regexp_extract("raw", LIST, 1))).otherwise(0)).alias("list_indent"),
        F.when(listed, F.trim(mask_inline(F.when(is_list, F.regexp_extract("raw", LIST, 3)).otherwise(F.regexp_extract("raw", REPORT_MARKER, 2))))).alias("list_content"),
        "masked", (F.col("type").isin(*SKIPPED) | F.col("_quoted") | F.col("masked").rlike(QUOTED_LINE)).alias("skip"))


def visible_text(lines: DataFrame) -> Column:
    return F.coalesce(F.col("heading_text"), F.col("list_content"), F.col("masked"))


def outline(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, first_line, headings): per document its first line that is not blank and its headings in order, as
    (line_no, level, text). What rules on structure need, from one pass over the lines."""
    head = F.when(F.col("type") == "heading", F.struct("line_no", F.col("heading_level").alias("level"), F.col("heading_text").alias("text")))
    return lines.groupBy(key).agg(F.min(F.when(F.col("type") != "blank", F.col("line_no"))).alias("first_line"), F.sort_array(F.collect_list(head)).alias("headings"))


def heading_findings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, rule, detail): one H1 and first, no skipped level, H2 numbers in sequence. ``lines`` may be an ``outline``."""
    docs = lines if "headings" in lines.columns else outline(lines, key)
    number = lambda h: F.regexp_extract(h["text"], r"^(\d+)\.\s", 1).try_cast("bigint")
    second = F.transform(F.filter("headings", lambda h: h["level"] == 2), lambda h: F.struct(h["line_no"].alias("line_no"), number(h).alias("no")))
    docs = once(docs, {"_ones": F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["line_no"]), "_second": second})
    docs = once(docs, {"_numbered": F.filter("_second", lambda h: h["no"].isNotNull())})
    cell = lambda line, rule, detail: F.struct(line.cast("int").alias("line_no"), F.lit(rule).alias("rule"), F.lit(detail).alias("detail"))
    at = lambda i: F.get("_ones", F.lit(i))
    count = F.when(F.size("_ones") != 1, cell(F.coalesce(at(1), at(0), F.col("first_line"), F.lit(1)), "STR001", "H1_COUNT"))
    top = F.get("headings", F.lit(0))
    first = F.when((F.size("_ones") == 1) & (top["level"] != 1), cell(top["line_no"], "STR001", "H1_NOT_FIRST"))
    skip = F.transform("headings", lambda h, i: F.when((i > 0) & (h["level"] > F.get("headings", i - 1)["level"] + 1), cell(h["line_no"], "STR001", "LEVEL_SKIPPED")))
    bare = F.transform(F.filter("_second", lambda h: h["no"].isNull()), lambda h: cell(h["line_no"], "STR002", "H2_UNNUMBERED"))
    wrong = F.transform("_numbered", lambda h, i: F.when(h["no"] != F.coalesce(F.get("_numbered", i - 1)["no"] + 1, F.lit(1)), cell(h["line_no"], "STR002", "H2_SEQUENCE")))
    found = F.array_compact(F.concat(F.array(count, first), skip, bare, wrong))
    return docs.select(key, F.inline(found))


def near_marker(lines: DataFrame, claim: str, marker: str, label: str, n: int = 3, key: str = "doc_id") -> DataFrame:
    """Claim lines with ``supported``: is a marker within n lines, with no blank or heading between?

    A list claim is served by a deeper list line or by a labelled one of its own depth; other claims
    by prose or any labelled line. The window holds 2n+1 lines.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    text = visible_text(lines)
    breaks = F.col("type").isin("blank", "heading")
    rows = lines.withColumns({"_text": text, "_break": F.when(breaks, 1).otherwise(0)})
    rows = rows.withColumn("_b", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    info = F.struct("line_no", "_b", "_break", "type", "list_indent", F.col("_text").rlike(label).alias("labelled"), (~F.col("skip") & F.col("raw").rlike(marker)).alias("marked"))
    rows = rows.withColumn("_near", F.collect_list(info).over(w.rowsBetween(-n, n)))
    between = lambda c: F.when(c["line_no"] > F.col("line_no"), c["_b"] - c["_break"] - F.col("_b")).otherwise(F.col("_b") - F.col("_break") - c["_b"])
    as_list = lambda c: (c["type"] == "list") & ((c["list_indent"] > F.col("list_indent")) | ((c["list_indent"] == F.col("list_indent")) & c["labelled"]))
    serves = lambda c: F.when(c["line_no"] == F.col("line_no"), F.lit(True)).otherwise((between(c) == 0) & F.when(F.col("type") == "list", as_list(c)).otherwise((c["type"] == "prose") | c["labelled"]))
    supported = F.exists("_near", lambda c: c["marked"] & serves(c))
    claims = rows.where(~F.col("skip") & (F.col("type") != "heading") & F.col("_text").rlike(claim))
    return claims.select(key, "line_no", supported.alias("supported"))


def acronym_findings(lines: DataFrame, known: list[str], key: str = "doc_id") -> DataFrame:
    """(key, acronym, line_no): first uses that come before any definition; one per acronym."""
    text = visible_text(lines)
    shown = lines.where(~F.col("skip")).select(key, "line_no", text.alias("t"))
    uses = shown.select(key, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(ACRONYM), F.lit(0)))).alias("acronym"))
    defined = shown.where(F.contains("t", F.lit("("))).select(key, "line_no", F.explode(F.concat(*[F.regexp_extract_all("t", F.lit(DEFINITION), F.lit(i)) for i in (1, 2)])).alias("acronym")).where(F.col("acronym") != "")
    first = uses.where(~F.col("acronym").rlike(IDENTIFIER) & ~F.col("acronym").isin(known)).groupBy(key, "acronym").agg(F.min("line_no").alias("line_no"))
    meant = defined.groupBy(key, "acronym").agg(F.min("line_no").alias("_defined"))
    return first.join(meant, [key, "acronym"], "left").where(F.col("_defined").isNull() | (F.col("line_no") < F.col("_defined"))).select(key, "acronym", "line_no")


def normalize_sentence(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(col), r"https?://\S+", ""), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))


def duplicate_sentences(lines: DataFrame, min_length: int = 40, key: str = "doc_id") -> DataFrame:
    """(key, line_no, first_line): lines that repeat an earlier line of the same document.

    First lines come from a combinable minimum over digests, so a line repeated without end is cheap.
    """
    text = visible_text(lines)
    rows = lines.where(~F.col("skip") & F.col("type").isin("prose", "list") & (F.length(text) >= min_length) & ~text.rlike(r"^근거\s*:")).select(
        key, "line_no", F.sha2(normalize_sentence(text), 256).alias("_d"))
    first = rows.groupBy(key, "_d").agg(F.min("line_no").alias("first_line"))
    return rows.join(first, [key, "_d"]).where(F.col("line_no") > F.col("first_line")).select(key, "line_no", "first_line")


@dataclass(frozen=True)
class LineRule:
    """A rule on the visible text of a line: a pattern that must not (or, inverted, must) match."""
    rule_id: str
    pattern: str
    only_lists: bool = False
    unless: str | None = None


def line_findings(lines: DataFrame, rules: list[LineRule], max_chars: int = 180, terms: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, line_no, col_no, rule): pattern rules, over-long lines, long enumerations, preferred terms.

    A suppression comment on the line before switches its rules off for the line.
    """
    text = visible_text(lines)
    shown = once(lines.where(~F.col("skip")), {"_t": text}).where(F.col("_t") != "")
    count = lambda p: F.regexp_count("_t", F.lit(p))
    checks = [(r.rule_id, F.col("_t").rlike(r.pattern) & ((F.col("type") == "list") if r.only_lists else F.lit(True)) & (~F.col("_t").rlike(r.unless) if r.unless else F.lit(True)), r.pattern) for r in rules]
    checks += [("REG107", F.length("_t") > max_chars, None), ("REG108", (count("및") >= 3) | (count(",") >= 5) | (count(r"\(") >= 3), None)]
    checks += [("TRM103", F.contains("_t", F.lit(v)), None) for v, canonical in (terms or {}).items() if v != canonical]
    place = lambda p: F.lit(1) if p is None else F.greatest(F.lit(1), F.regexp_instr("raw", F.lit(p)))
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), place(p).alias("col_no"))) for n, c, p in checks]))
    found = shown.select(key, "line_no", F.explode(hits).alias("x")).select(key, "line_no", "x.col_no", "x.rule")
    off = lines.where(F.col("raw").rlike(SUPPRESSION)).select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(F.split(F.regexp_extract("raw", SUPPRESSION, 1), ",")).alias("rule"))
    everything = off.where(F.col("rule") == "ALL").select(key, "line_no").distinct()
    return found.join(off.select(key, "line_no", F.trim("rule").alias("rule")).distinct(), [key, "line_no", "rule"], "left_anti").join(everything, [key, "line_no"], "left_anti")


def ordered_diagnostics(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.orderBy(key, "line_no", "col_no", "rule")


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob: ``**`` crosses folders, ``*`` and ``?`` stay inside one."""
    import re
    parts = re.split(r"(/\*\*$|\*\*/|\*\*|\*|\?)", glob.replace("\\", "/"))
    known = {"/**": "(?:/.*)?", "**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(p, re.escape(p)) for p in parts) + "$"


def rule_config(docs: DataFrame, rule_ids: list[str], defaults: dict[str, str], overrides: list[dict], path_col: str = "path") -> DataFrame:
    """(path, rule, severity): configured severity per document; the last matching override wins.

    ``overrides``: [{"files": [globs], "rules": {rule: severity}}]. They are configuration and become
    one expression per rule, so no join is needed.
    """
    def severity(rule: str) -> Column:
        out = F.lit(defaults.get(rule, "off"))
        for o in overrides:
            if rule in o["rules"]:
                hit = F.lit(False)
                for g in o["files"]:
                    hit = hit | F.col(path_col).rlike(glob_regex(g))
                out = F.when(hit, o["rules"][rule]).otherwise(out)
        return out
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), severity(r).alias("severity")) for r in rule_ids])
    return docs.select(path_col, F.explode(pairs).alias("x")).select(path_col, "x.rule", "x.severity")


def lint_gate(findings: DataFrame, fail_on: str, max_warnings: int | None = None) -> DataFrame:
    """One row: counts per severity and whether the run passes. ``fail_on``: none, error, warning, info."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("error", "warning", "info")}
    counts = findings.agg(*[c.alias(f"{s}s") for s, c in n.items()])
    reached = {"none": [], "error": ["errors"], "warning": ["errors", "warnings"], "info": ["errors", "warnings", "infos"]}[fail_on]
    failed = F.lit(False)
    for c in reached:
        failed = failed | (F.col(c) > 0)
    if max_warnings is not None:
        failed = failed | (F.col("warnings") > max_warnings)
    return counts.withColumn("passed", ~failed)


def text_profile(lines: DataFrame, terms: list[str], endings: dict[str, str]) -> DataFrame:
    """(measure, item, value): line, heading, list, ending and term counts, list lengths by nearest rank.

    All measures come from combinable counts over the lines; ``endings`` are tried in order.
    """
    text = visible_text(lines)
    shown = once(lines, {"_t": text})
    live = ~F.col("skip")
    content = live & (F.col("_t") != "")
    ending = F.lit("other")
    for name, p in reversed(list(endings.items())):
        ending = F.when(F.col("_t").rlike(p), name).otherwise(ending)
    marker = F.when(F.col("list_marker").rlike(r"^\d+\.$"), "n.").otherwise(F.col("list_marker"))
    occurs = [F.struct(F.lit("term").alias("measure"), F.lit(x).alias("item"), (F.size(F.split("_t", F.lit("\\Q" + x + "\\E"), -1)) - 1).cast("bigint").alias("value")) for x in terms]
    one = lambda m, item, cond: F.when(cond, F.struct(F.lit(m).alias("measure"), item.cast("string").alias("item"), F.lit(1).cast("bigint").alias("value")))
    cells = F.array_compact(F.array(
        one("lines", F.lit("all"), F.lit(True)), one("lines", F.lit("content"), content), one("heading", F.col("heading_level"), live & F.col("heading_level").isNotNull()),
        one("list", marker, live & F.col("list_marker").isNotNull()), one("ending", ending, content), *[F.when(content, o) for o in occurs]))
    counts = shown.select(F.explode(cells).alias("x")).groupBy("x.measure", "x.item").agg(F.sum("x.value").alias("value")).where(F.col("value") > 0)
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by n)")
    lengths = shown.where(live & F.col("list_marker").isNotNull()).select(F.length("list_content").alias("n")).agg(rank(0.5).alias("median"), rank(0.9).alias("p90"), F.max("n").alias("max"))
    long = lengths.select(F.explode(F.array(*[F.struct(F.lit("list_length").alias("measure"), F.lit(i).alias("item"), F.coalesce(F.col(i).cast("bigint"), F.lit(0)).alias("value")) for i in ("median", "p90", "max")])).alias("x")).select("x.measure", "x.item", "x.value")
    return counts.unionByName(long)


# Particles that may stand between a name and a conformance word.
PARTICLES = ("이라", "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "로", "도", "만")
CONFORMANCE = ("적합", "준수", "부합", "호환")


def normalize_claim_text(col: Column) -> Column:
    """Text for phrase search: tags, marks, punctuation, particles and blanks removed, lower case."""
    rendered = mask_inline(F.regexp_replace(col, r"<[^>]*>", " "))
    bare = nfkc(F.regexp_replace(nfkd(rendered), r"[\p{M}\p{C}]", ""))
    plain = F.regexp_replace(bare, r"[\p{P}\p{S}]", "")
    joined = F.regexp_replace(plain, rf"(?i)([A-Za-z0-9])\s*(?:{'|'.join(PARTICLES)})\s*(?={'|'.join(CONFORMANCE)})", "$1")
    return F.lower(F.regexp_replace(joined, r"\s+", ""))


def _plain(phrase: str) -> str:
    """A configured phrase in the form ``normalize_claim_text`` gives."""
    import unicodedata
    kept = "".join(c for c in unicodedata.normalize("NFKD", phrase) if unicodedata.category(c)[0] not in "MC" or c.isspace())
    folded = unicodedata.normalize("NFKC", kept)
    return "".join(c for c in folded if unicodedata.category(c)[0] not in "PS" and not c.isspace()).lower()


def blocked_claims(docs: DataFrame, phrases: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase): whole texts that contain a blocked phrase. Phrases are a configured short list."""
    if len(phrases) > 2000:
        raise ValueError("blocked phrases are configuration; at most 2000")
    folded = once(docs, {"_t": normalize_claim_text(F.col(text))})
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(_plain(p)).alias("form")) for p in phrases])
    hits = F.filter(pairs, lambda p: F.contains("_t", p["form"]))
    return folded.select(key, F.explode(hits).alias("x")).select(key, "x.phrase")
