"""Rules of report language over typed lines (``text.line_types``), all judged in one pass per document.

Every rule that looks at a line, at lines nearby, at repeats or at the suppression comment above is a column over
windows with the same partitioning, so a document's lines are shuffled once whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.operators.text import SUPPRESSION, normalize_sentence, outline, visible_text

# Words and forms that the rules look for.
CONVERSATIONAL = ("오늘은", "이번 글에서는", "살펴보자", "알아보자", "해보겠습니다", "여정을 시작")
POLITE = "(?:해요|나요|하죠|까요|세요|십시오)$"
POLITE_PLACE = "(?:[가-힣]+(?:니다|니까)|해요|나요|하죠|까요|세요|십시오)[.!?]?$"
LIST_STOP = "[.!]$"
LIST_STOP_FINE = r"(?:(?:다|함|임|음|됨)\.$|(?:근거|출처)\s*:)"
ADDRESS = r"(?:^|\s)(?:저|제가|저희|여러분|당신|독자 여러분)(?:은|는|이|가|의|에게|께서|\s)"
CLICHES = ("핵심은", "궁극적으로", "단순히.{0,50}(?:아니라|넘어)", "를 넘어", "새로운 패러다임", "선순환(?:적)? (?:구조|생태계)",
           "새로운 가치를 창출", "이를 통해.{0,30}활성화")
PROMOTION = ("혁신적", "강력한", "원활한", "효율적인", "최적의", "미래지향적", "획기적", "폭발적", "비약적", "막대한", "매끄러운", "핵심 연료", "혁신.*토양")
ABSOLUTE = ("완벽한", "세계 최초", "국내 최초", r"(?<!\d)100%(?:[가-힣]+)?[^.!?\n]{0,25}(?:보장|달성|통과|정확|준수|성공|완료)",
            "즉시 (?:운영|연동|적용|활용)", "글로벌 호환(?:성)?(?:을)? 보장", "원본(?: 데이터)? 비유출", "모든.{0,30}보장")
MISUSE = (r"(?i)IDSA\s+Dataspace Protocol",
          r"(?i)TCK(?:가|는)?\s*인증(?:을)?\s*(?:발급|제공|보장|한다)",
          r"(?i)DSP(?:가|는)?\s*.{0,12}(?:실제|물리적).{0,10}(?:데이터|payload)(?:를|을)?\s*(?:직접\s*)?전송(?:한다|함|하는 역할|을 담당)",
          r"(?i)DCP(?:가|는)?\s*.{0,20}DSP.{0,10}(?:필수|반드시).{0,10}(?:구성|요소|포함|따름)",
          r"(?i)ODRL(?:이|은|로)?\s*.{0,30}(?:완벽하게|사후에도|지속적으로).{0,15}(?:보장|통제)(?:한다|함|됨)",
          r"(?i)JSON-LD(?:가|는|로)?\s*.{0,30}자동.{0,20}(?:매핑|mapping)(?:한다|함|됨|보장)",
          r"(?i)DCAT-AP(?:가|는|로)?\s*.{0,30}(?:연합 카탈로그|분산 크롤링).{0,15}(?:규정한다|제공한다|수행한다)",
          r"(?i)C2D(?:가|는|로)?\s*.{0,40}(?:개인정보|민감정보).{0,25}(?:교환 가능을 보장|교환을 보장|처리를 보장)")
ACTION_ONLY = "(?:지원|연계|관리|고도화|활성화|추진|구축|기반 마련)$"
ACTION_EVIDENCE = "(?i)(?:담당|운영기관|입력|출력|산출물|기한|까지|검증|시험|기준|증거|상태|실패|오류|삭제|차단|저장|반환|측정|분모|SLO|RTO|RPO)"
OBLIGATION = r"(?:(?<![A-Za-z0-9_])MUST(?![A-Za-z0-9_])|반드시|하여야 함|해야 함|필수(?:로|임|이다| 요구| 적용| 검토| 준수| 포함| 구현| 제공))"
QUANTIFIED = (r"(?i)(?:\d{4}년|\d+(?:\.\d+)?\s*%|(?:연평균|시장\s*규모|기술\s*격차)[^.!?\n]{0,20}\d|세계\s*최초|국내\s*최초"
              r"|최신(?:판|\s+(?:버전|release|표준|현황|자료|API|schema|명세))|표준화\s*완료)")
EVIDENCE = (r"(?i)(?:https?://|SRC-[A-Z0-9-]+|C-\d{3}|(?:근거|출처|evidence|검증 결과|시험 결과|산식|분모|기준일)\s*:\s*\S|(?:PDF\s*)?p\.\s*\d+)",
            r"(?i)^(?:근거|출처|evidence|검증 결과|시험 결과|산식|분모|기준일)\s*:")
ACCEPTANCE = (r"(?i)(?:(?:검증|시험|통과 기준|완료조건|acceptance criterion|예상 결과)\s*:\s*\S|(?:오류|누락|유출|실패|위반|leakage)\s*0건|HTTP\s*[45]\d\d)",
              r"(?i)^(?:검증|시험|통과 기준|완료조건|acceptance criterion|예상 결과)\s*:")
SCHEMES = {"decimal": r"^\d+(?:\.\d+)+\.?\s", "finding": r"^[A-Z]{1,8}-\d+[A-Z]?(?:-\d+)?\.\s", "korean-alpha": r"^[가-힣]\.\s", "parenthesized": r"^\(\d+\)\s"}
PURPOSE = "(?:목적|범위|질문|판정|개요|기준)"


@dataclass(frozen=True)
class ReportRule:
    """Patterns of which the first that matches gives the place.

    ``unless``: a pattern that excuses the line. ``near``: (marker, label) that must not be found close by.
    ``placed`` false reports column 1.
    """
    rule_id: str
    patterns: tuple[str, ...]
    only_lists: bool = False
    not_headings: bool = False
    unless: str | None = None
    near: tuple[str, str] | None = None
    placed: bool = True


REPORT_RULES = (
    ReportRule("REG101", CONVERSATIONAL),
    ReportRule("REG103", (LIST_STOP,), only_lists=True, unless=LIST_STOP_FINE, placed=False),
    ReportRule("REG104", (ADDRESS,)),
    ReportRule("REG105", CLICHES),
    ReportRule("REG106", PROMOTION),
    ReportRule("PRE101", (ACTION_ONLY,), only_lists=True, unless=ACTION_EVIDENCE),
    ReportRule("PRE102", ABSOLUTE, not_headings=True, near=EVIDENCE),
    ReportRule("PRE103", (OBLIGATION,), not_headings=True, near=ACCEPTANCE),
    ReportRule("PRE104", (QUANTIFIED,), not_headings=True, near=EVIDENCE),
    ReportRule("TRM101", MISUSE, not_headings=True),
)


def polite_ending(text: Column) -> Column:
    """Does the text end in a polite form? Forms in -nida and -nikka count after a syllable closed by bieup."""
    bare = F.regexp_replace(text, "[.!?]+$", "")
    code = F.ascii(F.substring(bare, -3, 1))
    closed = code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 == 17)
    return bare.rlike(POLITE) | (bare.rlike("(?:니다|니까)$") & closed)


def _served(near: Column, k: int) -> Column:
    """Is the line's claim served by a marked line of its window, with no blank or heading in between?"""
    between = lambda c: F.when(c["line_no"] > F.col("line_no"), c["before"] - F.col("_before") - F.col("_break")).otherwise(F.col("_before") - c["before"] - c["break"])
    as_list = lambda c: (c["type"] == "list") & ((c["indent"] > F.col("list_indent")) | ((c["indent"] == F.col("list_indent")) & c[f"label{k}"]))
    fits = lambda c: (between(c) == 0) & F.when(F.col("type") == "list", as_list(c)).otherwise((c["type"] == "prose") | c[f"label{k}"])
    return F.exists(near, lambda c: c[f"mark{k}"] & ((c["line_no"] == F.col("line_no")) | fits(c)))


def report_findings(lines: DataFrame, rules: tuple[ReportRule, ...] = REPORT_RULES, max_chars: int = 180, min_repeat: int = 40, n: int = 3,
                    terms: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, line_no, col_no, rule): one row per rule that a line breaks; of preferred terms one per variant.

    ``lines``: as ``line_types`` gives them. Skipped lines break nothing; empty and null texts have no findings. A
    suppression comment on the line above switches off the rules it names, or ALL.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    kinds = list(dict.fromkeys(r.near for r in rules if r.near))
    # No generator here: it would lose the order of the lines, and they would be sorted again.
    rows = lines.withColumn("_text", visible_text(lines)).withColumns({
        "_shown": ~F.col("skip") & (F.col("_text") != ""), "_break": F.col("type").isin("blank", "heading").cast("int"),
        "_off_below": F.transform(F.split(F.regexp_extract("raw", SUPPRESSION, 1), ","), F.trim)})
    marks = [c for k, (marker, label) in enumerate(kinds) for c in (
        (~F.col("skip") & F.col("raw").rlike(marker)).alias(f"mark{k}"), F.col("_text").rlike(label).alias(f"label{k}"))]
    counted = F.col("_shown") & F.col("type").isin("prose", "list") & (F.length("_text") >= min_repeat) & ~F.col("_text").rlike(r"^근거\s*:")
    rows = rows.withColumns({
        "_before": F.coalesce(F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_off": F.coalesce(F.lag("_off_below").over(order), F.array().cast("array<string>")),
        "_same": F.when(counted, F.sha2(normalize_sentence(F.col("_text")), 256))})
    if kinds:
        info = F.struct("line_no", F.col("_before").alias("before"), F.col("_break").alias("break"), "type", F.col("list_indent").alias("indent"), *marks)
        rows = rows.withColumn("_near", F.collect_list(info).over(order.rowsBetween(-n, n)))
    # Windows of lines end here; what is sorted once more for repeats are shown lines with their verdicts.
    rows = rows.where("_shown").select(key, "line_no", "raw", "type", "_text", "_off", "_same", *[_served(F.col("_near"), k).alias(f"_served{k}") for k in range(len(kinds))])
    rows = rows.withColumn("_first", F.when(F.col("_same").isNotNull(), F.min("line_no").over(Window.partitionBy(key, "_same"))))

    found = lambda p: F.col("_text").rlike(p)
    place = lambda p: F.greatest(F.lit(1), F.regexp_instr("raw", F.lit(p)))
    count = lambda p: F.regexp_count("_text", F.lit(p))

    def hit(rule: str, cond: Column, col: Column = F.lit(1)) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), col.cast("int").alias("col_no")))

    hits = []
    for r in rules:
        holds = F.lit(True)
        if r.only_lists:
            holds = holds & (F.col("type") == "list")
        if r.not_headings:
            holds = holds & (F.col("type") != "heading")
        if r.unless:
            holds = holds & ~found(r.unless)
        at = F.coalesce(*[F.when(found(p), place(p) if r.placed else F.lit(1)) for p in r.patterns])
        missing = ~F.col(f"_served{kinds.index(r.near)}") if r.near else F.lit(True)
        hits.append(F.when(holds & at.isNotNull() & missing, F.struct(F.lit(r.rule_id).alias("rule"), at.cast("int").alias("col_no"))))
    hits += [hit("REG102", polite_ending(F.col("_text")), place(POLITE_PLACE)), hit("REG107", F.length("_text") > max_chars),
             hit("REG108", (count("및") >= 3) | (count(",") >= 5) | (count(r"\(") >= 3)), hit("REG109", F.col("line_no") > F.col("_first"))]
    hits += [hit("TRM103", F.contains("_text", F.lit(v)), F.greatest(F.lit(1), F.instr("raw", v))) for v, canonical in (terms or {}).items() if v != canonical]
    kept = F.filter(F.array_compact(F.array(*hits)), lambda h: ~F.array_contains(F.col("_off"), "ALL") & ~F.array_contains(F.col("_off"), h["rule"]))
    return rows.select(key, "line_no", F.explode(kept).alias("_hit")).select(key, "line_no", "_hit.col_no", "_hit.rule")


def section_findings(lines: DataFrame, schemes: tuple[str, ...] = tuple(SCHEMES), first_lines: int = 30, key: str = "doc_id") -> DataFrame:
    """(key, line_no, rule): lower headings outside the allowed numbering (STR003); documents whose headings in the first
    lines name no purpose or scope (STR004, at the first heading of level 2 or else the first line that is not blank).
    """
    docs = lines if "headings" in lines.columns else outline(lines, key)
    odd = F.transform(F.filter("headings", lambda h: reduce(lambda x, y: x & y, [(h["level"] >= 3), *[~h["text"].rlike(SCHEMES[s]) for s in schemes]])), lambda h: F.struct(
        h["line_no"].alias("line_no"), F.lit("STR003").alias("rule")))
    named = F.exists("headings", lambda h: (h["line_no"] <= first_lines) & h["text"].rlike(PURPOSE))
    second = F.get(F.filter("headings", lambda h: h["level"] == 2), F.lit(0))["line_no"]
    vague = F.when(~named, F.struct(F.coalesce(second, F.col("first_line"), F.lit(1)).alias("line_no"), F.lit("STR004").alias("rule")))
    return docs.select(key, F.inline(F.array_compact(F.concat(odd, F.array(vague)))))
