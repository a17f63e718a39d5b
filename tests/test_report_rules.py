"""Report rules on a small document whose findings are known line by line."""

from dataward.operators import report_rules as R
from dataward.operators import text as T

DOC = """# 검토 범위
## 1. 개요
오늘은 구조를 확인했습니다.
제가 확인한 결과
## 2. 금지할 표현
혁신적 환경
### 2.1 예
강력한 환경
## 3. 계획
- 메타데이터 연계 고도화
- 메타데이터 연계 고도화, 담당 기관
- 확인.
- 확인함.
<!-- report-style-disable-next-line REG106: 인용 -->
강력한 환경
<!-- report-style-disable-next-line ALL: 인용 -->
- Connector는 반드시 안전해야 함
```
강력한 환경
```

Connector는 반드시 안전해야 함
검증: HTTP 403

Connector는 반드시 안전해야 함

- 반드시 수행
검증: HTTP 403
나쁨: 강력한 환경
매출 30 % 성장
É MUST 수행
ÉMUST 수행"""


def found(spark, text, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sorted((r["line_no"], r["col_no"], r["rule"]) for r in R.report_findings(T.line_types(docs), **options).collect())


def test_findings_line_by_line(spark):
    assert found(spark, DOC) == [
        (3, 1, "REG101"), (3, 9, "REG102"), (4, 1, "REG104"), (10, 12, "PRE101"), (12, 1, "REG103"),
        (25, 12, "PRE103"), (27, 3, "PRE103"), (30, 4, "PRE104"), (32, 2, "PRE103")]


def test_quoted_section_ends_at_its_level(spark):
    text = "# a\n## 원문 인용\nx\n### deeper\nx\n## next\nx\n### 나쁜 예\nx\n# 교체 전\nx\n## in\nx\n# out\nx"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = T.line_types(docs).where("type = 'prose'").collect()
    assert sorted((r["line_no"], r["skip"]) for r in rows) == [(3, True), (5, True), (7, False), (9, True), (11, True), (13, True), (15, False)]


def test_repeats_terms_and_lengths(spark):
    long = "a" * 181
    line = "Die Lage der Daten ist in allen Teilen gleich gut"
    text = "\n".join([line, "- " + line.upper() + "!", long, "b, c, d, e, f, g", "Gaia x"])
    assert found(spark, text, terms={"Gaia": "GAIA", "x": "x"}) == [(2, 1, "REG103"), (2, 1, "REG109"), (3, 1, "REG107"), (4, 1, "REG108"), (5, 1, "TRM103")]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "# a\n## 1. b\n### 1.1 c\n### A-1. d\n### e\n### 가. f"), (2, "\ntext"), (3, "# 목적")], "doc_id long, text string")
    got = sorted(tuple(r) for r in R.section_findings(T.line_types(docs)).select("doc_id", "line_no", "rule").collect())
    assert got == [(1, 2, "STR004"), (1, 5, "STR003"), (2, 2, "STR004")]


def test_polite_endings(spark):
    from pyspark.sql import functions as F
    words = [("합니다.", True), ("합니까?", True), ("아니다", False), ("해요", True), ("니다", False), ("", False), ("하십시오!", True), ("A니다", False)]
    docs = spark.createDataFrame(words, "t string, want boolean")
    assert all(r["got"] == r["want"] for r in docs.select("want", R.polite_ending(F.col("t")).alias("got")).collect())
