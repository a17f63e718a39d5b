"""Fill-in-middle against a direct form of the same cuts, and the boundary set against plain lists."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dataward.llm.fill_in_middle import (ArrayContainer, BitmapContainer, BoundarySet, FillInMiddle, RunContainer,
                                         fill_in_middle, restored)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, n string, form string, output int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "n", "f", 0) for i, t in rows], SCHEMA)


def direct(doc_id, text, unit="word"):
    text = text or ""
    units = list(text) if unit == "char" else re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, rows, spec=FillInMiddle()):
    got = fill_in_middle(df, spec).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    key = lambda x: repr(x)
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got], key=key) == sorted(
        [(i, *direct(i, t, spec.unit), t or "") for i, t in rows], key=key)
    return {r["form"] for r in got}


def test_documents_equal_the_direct_form(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert check(df, [(r["doc_id"], r["text"]) for r in df.collect()]) == {"plain", "spm", "psm"}


def test_characters_as_units(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()], FillInMiddle(unit="char"))


def test_odd_rows(spark):
    """Nulls, blanks, markers, half markers at cuts, wide letters, repeated rows and a text of many containers."""
    texts = [None, "", " ", "\n\t \r", "one", "  lead and trail  ", "a <P> b", "x <S", "P> y < <M >", "<<<P S> <M", "日本 語 🙂🙂 é", "z" * 70_000, "\x85\xa0 odd\x1c blank",
             " ".join(["a"] * 150_000) + "\n"]
    rows = [(i, t) for i in range(30) for t in texts] + [(None, "null id here"), (None, "null id here"), (3, "one"), (3, "one")]
    assert check(frame(spark, rows), rows) == {"plain", "spm", "psm"}
    assert fill_in_middle(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_containers_take_the_smallest_kind():
    assert isinstance(BoundarySet([1, 5, 70]).containers[0], ArrayContainer)
    assert isinstance(BoundarySet(np.arange(0, 20_000, 3)).containers[0], BitmapContainer)
    assert isinstance(BoundarySet(np.arange(100, 60_000)).containers[0], RunContainer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 9_000), st.sampled_from([1, 2, 3, 17])), min_size=1, max_size=6))
def test_select_equals_the_sorted_list(parts):
    values = np.unique(np.concatenate([np.arange(a, a + n * step, step) for a, n, step in parts]))
    ends = BoundarySet(values)
    assert ends.cardinality == len(values) and ends.cut(0) == 0
    for k in {0, len(values) - 1, len(values) // 2, *range(0, len(values), max(1, len(values) // 50))}:
        assert ends.select(k) == values[k] and ends.cut(k + 1) == values[k]
