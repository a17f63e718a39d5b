"""How many near copies of lines are found just above the threshold, and that inner tables go."""

import os
import random

from dataward.llm.paragraph_dedup import repeated_paragraphs
from dataward.llm.shared import settled, shared_folder, written


def _line(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def test_recall_of_lines_between_080_and_085(spark):
    """300 pairs of lines of 54 words (50 shingles), one word changed: 45 of 55 shingles in common, 0.818."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        line = _line(rng, 54)
        other = list(line)
        other[rng.randrange(10, 44)] = f"changed{i}"
        rows += [(2 * i, " ".join(line) + "\n" + " ".join(_line(rng, 20))), (2 * i + 1, " ".join(_line(rng, 20)) + "\n" + " ".join(other))]
    rows += [(1000 + i, " ".join(_line(rng, 60))) for i in range(50)]
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in got:
        if r["n_words"] == 54:
            classes.setdefault(r["class_id"], []).append(r)
    pairs = [sorted(x["doc_id"] for x in c) for c in classes.values() if len(c) == 2]
    assert all(b == a + 1 and a % 2 == 0 for a, b in pairs) and len(pairs) >= 295
    assert all(sum(x["removed"] for x in c) == 1 for c in classes.values() if len(c) == 2)
    assert not {r["doc_id"] for r in got if r["doc_id"] >= 1000}


def test_settled_keeps_the_result_and_deletes_what_it_was_made_of(spark):
    inner = []

    def build():
        inner.append(written(spark.range(10)))
        return inner[0].where("id > 6")

    out = settled(spark, build)
    assert sorted(r["id"] for r in out.collect()) == [7, 8, 9]
    folder = shared_folder(spark)
    assert not [x for x in os.listdir(folder) if x.startswith("scratch-")]
