"""Main text of web pages by a maximum-scoring run of words and tags.

A page becomes a sequence of words and tags. Weights come from labelled pages: those whose markup names
the article itself (``article`` or ``main``) say which words and tags lie inside. A word scores by what its
enclosing tags and their class names say, a tag costs by its name. A linear scan finds the contiguous run
with the greatest sum; of this the words that score above zero are the text, block by block.

Defined cases: a null or empty page, and one without a word that scores above zero, gives an empty text; cut
off markup ends at the end of the page; an unclosed tag ends with its parent; repeated rows each come back.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm.shared import extra_columns_dropped

#: Places of the weight table; names of tags and classes are hashed to it.
PLACES = 1 << 14
#: Rows that an unlabelled page counts for before a name has been seen: inside, outside.
PRIOR = (1.0, 1.0)

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_LIGHT = frozenset("p b i em strong br h1 h2 h3 h4 h5 h6 blockquote pre code sub sup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|head|select|button"
#: Tags whose words are never article text.
_OUT = frozenset("nav footer aside form menu dialog fieldset label header".split())
#: Parts of class, id and role names that mark what surrounds an article.
_OUT_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|notice|notices|alert|menu|nav|navbar|navigation|"
    r"sidebar|side|aside|footer|header|masthead|comments?|disqus|replies|reply|share|sharing|social|related|recommended|newsletter|subscribe|signup|breadcrumbs?|"
    r"popup|modal|overlay|login|search|pagination|pager|toolbar|widget|copyright|complementary|contentinfo)(?:[^a-z]|$)")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _place(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % PLACES


class Page:
    """The words and tags of a page in order; each text with the names around it, and whether it is inside."""

    def __init__(self, source: str):
        #: (kind, value, names, inside): kind 0 a text, 1 a tag, 2 the edge of a block
        self.items: list[tuple[int, str, tuple[str, ...], bool]] = []
        self.labelled = False
        stack: list[tuple[str, tuple[str, ...], bool, bool]] = []  # tag, names, inside an article, outside the text
        at = 0
        for m in _TOKEN.finditer(source):
            self._text(source[at:m.start()], stack)
            at = m.end()
            if m[3] is None and m[6] is None:
                if m[1] is None and not m[0].startswith("<![CDATA["):
                    continue
                if m[1] is None:
                    self._text(m[0][9:].removesuffix("]]>"), stack)
                continue
            closing, tag, rest = (m[2], m[3].lower(), m[4]) if m[3] is not None else (m[5], m[6].lower(), m[7])
            if closing:
                if any(s[0] == tag for s in stack):
                    while stack and stack.pop()[0] != tag:
                        pass
                elif tag != "p":
                    continue
            elif tag == "br":
                self.items.append((0, " ", (), False))
                continue
            else:
                if tag == "p" and any(s[0] == "p" for s in stack):
                    self._leave(stack, "p")
                elif tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1][0] == tag:
                    stack.pop()
                names = self._names(tag, rest)
                inside = bool(stack and stack[-1][2]) or tag in ("article", "main")
                heading = tag == "header" and any(s[0] == "article" for s in stack)
                out = bool(stack and stack[-1][3]) or (tag in _OUT and not heading) or "?out" in names
                self.labelled |= tag in ("article", "main")
                if tag not in _VOID and not rest.rstrip().endswith("/"):
                    stack.append((tag, names, inside, out))
            inside, out = bool(stack and stack[-1][2]), bool(stack and stack[-1][3])
            self.items.append((2 if tag in _BLOCKS else 1, tag, ("?out",) if out else (), inside))
        self._text(source[at:], stack)

    @staticmethod
    def _leave(stack: list, tag: str) -> None:
        """Ends the nearest such tag unless another block stands between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in _BLOCKS:
                return

    @staticmethod
    def _names(tag: str, rest: str) -> tuple[str, ...]:
        names = [tag]
        for m in _NAMES.finditer(rest or ""):
            value = (m[1] or m[2] or m[3] or "").lower()
            names += [f".{x}" for x in value.split()]
            if tag not in ("body", "html") and _OUT_NAMES.search(value):
                names.append("?out")
        return tuple(names)

    def _text(self, raw: str, stack: list) -> None:
        if raw:
            names = tuple(dict.fromkeys(n for s in stack for n in s[1] if n not in ("html", "body", "article", "main")))
            out = bool(stack and stack[-1][3])
            self.items.append((0, entities.unescape(raw), names + (("?out",) if out and "?out" not in names else ()), bool(stack and stack[-1][2])))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map over (html): for each name the words inside and outside the articles of labelled pages."""
    table = np.zeros((2, PLACES), dtype=np.int64)
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = Page(source or "")
            if not page.labelled:
                continue
            for kind, value, names, inside in page.items:
                # What the names of boilerplate explain says nothing about the other names around it.
                if "?out" in names:
                    continue
                side = 0 if inside else 1
                if kind:
                    table[side, _place(f"<{value}>")] += 1
                elif n := len(value.split()):
                    for name in (*names, "" if inside else "?beside"):
                        table[side, _place(name)] += n
    some = np.flatnonzero(table.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[0, some]), pa.array(table[1, some])], ["place", "inside", "outside"])


class Weights:
    """Scores of words by their names and costs of tags, from counts of labelled pages."""

    def __init__(self, counts: dict[int, tuple[int, int]]):
        self.counts = counts
        self._word: dict = {}
        self._tag: dict = {}

    def _odds(self, name: str, prior: tuple[float, float]) -> float:
        a, b = self.counts.get(_place(name), (0, 0))
        return math.log((a + prior[0]) / (b + prior[1]))

    def word(self, names: tuple[str, ...], beside: bool) -> float:
        """Between -4 and 1; a word among names of boilerplate is never text, and costs little, so that a
        notice in the midst of an article does not part it."""
        key = names, beside
        if key not in self._word:
            if "?out" in names:
                score = -0.02
            else:
                worst = min([self._odds(n, PRIOR) for n in names], default=0.0)
                score = 1.0 if worst > -1 else max(-4.0, worst)
                if beside:
                    score = min(score, self._odds("?beside", (1.0, 50.0)))
            self._word[key] = max(-4.0, min(1.0, score))
        return self._word[key]

    def tag(self, name: str, labelled: bool) -> float:
        """Below zero: tags of running text cost little, others and those that stand outside articles more.
        Where the page itself names its article, tags hardly count."""
        if labelled:
            return -0.01
        if name not in self._tag:
            self._tag[name] = -(0.1 if name in _LIGHT else 1.0) - min(3.0, max(0.0, -self._odds(f"<{name}>", (10.0, 10.0))))
        return self._tag[name]


def main_text(source: str | None, weights: Weights) -> str:
    """The text of the best run of the page."""
    page = Page(source or "")
    if not page.items:
        return ""
    scores, kept = [], []
    for kind, value, names, inside in page.items:
        if kind:
            scores.append(-0.01 if "?out" in names else weights.tag(value, page.labelled))
            kept.append(False)
        else:
            each = weights.word(names, page.labelled and not inside)
            scores.append(each * len(value.split()))
            kept.append(each > 0 or not value.strip())
    best, begin, span, total, start = 0.0, 0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    blocks, current = [], []
    for i in range(*span):
        kind, value, _, _ = page.items[i]
        if kind == 2:
            blocks.append(current)
            current = []
        elif kind == 0 and kept[i]:
            current.append(value)
    blocks.append(current)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def learned_weights(pages: DataFrame) -> Weights:
    """Weights from all labelled rows of ``pages`` (html); at most ``PLACES`` sums reach the driver."""
    rows = extra_columns_dropped(pages, "html").mapInArrow(_counts, "place int, inside long, outside long")
    rows = rows.groupBy("place").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return Weights({r["place"]: (r["inside"], r["outside"]) for r in rows})


def page_texts(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    weights = weights or learned_weights(pages)
    counts = weights.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(counts)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(x.as_py(), own) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    base = extra_columns_dropped(pages, "page_id", "url", "html")
    kinds = [base.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return base.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
