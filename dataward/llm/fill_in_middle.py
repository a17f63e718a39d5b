"""Fill-in-middle: cut a text at two token ends and move its middle to the end.

A text's token ends are kept as a boundary set in the manner of Roaring bitmaps: offsets are split by their
high bits into containers of 65,536 places, each an array, a bitmap or a list of runs, whichever is smallest,
with the number of ends before each container. The k-th end is found by a search over these numbers and a
select inside one container.

Defined cases: a null text is an empty one; an empty text, or one that holds a marker, stays plain; a null
``doc_id`` is hashed as the empty string; repeated rows all come back, alike; a text of blanks is one token;
an empty table gives an empty result; further columns are ignored. A text is handled whole, however long:
its boundary set takes at most two bytes an end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.shared import extra_columns_dropped

#: Places of one container, and how many of them an array container may hold before a bitmap is smaller.
PLACES, ARRAY_MOST = 1 << 16, 4096


class ArrayContainer:
    """Few places: their sorted list."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Many scattered places: one bit each, and how many bits are set before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(PLACES, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    """Neighbouring places: where each run starts, and how many places lie in the runs before it."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.start = low[first].astype(np.uint16)
        self.before = first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def _container(low: np.ndarray):
    runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
    if 4 * runs < min(2 * len(low), PLACES // 8):
        return RunContainer(low)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A set of offsets, given in ascending order without repeats."""

    def __init__(self, offsets: np.ndarray):
        offsets = np.asarray(offsets, dtype=np.int64)
        self.keys, first = np.unique(offsets >> 16, return_index=True)
        ends = np.append(first[1:], len(offsets))
        self.before = first
        self.containers = [_container(offsets[a:b] & (PLACES - 1)) for a, b in zip(first, ends, strict=True)]
        self.cardinality = len(offsets)

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones."""
        if not 0 <= k < self.cardinality:
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[c]) << 16) + self.containers[c].select(k - int(self.before[c]))

    def cut(self, units: int) -> int:
        """Where ``units`` units end: offset 0 before the first."""
        return self.select(units - 1) if units else 0


@dataclass(frozen=True)
class FillInMiddle:
    """How often texts are cut and how the parts are laid out.

    ``percent`` of the texts are cut, of these ``suffix_first`` percent as suffix, prefix, middle and the others
    as prefix, suffix, middle. Units are ``word``s with the blanks before them, or every ``char``.
    """

    percent: int = 50
    suffix_first: int = 80
    seed: int = 42
    unit: str = "word"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def draws(self, doc_id: str) -> tuple[int, ...]:
        digest = hashlib.sha256(f"{self.seed}:{doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))

    def form(self, text: str, spm_or_not: int, cut_or_not: int) -> str:
        if not text or any(m in text for m in (self.prefix, self.suffix, self.middle)) or cut_or_not % 100 >= self.percent:
            return "plain"
        return "spm" if spm_or_not % 100 < self.suffix_first else "psm"


class _Units:
    """Unit ends of the rows of one slice, as code points from the start of each row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, unit: str):
        self.at = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=self.at[1:])
        self.base, self.size = self.at[bounds[:-1]], np.diff(self.at[bounds])
        self.unit = unit
        if unit == "char":
            self.counts = self.size
            return
        if unit != "word":
            raise ValueError(f"unknown unit: {unit}")
        self.words = arrays.Words(data, bounds, arrays.BLANK_WORDS)
        last = np.where(self.words.counts > 0, self.words.end[np.maximum(self.words.first[1:], 1) - 1] if len(self.words.end) else 0, bounds[:-1])
        self.tail = last < bounds[1:]  # blanks after the last word are a unit
        self.counts = self.words.counts + self.tail

    def ends(self, i: int) -> np.ndarray:
        if self.unit == "char":
            return np.arange(1, self.size[i] + 1)
        ends = self.at[self.words.end[self.words.first[i]:self.words.first[i + 1]]] - self.base[i]
        return np.append(ends, self.size[i]) if self.tail[i] else ends


def _transform(spec: FillInMiddle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(2)):
                units = _Units(data, bounds, spec.unit)
                rows = []
                for i in range(high - low):
                    text = data[bounds[i]:bounds[i + 1]].tobytes().decode()
                    n = int(units.counts[i])
                    h1, h2, h3, h4 = spec.draws(batch.column(1)[low + i].as_py())
                    form = spec.form(text, h4, h3)
                    if form == "plain":
                        rows.append((n, form, None, None, text))
                        continue
                    ends = BoundarySet(units.ends(i))
                    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = ends.cut(one), ends.cut(two)
                    before, inside, after = spec.prefix + text[:a], spec.middle + text[a:b], spec.suffix + text[b:]
                    rows.append((n, form, a, b - a, after + before + inside if form == "spm" else before + after + inside))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low)]
                    + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, spec: FillInMiddle = FillInMiddle()) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output for each row of ``docs``.

    Cuts and form follow from the hash of seed and id alone, so a repeated run gives the same texts. Rows stay
    in the task that reads them.
    """
    docs = extra_columns_dropped(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text").mapInArrow(
        _transform(spec), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, spec: FillInMiddle = FillInMiddle()) -> Column:
    """The text that an output was made from. A text that is cut holds no marker, so each marker stands once."""
    def between(start: str, end: str | None) -> Column:
        rest = F.substring_index(output, start, -1)
        return rest if end is None else F.substring_index(rest, end, 1)

    psm = F.concat(between(spec.prefix, spec.suffix), between(spec.middle, None), between(spec.suffix, spec.middle))
    spm = F.concat(between(spec.prefix, spec.middle), between(spec.middle, None), between(spec.suffix, spec.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
