"""Benchmark decontamination by a broadcast set of test n-grams.

Words are runs of ASCII digits, letters (A-Z lower-cased) and bytes above ASCII. A window is ``n``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. A document
word inside any occurrence of a window is hit. Null texts have no words; null item ids are left out;
repeated rows of either table change nothing but their own number; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.shared import extra_columns_dropped, written

#: Windows that one broadcast block may hold (about 100 bytes each); more windows make more blocks.
BLOCK_WINDOWS = 500_000


def _spelled(words: arrays.Words, first: int, n: int) -> bytes:
    return b" ".join(words.data[words.start[i]:words.end[i]].tobytes() for i in range(first, first + n))


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _high, data, bounds in arrays.text_slices(batch.column(1)):
                words = arrays.Words(arrays.lower(data), bounds, arrays.PLAIN_WORDS)
                codes = words.codes()
                found = [(int(i), n, h) for i, h in zip(*arrays.windows(codes, words.row, n), strict=True)]
                for first, count in zip(words.first, words.counts):
                    if 0 < count < n:
                        found.append((int(first), int(count), arrays.sequence_hash(codes[first:first + count])))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([low + int(words.row[i]) for i, _, _ in found], pa.int64())),
                    pa.array([c for _, c, _ in found], pa.int32()),
                    pa.array(np.array([h for _, _, h in found], dtype=np.uint64).view(np.int64)),
                    pa.array([_spelled(words, i, c) for i, c, _ in found], pa.binary())], ["item", "words", "hash", "spelled"])

    return run


class _Block:
    """A lookup of windows: by length, the sorted hashes and for each the spellings with their items."""

    def __init__(self, rows):
        self.by_length: dict[int, tuple[np.ndarray, list[dict[bytes, list[str]]]]] = {}
        grouped: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for r in rows:
            grouped.setdefault(r["words"], {}).setdefault(r["hash"], {})[bytes(r["spelled"])] = list(r["items"])
        for length, found in grouped.items():
            order = sorted(found)
            self.by_length[length] = np.array(order, dtype=np.int64), [found[h] for h in order]


def _scan(block, carried: bool, onward: bool):
    """A map over (doc_id, text[, n_words, starts, ends, items]); text goes on only for a further block."""

    def hits(words: arrays.Words) -> dict[int, tuple[list[int], list[int], set[str]]]:
        out: dict[int, tuple[list[int], list[int], set[str]]] = {}
        codes = words.codes()
        for length, (hashes, spellings) in block.value.by_length.items():
            at, window = arrays.windows(codes, words.row, length)
            window = window.view(np.int64)
            place = np.minimum(np.searchsorted(hashes, window), len(hashes) - 1)
            for k in np.flatnonzero(hashes[place] == window):
                first = int(at[k])
                items = spellings[place[k]].get(_spelled(words, first, length))
                if items is not None:
                    row = int(words.row[first])
                    start, end, names = out.setdefault(row, ([], [], set()))
                    start.append(first - int(words.first[row]))
                    end.append(first - int(words.first[row]) + length)
                    names.update(items)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                words = arrays.Words(arrays.lower(data), bounds, arrays.PLAIN_WORDS)
                found = hits(words)
                starts, ends, items = [], [], []
                for i in range(high - low):
                    start, end, names = found.get(i, ([], [], set()))
                    if carried:
                        start = start + batch.column(3)[low + i].as_py()
                        end = end + batch.column(4)[low + i].as_py()
                        names = names | set(batch.column(5)[low + i].as_py())
                    starts.append(start)
                    ends.append(end)
                    items.append(sorted(names))
                columns = [batch.column(0).slice(low, high - low)]
                if onward:
                    columns.append(batch.column(1).slice(low, high - low))
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(words.counts.astype(np.int64)), pa.array(starts, pa.list_(pa.int32())),
                               pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id"] + ["text"] * onward + ["n_words", "starts", "ends", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings), spans (word ranges) for each row of ``docs``.

    The distinct windows of ``benchmark`` (item_id, text) go out in blocks of a checked size, each scanned
    over all documents without a shuffle; equal hashes are confirmed on the words themselves.
    """
    docs = extra_columns_dropped(docs, "doc_id", "text")
    items = extra_columns_dropped(benchmark, "item_id", "text").where(F.col("item_id").isNotNull())
    found = items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        _item_windows(n), "item string, words int, hash long, spelled binary")
    found = written(found.groupBy("words", "hash", "spelled").agg(F.array_sort(F.collect_set("item")).alias("items")))
    blocks = max(1, -(-found.count() // block_windows))
    out = docs
    kind = docs.schema["doc_id"].dataType.simpleString()
    for b in range(blocks):
        rows = found.where(F.pmod("hash", F.lit(blocks)) == b).toLocalIterator()
        block = docs.sparkSession.sparkContext.broadcast(_Block(rows))
        onward = b + 1 < blocks
        out = out.mapInArrow(_scan(block, b > 0, onward), f"doc_id {kind}, {'text string, ' if onward else ''}"
                             "n_words long, starts array<int>, ends array<int>, items array<string>")
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    # Ranges come sorted, so the words hit are counted in one pass.
    count = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"].cast("long"), a["to"]))).alias("n"),
        F.greatest(a["to"], s["end"].cast("long")).alias("to")), lambda a: a["n"])
    return out.select("doc_id", "n_words", count.alias("n_hit"), "items", spans.alias("spans"))
