"""Winnowed document fingerprints, and how they stand an edit.

Hashes of all k-byte runs are taken; in every window of w neighbouring ones the least is chosen, the
rightmost among equals, and its position is kept. A run of w + k - 1 equal bytes in two texts therefore
leaves at least one common hash. Tiny texts are winnowed very finely, short ones finely, texts from 512
bytes coarsely; the ranges of length overlap, so that a text and its edited form always share a way.

Defined cases: a null text is an empty one; an empty text has the fingerprint "" and likeness 1 to another
empty text; a text below k bytes has its whole as the one run; ids that repeat are ordered by text, a null
id comes last; with one row the next document is the row itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.shared import extra_columns_dropped

#: name: (k, w as a power of two, least bytes, end of bytes)
WAYS = {"t": (3, 2, 0, 96), "f": (8, 4, 48, 1024), "c": (16, 64, 512, 1 << 62)}


def winnow(data: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, 32-bit hash) of the chosen runs of each row, in order."""
    sizes = np.diff(bounds)
    words = arrays.Words(data, bounds, np.zeros(256, dtype=bool))
    first = bounds[:-1]
    grams = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
    total = int(grams.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    row = np.repeat(np.arange(len(sizes)), grams)
    begin = np.concatenate([[0], np.cumsum(grams)])
    inside = np.arange(total) - begin[row]
    start = first[row] + inside
    hashes = words._spans(start, np.minimum(start + k, bounds[1:][row])) >> np.uint64(32)
    # Least hash first, then the later place: the complement of the place breaks ties to the right.
    key = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(total, dtype=np.uint64))
    least, step = key, 1
    while step < w:
        later = np.concatenate([least[step:], np.full(min(step, total), ~np.uint64(0))])[:total]
        least = np.minimum(least, later)
        step *= 2
    whole = inside <= np.maximum(grams[row] - w, 0)
    short = (grams > 0) & (grams < w)
    chosen = least[whole & ~short[row]]
    if short.any():
        chosen = np.concatenate([chosen, np.minimum.reduceat(key, begin[:-1][grams > 0])[short[grams > 0]]])
    place = np.unique((np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64))
    return row[place], inside[place], hashes[place].astype(np.uint32)


class _Prints:
    """Fingerprints of a list of texts: by way, the hashes and places of each text that has this way."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        self.by_way: dict[str, list] = {w: [None] * n for w in WAYS}
        for low, high, data, bounds in arrays.text_slices(pa.array(texts, pa.large_string())):
            sizes = np.diff(bounds)
            for way, (k, w, least, end) in WAYS.items():
                fits = (sizes >= least) & (sizes < end)
                if not fits.any():
                    continue
                if fits.all():
                    part, cut = data, bounds
                else:
                    part = data[np.repeat(fits, sizes)]
                    cut = np.concatenate([[0], np.cumsum(sizes[fits])])
                row, place, value = winnow(part, cut, k, w)
                edge = np.searchsorted(row, np.arange(int(fits.sum()) + 1))
                for i, r in enumerate(np.flatnonzero(fits)):
                    self.by_way[way][low + r] = value[edge[i]:edge[i + 1]], place[edge[i]:edge[i + 1]]

    def of(self, i: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {w: x[i] for w, x in self.by_way.items() if x[i] is not None}


def _spelled(prints: dict) -> str:
    return "".join(w + v.astype(">u4").tobytes().hex() for w, (v, _) in prints.items() if len(v))


def likeness(one: dict, two: dict) -> float:
    """The Jaccard share of common hashes in the finest way that both have."""
    for way in WAYS:
        if way in one and way in two:
            x, y = np.unique(one[way][0]), np.unique(two[way][0])
            both = len(np.intersect1d(x, y, assume_unique=True))
            all_ = len(x) + len(y) - both
            return both / all_ if all_ else 1.0
    return 0.0


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map over (doc_id, text, chunk, guest), sorted: each row with the row after it in its chunk.

    The guest of a chunk is the row that follows its last one; it is read and not returned.
    """

    def pieces():
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append(row)
                    size += len(row[1])
                    if size >= arrays.SLICE_BYTES:
                        yield held
                        held, size = held[-1:], 0
        if len(held) > 1:
            yield held

    for rows in pieces():
        texts = [r[1] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if rows[i][2] == rows[i + 1][2] and not rows[i][3]]
        edited = []
        for i in pairs:
            n = len(texts[i])
            edited.append(texts[i][:n - n // 3] + texts[i + 1][:n // 3])
        own, after = _Prints(texts), _Prints(edited)
        columns: dict[str, list] = {c: [] for c in _OUT}
        for k, i in enumerate(pairs):
            mine, changed, following = own.of(i), after.of(k), own.of(i + 1)
            columns["doc_id"].append(rows[i][0])
            columns["n_chars"].append(len(texts[i]))
            columns["edited_sha256"].append(hashlib.sha256(edited[k].encode()).hexdigest())
            columns["fingerprint"].append(_spelled(mine))
            columns["edited_fingerprint"].append(_spelled(changed))
            columns["near_edited"].append(likeness(mine, changed))
            columns["near_next"].append(likeness(mine, following))
            columns["positions"].append(np.concatenate([p for _, p in mine.values()]) if mine else [])
        yield pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in _OUT.items()], [*_OUT])


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
        "near_edited": pa.float64(), "near_next": pa.float64(), "positions": pa.list_(pa.int32())}


def fingerprints(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its text with the last third replaced by
    the start of the next document, in descending order of ids; byte positions of the chosen runs.

    The ids are cut into ``chunks`` ranges of about equal numbers (default: as many as the table has input
    partitions). One shuffle brings a range together and its rows are read in order; the first row of the
    next range comes along as a guest, so no order over the whole table is needed.
    """
    docs = extra_columns_dropped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = chunks or max(8, docs.rdd.getNumPartitions())
    steps = [k / chunks for k in range(1, chunks)]
    cuts = docs.agg(F.percentile_approx("doc_id", steps, 10 * chunks).alias("x")).first()["x"] if steps else []
    bounds = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def chunk_of(ids):
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(dtype=np.int64)).astype("int32"))

    placed = docs.withColumn("chunk", chunk_of(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))))
    heads = {r["chunk"]: r["head"] for r in placed.groupBy("chunk").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    hosts = {}  # the id that follows the last row of a chunk
    for k, c in enumerate(order):
        hosts[c] = heads[order[k - 1]]  # the lowest chunk is followed by the first row of the highest
    if hosts:
        pairs = F.array(*[F.struct(F.lit(c).alias("chunk"), F.lit(h).cast("long").alias("head")) for c, h in hosts.items()])
        known = sorted({h for h in hosts.values() if h is not None})
        guest = docs.where(F.col("doc_id").isin(known) if known else F.col("doc_id").isNull()).groupBy("doc_id").agg(F.min("text").alias("text"))
        guests = guest.select("doc_id", "text", F.explode(F.filter(pairs, lambda p: p["head"].eqNullSafe(F.col("doc_id")))).alias("p")).select(
            "doc_id", "text", F.col("p.chunk").alias("chunk"), F.lit(True).alias("guest"))
        placed = placed.withColumn("guest", F.lit(False)).unionByName(guests)
    else:
        placed = placed.withColumn("guest", F.lit(False))
    ordered = placed.repartition(chunks, "chunk").sortWithinPartitions("chunk", "guest", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, positions array<int>")
