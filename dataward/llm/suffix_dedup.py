"""Repeated passages by a sparse suffix array.

Suffixes are kept at content-selected minimiser places only; those that share their first words with another
document are candidates. Runs of ``min_words`` words around candidates are compared whole and joined to
passages, so that a passage counts exactly if at least ``min_words`` words are the same in two documents.
Words lie between blanks, A-Z lower-cased.

Defined cases: null and empty texts and rows without an id have no passages; repeated rows count as one
document, rows of one id with other texts come back each, compared with other ids alone; a passage that one
document repeats is judged at each of its places; no repeats give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.passages import anchors
from dataward.llm.shared import extra_columns_dropped, written


@dataclass(frozen=True)
class Repeats:
    """``width`` neighbouring places share one kept suffix; the first ``core`` words of a suffix are its key."""

    min_words: int = 50
    width: int = 16

    @property
    def core(self) -> int:
        return self.min_words - self.width + 1

    @property
    def reach(self) -> int:
        """Words on either side of a core: the kept places of a passage leave no more than these at its ends."""
        return self.width - 1


def _suffixes(spec: Repeats):
    """A map over (doc_id, text): the key of each kept suffix, and the words around its core.

    ``around`` is a hash of up to ``reach`` words before and after the core, which lie in words start to end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(spec.reach)
        weight = np.random.default_rng(9).integers(1, 1 << 63, 2 * spec.reach, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for low, _high, data, bounds in arrays.text_slices(batch.column(1)):
                words = arrays.Words(arrays.lower(data), bounds, arrays.BLANK_WORDS)
                codes = words.codes()
                at, key = anchors(codes, words.row, spec.core, spec.width)
                enough = words.counts[words.row[at]] >= spec.min_words
                at, key = at[enough], key[enough]
                row = words.row[at]
                near = np.concatenate([at[:, None] - 1 - step, at[:, None] + spec.core + step], axis=1)
                there = (near >= words.first[row][:, None]) & (near < words.first[row + 1][:, None])
                around = (np.where(there, codes[np.where(there, near, at[:, None])], np.uint64(0)) * weight).sum(axis=1, dtype=np.uint64)
                place = at - words.first[row]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(low + row)), arrays.signed(key), arrays.signed(arrays.mix(around)), pa.array(place.astype(np.int32)),
                    pa.array((place - there[:, :spec.reach].sum(axis=1)).astype(np.int32)),
                    pa.array((place + spec.core + there[:, spec.reach:].sum(axis=1)).astype(np.int32))],
                    ["doc_id", "key", "around", "at", "start", "end"])

    return run


def _runs(spec: Repeats):
    """A map over (doc_id, text, places): the hash of each run of ``min_words`` words that holds a core at a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                words = arrays.Words(arrays.lower(data), bounds, arrays.BLANK_WORDS)
                begin, hashes = arrays.windows(words.codes(), words.row, spec.min_words)
                places = batch.column(2).slice(low, high - low)
                counts = pa.compute.list_value_length(places).to_numpy()
                row = np.repeat(np.arange(high - low), counts)
                at = places.flatten().to_numpy() + words.first[row]
                wanted = np.zeros(len(words.start) + 1, dtype=bool)
                for back in range(spec.width):
                    inside = at - back >= words.first[row]
                    wanted[(at - back)[inside]] = True
                keep = wanted[begin]
                begin, hashes = begin[keep], hashes[keep]
                row = words.row[begin]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(low + row)), arrays.signed(hashes), pa.array((begin - words.first[row]).astype(np.int32))],
                    ["doc_id", "run", "start"])

    return run


def _char_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map over (doc_id, text, spans of words, partners): the same with spans of code points."""
    for batch in batches:
        for low, high, data, bounds in arrays.text_slices(batch.column(1)):
            words = arrays.Words(arrays.lower(data), bounds, arrays.BLANK_WORDS)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            spans, covered = [], []
            for i in range(low, high):
                k = i - low
                out, total = [], 0
                for s in batch.column(2)[i].as_py():
                    a, b = words.first[k] + s["start"], words.first[k] + s["end"] - 1
                    base = points[bounds[k]]
                    out.append({"start": int(points[words.start[a]] - base), "end": int(points[words.end[b]] - base)})
                    total += s["end"] - s["start"]
                spans.append(out)
                covered.append(total)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low), pa.array(covered, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                batch.column(3).slice(low, high - low)], ["doc_id", "n_words", "spans", "partners"])


def merged(spans):
    """A column of sorted, joined spans from an array of (start, end)."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))
        )).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))


def repeated_passages(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_words, spans (code points), partners for each document that shares a passage with another.

    Keys that one document alone has end with combinable extremes. Where all places of a key have the same
    words around them, these are shared as they stand. At other places every run of ``min_words`` words that
    holds the core is grouped by its own hash, so that nothing depends on which suffixes are neighbours or on
    how many hold a key. A partner is the least other document with the run (the greatest for the least itself).
    """
    docs = extra_columns_dropped(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text")).alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    suffixes = docs.mapInArrow(_suffixes(spec), f"doc_id {kind}, key long, around long, at int, start int, end int")
    ends = (F.min("doc_id.doc_id").alias("a"), F.max("doc_id.doc_id").alias("b"))
    shared = written(suffixes.groupBy("key").agg(*ends, (F.min("around") == F.max("around")).alias("alike")).where(F.col("a") != F.col("b")))
    partner = F.when(F.col("doc_id.doc_id") != F.col("a"), F.col("a")).otherwise(F.col("b")).alias("partner")
    met = written(suffixes.join(shared, "key").select("doc_id", "at", "start", "end", "alike", partner))
    places = written(met.where(~F.col("alike")).groupBy("doc_id").agg(F.collect_set("at").alias("places")))

    def with_text(part: DataFrame) -> DataFrame:
        """Rows of ``part`` with their text, once. Join and de-duplication share plain keys, so texts move once."""
        keys = [F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text").alias("hash")]
        rest = [c for c in part.columns if c != "doc_id"]
        both = docs.select(*keys, "text").join(part.select(*keys, *rest), ["id", "hash"]).dropDuplicates(["id", "hash"])
        return both.select(F.struct(F.col("id").alias("doc_id"), F.col("hash").alias("text")).alias("doc_id"), "text", *rest)

    runs = written(with_text(places).select("doc_id", "text", "places").mapInArrow(_runs(spec), f"doc_id {kind}, run long, start int"))
    # Written, so that the join deals its own rows and Spark can split a run that very many documents hold.
    common = written(runs.groupBy("run").agg(*ends).where(F.col("a") != F.col("b")))
    matches = met.where("alike").select("doc_id", "partner", "start", "end").unionByName(
        runs.join(common, "run").select("doc_id", partner, "start", (F.col("start") + spec.min_words).alias("end")))
    regions = written(matches.groupBy("doc_id").agg(
        merged(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("spans"), F.array_sort(F.collect_set("partner")).alias("partners")))
    return with_text(regions).select("doc_id", "text", "spans", "partners").mapInArrow(
        _char_spans, f"doc_id {kind}, n_words long, spans array<struct<start:bigint,end:bigint>>, partners array<{id_kind}>").withColumn("doc_id", F.col("doc_id.doc_id"))
