"""Near-duplicate passages: paragraphs by MinHash banding, and passages set into longer paragraphs.

A paragraph is a line of at least ``min_words`` words: five, so that it has a shingle. Its five-word shingles are
banded, colliding paragraphs are confirmed by exact Jaccard and clustered by components, in one document or several. A passage that stands inside other
text has no line of its own: runs of ``core`` words that begin at content-chosen places are compared as
they are (Jaccard 1), and runs that continue each other are joined. Of each class the passage of the least
document hash, there the first, stays.

Defined cases: null and empty texts and rows without an id have no passages; rows of one id with other
texts come back each; repeated rows count once; no repeats give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.minhash_dedup import NearDuplicates, near_duplicates
from dataward.llm.passages import anchors
from dataward.llm.shared import extra_columns_dropped, settled, written


def tuned(percent: int, rows: int, miss: float) -> NearDuplicates:
    """The fewest bands of ``rows`` minima that miss a pair at the threshold with at most this probability."""
    bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
    return NearDuplicates(percent=percent, bands=bands, rows=rows)


@dataclass(frozen=True)
class Passages:
    """A shared passage of ``core + width - 1`` words or more (50 by default) is found wherever it stands."""

    percent: int = 80
    rows: int = 2
    miss: float = 0.0025
    min_words: int = 5
    core: int = 35
    width: int = 16


def _lines(spec: Passages, batches: Iterator[pa.RecordBatch]):
    """Of each slice of (doc, text): rows, documents, bytes, words, line bounds, and place, first word and id of each paragraph."""
    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        for low, _high, data, bounds in arrays.text_slices(batch.column(1)):
            words = arrays.Words(data, bounds, arrays.BLANK_WORDS)
            cuts = np.unique(np.concatenate([np.flatnonzero(data == 10), bounds]))
            first = np.searchsorted(words.start, cuts)
            place = np.flatnonzero(np.diff(first) >= spec.min_words)
            owner = np.searchsorted(bounds, cuts[place], "right") - 1
            at = first[place] - words.first[owner]
            own = doc[low + owner]
            ident = arrays.mix(own.view(np.uint64) + arrays.mix(at.astype(np.uint64) + np.uint64(1)))
            yield own, data, words, cuts, first, place, at, ident


def _paragraphs(spec: Passages, bands: NearDuplicates):
    """A map over (doc, text): id, document, first word, number of words, digest of the shingle set and band keys
    of each paragraph. Texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(4)
        factor = rng.integers(1, 1 << 63, bands.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = rng.integers(1, 1 << 63, bands.minima, dtype=np.uint64)
        for own, data, _words, cuts, first, place, at, ident in _lines(spec, batches):
            if not len(place):
                continue
            every = arrays.shingle_sets(data, cuts, arrays.BLANK_WORDS, bands.words)
            sets = [every[k] for k in place]
            flat = np.concatenate(sets)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])[:-1].astype(np.int64)
            keys = np.zeros((len(place), bands.bands), dtype=np.uint64)
            for k in range(bands.minima):
                # The low bits of a product are weak: only the upper half of each minimum counts.
                least = np.minimum.reduceat(flat * factor[k] + offset[k], starts) >> np.uint64(32)
                keys[:, k // bands.rows] = arrays.mix(keys[:, k // bands.rows] + least * factor[k] + np.uint64(k))
            yield pa.RecordBatch.from_arrays([
                arrays.signed(ident), pa.array(own), pa.array(at.astype(np.int32)), pa.array(np.diff(first)[place].astype(np.int32)),
                arrays.signed(np.add.reduceat(arrays.mix(flat), starts)), arrays.signed(np.add.reduceat(arrays.mix(flat + factor[0]), starts)),
                arrays.list_array(keys.view(np.int64).ravel(), np.full(len(place), bands.bands))],
                ["id", "doc", "at", "words", "d1", "d2", "bands"])

    return run


def _texts(spec: Passages, bits):
    """A map over (doc, text): id and text of the paragraphs whose place is set in ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _own, data, words, _cuts, first, place, _at, ident in _lines(spec, batches):
            some = np.flatnonzero(bits.value[(ident & np.uint64(len(bits.value) - 1)).astype(np.int64)])
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([
                arrays.signed(ident[some]),
                pa.array([raw[words.start[first[k]]:words.end[first[k + 1] - 1]].decode() for k in place[some]], pa.string())], ["id", "text"])

    return run


#: Most places of the bitmap that tells tasks which paragraphs are compared: 16 MB. It only spares shuffling; a join decides.
MOST_PLACES = 1 << 24


def _classes(docs: DataFrame, spec: Passages) -> DataFrame:
    """(doc, at, words, class, first) of each paragraph that stands twice, exactly or nearly.

    Equal sets are met first, by a minimum each. Only sets that share a band key with another one have their
    texts cut out, once for each set, and compared.
    """
    tuning = tuned(spec.percent, spec.rows, spec.miss)
    units = written(docs.select("doc", "text").mapInArrow(
        _paragraphs(spec, tuning), "id long, doc long, at int, words int, d1 long, d2 long, bands array<long>"))
    place = F.struct("doc", "at", "id")
    keyed = units.select("doc", "at", "id", "d1", "d2", F.posexplode("bands").alias("band", "key"))
    shared = written(keyed.groupBy("band", "key").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x != y").select("band", "key"))
    close = keyed.join(shared, ["band", "key"], "left_semi").groupBy("d1", "d2").agg(F.min(place).alias("rep"))
    close = written(close.select(F.col("rep.id").alias("id")))
    spark = docs.sparkSession
    n = close.count()
    bits = np.zeros(min(MOST_PLACES, 1 << max(10, (8 * n).bit_length())), dtype=bool)
    bits[close.select((F.col("id").bitwiseAND(F.lit(len(bits) - 1))).alias("x")).distinct().toArrow().column("x").to_numpy()] = True
    bits = spark.sparkContext.broadcast(bits)
    texts = docs.select("doc", "text").mapInArrow(_texts(spec, bits), "id long, text string").join(close, "id", "left_semi")
    near = settled(spark, lambda: near_duplicates(
        written(texts.dropDuplicates(["id"])).select(F.col("id").alias("doc_id"), "text"), tuning).select(
        F.col("doc_id").alias("id"), F.col("component_id").alias("class")))
    sets = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    near = near.withColumn("n", F.lit(1)).withColumnRenamed("id", "rep")
    sets = sets.join(near, sets["first.id"] == near["rep"], "left").where("n is not null or first != last").select(
        "d1", "d2", "first", "last", F.coalesce("class", "first.id").alias("class"))
    sets = written(sets)
    twice = sets.groupBy("class").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first != last").select("class", "first")
    sets = written(sets.select("d1", "d2", "class").join(twice, "class"))
    return units.select("doc", "at", "words", "d1", "d2").join(sets, ["d1", "d2"]).select("doc", "at", "words", "class", "first").distinct()


def _shared_runs(docs: DataFrame, spec: Passages) -> DataFrame:
    """(doc, at, class, first) of each run of words that stands twice. Keys alone are counted first, so that only
    runs that occur again are shuffled with their places."""
    runs = written(docs.select("doc", "text").mapInArrow(_runs(spec), "doc long, key long, at int"))
    often = written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    runs = written(runs.join(often, "key", "left_semi"))
    place = F.struct("doc", "at")
    met = runs.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        (F.col("first.doc") != F.col("last.doc")) | (F.col("last.at") >= F.col("first.at") + spec.core))
    met = written(met.select("key", F.col("first.doc").alias("class"), F.col("first.at").alias("first")))
    return runs.join(met, "key").select("doc", "at", "class", "first")


def _runs(spec: Passages):
    """A map over (doc, text): the hash of the core-word run at each chosen place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _high, data, bounds in arrays.text_slices(batch.column(1)):
                words = arrays.Words(arrays.lower(data), bounds, arrays.BLANK_WORDS)
                at, key = anchors(words.codes(), words.row, spec.core, spec.width)
                row = words.row[at]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(low + row)), arrays.signed(key), pa.array((at - words.first[row]).astype(np.int32))],
                    ["doc", "key", "at"])

    return run


def _joined(spec: Passages):
    """A map over (doc_id, doc, text, lines, runs): one row for each passage, in code points."""

    def passages(doc: int, lines: list[dict], runs: list[dict]) -> list[tuple]:
        out = [(x["at"], x["at"] + x["words"], x["class"], x["removed"]) for x in lines]
        whole = [(a, b) for a, b, *_ in out]
        by_class: dict[tuple[int, bool], list[int]] = {}
        for x in runs:
            # A run that overlaps the first one of its document belongs to the passage that stays.
            removed = x["class"] != doc or x["at"] >= x["first"] + spec.core
            by_class.setdefault((x["class"], removed), []).append(x["at"])
        for (name, removed), found in by_class.items():
            found.sort()
            begin = 0
            for k in range(1, len(found) + 1):
                if k == len(found) or found[k] > found[k - 1] + spec.core:
                    a, b = found[begin], found[k - 1] + spec.core
                    if not any(x <= a and b <= y for x, y in whole):
                        out.append((a, b, name, removed))
                    begin = k
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, docs = batch.column(0), batch.column(1).to_pylist()
            lines, runs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for low, high, data, bounds in arrays.text_slices(batch.column(2)):
                words = arrays.Words(data, bounds, arrays.BLANK_WORDS)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                owner, rows = [], []
                for i in range(low, high):
                    first, base = words.first[i - low], points[bounds[i - low]]
                    for a, b, name, removed in passages(docs[i], lines[i] or [], runs[i] or []):
                        owner.append(i)
                        rows.append((int(points[words.start[first + a]] - base), int(points[words.end[first + b - 1]] - base), b - a, name, removed))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(owner, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], _OUT)

    return run


_OUT = ["doc_id", "start", "end", "n_words", "class_id", "removed"]


def repeated_paragraphs(docs: DataFrame, spec: Passages = Passages()) -> DataFrame:
    """A row for each passage of ``docs`` (doc_id, text) that stands twice, in one document or several: doc_id,
    start and end (code points), n_words, the class of equal or near passages, and whether all but one of it would go.

    Documents and paragraphs go by 64-bit hashes of their id, text and place.
    """
    docs = extra_columns_dropped(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    spark = docs.sparkSession
    runs = settled(spark, lambda: _shared_runs(docs, spec))
    classes = settled(spark, lambda: _classes(docs, spec))
    removed = (F.struct("doc", "at") != F.struct("first.doc", "first.at")).alias("removed")
    lines = classes.groupBy("doc").agg(F.collect_set(F.struct("at", "words", "class", removed)).alias("lines"))
    runs = runs.groupBy("doc").agg(F.collect_set(F.struct("at", "class", "first")).alias("runs"))
    found = written(lines.join(runs, "doc", "full"))
    texts = docs.join(found.select("doc"), "doc", "left_semi").dropDuplicates(["doc"])
    return texts.join(found, "doc").select("doc_id", "doc", "text", "lines", "runs").mapInArrow(
        _joined(spec), f"doc_id {kind}, start long, end long, n_words long, class_id long, removed boolean")
