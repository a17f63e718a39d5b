"""Near-duplicate documents by MinHash banding, exact confirmation and connected components.

Input: ``doc_id`` and ``text``; further columns are ignored. Words are what lies between blanks, with A-Z
lower-cased; a document's set holds its distinct five-word shingles (fewer words: the whole sequence).

Defined cases: a null or wordless text has an empty set, is linked with nothing and is its own component;
a null ``doc_id`` keeps its row, with a null component and ``kept`` false, unless its set equals another's;
repeated rows all come back; equal sets meet in one class before any pair is formed; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.components import components
from dataward.llm.shared import extra_columns_dropped, written


#: Places of the bitmap that tells tasks which texts are compared: 4 MB, whatever the number of texts.
PLACES = 1 << 22


@dataclass(frozen=True)
class NearDuplicates:
    """Linked are documents with 100 * intersection >= percent * union.

    At 85 percent, 24 bands of 5 rows miss a link with probability (1 - 0.85^5)^24, below 1e-6. ``slack``
    standard deviations below the threshold are let through by the comparison of signatures; the decision
    itself is made on full sets.
    """

    percent: int = 85
    words: int = 5
    bands: int = 24
    rows: int = 5
    slack: float = 5.0

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal minima below which a pair is surely no link."""
        j = self.percent / 100
        return max(1, int(self.minima * (j - self.slack * (j * (1 - j) / self.minima) ** 0.5)))


def _signatures(spec: NearDuplicates):
    """A map over (doc_id, text): set size, order-free 128-bit digest of the set, minima, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(8)
        factor = rng.integers(1, 1 << 63, spec.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = rng.integers(1, 1 << 63, spec.minima, dtype=np.uint64)
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                sets = arrays.shingle_sets(data, bounds, arrays.BLANK_WORDS, spec.words)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(sizes)
                flat = np.concatenate(sets)
                starts = np.concatenate([[0], np.cumsum(sizes[some])])[:-1].astype(np.int64)
                minima = np.zeros((spec.minima, len(some)), dtype=np.uint64)
                digest = np.zeros((2, len(sizes)), dtype=np.uint64)
                if len(some):
                    for k in range(spec.minima):
                        minima[k] = np.minimum.reduceat(flat * factor[k] + offset[k], starts)
                    digest[0, some] = np.add.reduceat(arrays.mix(flat), starts)
                    digest[1, some] = np.add.reduceat(arrays.mix(flat + factor[0]), starts)
                minima >>= np.uint64(32)
                bands = np.zeros((len(some), spec.bands), dtype=np.uint64)
                for b in range(spec.bands):
                    part = minima[b * spec.rows:(b + 1) * spec.rows]
                    bands[:, b] = arrays.mix((part * factor[:spec.rows, None]).sum(axis=0, dtype=np.uint64) + np.uint64(b))
                signature = np.ascontiguousarray(minima.T.astype(np.uint32)).view(np.uint8)
                per_row = np.where(sizes > 0, 1, 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(sizes), arrays.signed(digest[0]), arrays.signed(digest[1]),
                    pa.array([signature[k].tobytes() for k in range(len(some))], pa.binary()).take(_place(per_row)),
                    arrays.list_array(bands.view(np.int64).ravel(), per_row * spec.bands),
                ], ["doc_id", "n_shingles", "d1", "d2", "signature", "bands"])

    return run


def _place(per_row: np.ndarray) -> pa.Array:
    place = np.cumsum(per_row) - 1
    return pa.array(np.where(per_row > 0, place, 0), mask=per_row == 0)


def _sets(spec: NearDuplicates, bits):
    """A map over (doc_id, text, place): the sorted set of each text whose place is set in ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bits.value[batch.column(2).to_numpy()]))
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                sets = arrays.shingle_sets(data, bounds, arrays.BLANK_WORDS, spec.words)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low),
                    arrays.list_array(np.concatenate(sets).view(np.int64), [len(s) for s in sets])], ["rep", "set"])

    return run


def _similar_signatures(spec: NearDuplicates):
    """A map over pairs with both signatures: pairs that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, spec.minima) for c in (2, 3))
            near = pa.array((left == right).sum(axis=1) >= spec.least_equal)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return run


def _confirmed(spec: NearDuplicates):
    """A map over pairs with both sets: pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= spec.percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with the named value of either end."""
    one = values.select(F.col("rep").alias("a"), F.col(name).alias("x"))
    two = values.select(F.col("rep").alias("b"), F.col(name).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def _sharing_rare(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (rep, mate) of different components that may still be links: no link between ``reps`` is missed.

    Sort every set by how few of the sets hold a shingle. Two sets of a and b shingles that are linked have at
    least o = percent / (100 + percent) * (a + b) in common, so they share one within the first a - o + 1 and
    b - o + 1 of them. Near copies of one text have their own edits there and do not meet.
    """
    items = sets.join(reps, "rep").select("rep", "n_shingles", "component", F.explode("set").alias("shingle"))
    held = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    # Shingles of one component alone take their place in the order but join nothing.
    held = held.select("shingle", "n", (F.col("low") != F.col("high")).alias("open"))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    sorted_ = items.join(held, "shingle").groupBy("rep", "n_shingles", "component").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "shingle", "open"))), F.lit(1), F.first(first).cast("int")).alias("rare"))
    rare = written(sorted_.select("rep", "n_shingles", "component", F.posexplode("rare").alias("at", "x")).where("x.open").select(
        "rep", "n_shingles", "component", "at", F.col("x.shingle").alias("shingle")))
    mate = rare.select("shingle", *[F.col(c).alias(f"mate_{c}") for c in ("rep", "n_shingles", "component", "at")])
    common = F.ceil((F.col("n_shingles") + F.col("mate_n_shingles")) * percent / (100 + percent))
    return rare.join(mate, "shingle").where(
        (F.col("component") < F.col("mate_component"))
        & (F.col("at") <= F.col("n_shingles") - common) & (F.col("mate_at") <= F.col("mate_n_shingles") - common)).select(
        "rep", F.col("mate_rep").alias("mate"))


def near_duplicates(docs: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Links are looked for between classes of equal sets. In a bucket of equal band keys every class is first
    compared with the least class alone; confirmed links are contracted to components, and only classes that
    share a bucket but no component yet are compared further: with the last class of the bucket, then with
    those classes of other components that share a shingle among the rarest of both. So a group of thousands
    of near copies costs a row per copy and band, and no link that changes a component is lost.
    """
    docs = extra_columns_dropped(docs, "doc_id", "text")
    rows = written(docs.mapInArrow(
        _signatures(spec), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, d1 long, d2 long, signature binary, bands array<long>"))
    full = rows.where(F.col("n_shingles") > 0)
    classes = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    reps = classes.where(F.col("rep").isNotNull())
    # One row of each class: the least document, whose repeated rows are all alike.
    chosen = written(full.join(reps, ["d1", "d2"]).where(F.col("doc_id") == F.col("rep"))
                     .dropDuplicates(["rep"]).select("rep", "n_shingles", "signature", "bands"))
    buckets = written(chosen.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key")))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    buckets = written(buckets.join(shared, ["band", "key"]))
    inside = buckets.select("rep").distinct()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # Texts are not shuffled: a bitmap of fixed size lets through all that are needed and few others.
    place = F.pmod(F.xxhash64("rep"), F.lit(PLACES))
    bits = np.zeros(PLACES, dtype=bool)
    bits[inside.select(place.alias("x")).distinct().toArrow().column("x").to_numpy()] = True
    bits = docs.sparkSession.sparkContext.broadcast(bits)
    near = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("rep"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("x"))
    sets = written(near.mapInArrow(_sets(spec, bits), f"rep {id_type}, set array<long>").join(inside, "rep", "left_semi").dropDuplicates(["rep"]))
    signatures = chosen.join(inside, "rep", "left_semi").select("rep", "signature")

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = _with_both(pairs, signatures, "signature").mapInArrow(_similar_signatures(spec), f"a {id_type}, b {id_type}")
        return written(_with_both(written(near), sets, "set").mapInArrow(_confirmed(spec), f"a {id_type}, b {id_type}"))

    def ordered(a, b) -> tuple:
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    links = tested = labels = None
    for stage in ("least", "last", "rest"):
        if labels is None:
            marked = buckets.withColumn("component", F.col("rep"))
        else:
            marked = buckets.join(labels, buckets["rep"] == labels["node"], "left").select(
                "rep", "n_shingles", "band", "key", F.coalesce("component", "rep").alias("component"))
        end = F.struct("component", "rep", "n_shingles")
        open_ = marked.groupBy("band", "key").agg(F.min(end).alias("low"), F.max(end).alias("high")).where(
            F.col("low.component") != F.col("high.component"))
        if stage == "rest":
            left = marked.join(open_.select("band", "key"), ["band", "key"], "left_semi").select("rep", "n_shingles", "component").distinct()
            pairs = _sharing_rare(written(left), sets, spec.percent).select(*ordered(F.col("rep"), F.col("mate")))
        else:
            hub = F.col("low" if stage == "least" else "high")
            pairs = marked.join(open_, ["band", "key"]).where(
                (F.col("component") != hub["component"])
                & (100 * F.least("n_shingles", hub["n_shingles"]) >= spec.percent * F.greatest("n_shingles", hub["n_shingles"]))
            ).select(*ordered(F.col("rep"), hub["rep"]))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = confirmed(pairs)
        links = fresh if links is None else links.unionByName(fresh)
        labels = components(links)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    # Wordless rows have no class and stay alone.
    joined = rows.select("doc_id", "n_shingles", "d1", "d2").join(
        named, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
