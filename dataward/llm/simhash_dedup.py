"""Near-duplicate documents by SimHash: pigeonhole blocks, exact Hamming distances, connected components.

A fingerprint bit is set if more than half of the hashes of a document's shingles have it. Two fingerprints
that differ in at most d bits agree in at least m - d of m blocks; so they share one of the keys made of
m - d blocks, and only fingerprints with a common key are compared.

Input: ``doc_id`` and ``text``; further columns are ignored. Defined cases: a null, empty or blank text has the
fingerprint zero, which links like any other; fewer words than a shingle are one shingle; a null ``doc_id``
keeps its row, names no component, and has a null component if nothing with an id is reachable; repeated rows
all come back; an empty table gives an empty result; a very long text is counted in slices of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.components import components
from dataward.llm.shared import extra_columns_dropped, written

#: Hashes whose bits are spread out at a time.
_SLICE = 1 << 15
#: A label goes out by broadcast where its fingerprint holds more than one in so many rows: so many labels at most.
_HOT_SHARE = 1000


@dataclass(frozen=True)
class SimHash:
    """Linked are fingerprints that differ in at most ``distance`` of 64 bits.

    ``blocks`` is the number of blocks; by default the least that leaves no more than about one fingerprint to a
    key, from six on. Any number above ``distance`` gives the same links. ``chunk`` is how many fingerprints of
    one key are compared with as many others in one step.
    """

    words: int = 4
    seed: int = 42
    distance: int = 4
    blocks: int | None = None
    chunk: int = 1024

    def masks(self, count: int) -> list[int]:
        """The bits that each key keeps, as signed longs."""
        m = self.blocks or self.distance + 2
        while not self.blocks and count > 1 << (64 * (m - self.distance) // m):
            m += 1
        edges = [64 * k // m for k in range(m + 1)]
        block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(m)]
        kept = [sum(c) for c in combinations(block, m - self.distance)]
        return [x - (1 << 64) if x >> 63 else x for x in kept]


def simhash(hashes: list[int]) -> int:
    """The fingerprint of some unsigned 64-bit hashes: bits that over half of them have."""
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), _SLICE):
        part = np.array(hashes[low:low + _SLICE], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _hashes(lowered: bytes, words: int, seed: int) -> list[int]:
    parts = lowered.split()  # at 0x20 and 0x09-0x0D
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip((end - size)[:1 - words].tolist(), end[words - 1:].tolist(), strict=True)]


def _fingerprints(spec: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in arrays.text_slices(batch.column(1)):
                data = arrays.lower(data)
                prints = [simhash(_hashes(data[a:b].tobytes(), spec.words, spec.seed)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), arrays.signed(np.array(prints, dtype=np.uint64))], ["doc_id", "print"])

    return run


def _forest(pairs: np.ndarray) -> list[int]:
    """Places of the pairs that join what the pairs before them have not joined."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = top(a), top(b)
        if a != b:
            above[a] = b
            out.append(k)
    return out


def _compared(spec: SimHash):
    """A map over lists of (left, print, component): links from left to right ones and among left ones of
    different components, no more than join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            rows = lists.values
            left_, right_, print_, part_ = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ends = lists.offsets.to_numpy()
            found: list[np.ndarray] = []
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                prints, parts = print_[low:high].view(np.uint64), part_[low:high]
                left, right = np.flatnonzero(left_[low:high]), np.flatnonzero(right_[low:high])
                a, b = np.nonzero(np.bitwise_count(prints[left][:, None] ^ prints[right][None, :]) <= spec.distance)
                a, b = left[a], right[b]
                a, b = a[parts[a] != parts[b]], b[parts[a] != parts[b]]
                keep = _forest(np.stack([parts[a], parts[b]], axis=1))
                found.append(np.stack([print_[low:high][a[keep]], print_[low:high][b[keep]]], axis=1))
            links = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k]), pa.int64()) for k in range(2)], ["a", "b"])

    return run


def _near(a, b, distance: int):
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _links(prints: DataFrame, spec: SimHash) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all that any chain of links joins.

    Every fingerprint is first compared with the least under each of its keys. Where that leaves several
    components under a key, the fingerprints outside the least one's component are compared with all others
    under the key, in steps of chunk by chunk; a step returns no more links than join its components, so a
    group of near copies costs neither a row a pair nor one large task.
    """
    masks = spec.masks(prints.count())
    keyed = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("band", "key"))
    shared = written(keyed.groupBy("band", "key").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    wide = written(keyed.join(shared.where("n > 2").select("band", "key", "low"), ["band", "key"]))
    hub = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(
        wide.where("print != low").select(F.col("low").alias("a"), F.col("print").alias("b")))
    first = written(hub.where(_near(F.col("a"), F.col("b"), spec.distance)).distinct())
    labels = components(first)

    part = wide.join(labels, wide["print"] == labels["node"], "left").select(
        "band", "key", "print", "low", F.coalesce("component", "print").alias("part"))
    ahead = F.max(F.when(F.col("print") == F.col("low"), F.col("part")))
    size = part.groupBy("band", "key", "part").agg(F.count(F.lit(1)).alias("n"), ahead.alias("ahead"))
    open_ = size.groupBy("band", "key").agg(
        F.max("ahead").alias("main"), F.sum("n").alias("n"), F.sum(F.when(F.col("ahead").isNotNull(), F.col("n"))).alias("mains")).where(
        "n > mains").select("band", "key", "main", *[F.ceil(n / spec.chunk).cast("int").alias(c) for c, n in (
            ("others", F.col("n") - F.col("mains")), ("mains", F.col("mains")))])
    rows = part.join(open_, ["band", "key"]).withColumn("other", F.col("part") != F.col("main"))
    own = F.pmod(F.xxhash64("print"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))).cast("int")

    def step(kind: str, i, j, left, right):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    mine, yes, no = F.col("own"), F.lit(True), F.lit(False)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    steps = F.when(F.col("other"), F.concat(
        F.transform(every("mains"), lambda j: step("main", mine, j, yes, no)),
        F.transform(every("others"), lambda j: step("other", F.least(mine, j), F.greatest(mine, j), mine <= j, mine >= j)))).otherwise(
        F.transform(every("others"), lambda i: step("main", i, mine, no, yes)))
    groups = rows.withColumn("own", own).select("band", "key", "print", "part", F.explode(steps).alias("s")).groupBy(
        "band", "key", "s.kind", "s.i", "s.j").agg(F.collect_list(F.struct("s.left", "s.right", "print", "part")).alias("rows"))
    more = written(groups.select("rows").mapInArrow(_compared(spec), "a long, b long").distinct())
    return first.unionByName(more)


def simhash_duplicates(docs: DataFrame, spec: SimHash = SimHash()) -> DataFrame:
    """doc_id, print (the fingerprint as a long), component_id for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least id reachable over links. Equal fingerprints meet in one row before anything is
    compared. Labels of fingerprints that hold over a thousandth of all rows, at most a thousand, are broadcast;
    so the copies of one text are not gathered under one key.
    """
    docs = extra_columns_dropped(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.mapInArrow(_fingerprints(spec), f"doc_id {kind}, print long"))
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = components(_links(prints.select("print"), spec))
    named = prints.join(labels, prints["print"] == labels["node"], "left").select("print", "first", "n", F.coalesce("component", "print").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "part").select("print", "n", "component_id"))
    total = rows.count()
    hot = named.where(F.col("n") * _HOT_SHARE > total).select("print", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), "print", "left")
    cold = marked.where("hot is null").join(named.select("print", "component_id"), "print")
    return marked.where("hot").select("doc_id", "print", F.col("hot_id").alias("component_id")).unionByName(
        cold.select("doc_id", "print", "component_id"))
