"""Integer k-means whose nearest centroids are found through a PCA-rotated filter.

Vectors become integers. A rotation onto the principal axes is fitted on all of them; each vector keeps its
leading rotated coordinates and the norm of the rest. The squared distance of two vectors is at least that of
their leading coordinates plus the squared difference of the two norms, so most centroids are ruled out by a
short matrix product; the survivors are compared in integers, and sums and distances are exact.

Defined cases: rows whose vector is null, of another length, or holds a null or non-finite component are left
out; a null ``vec_id`` is hashed as the empty string; rows of equal hash are ordered by their vectors; repeated
rows all count and all come back; with fewer kept rows than centroids there are as many centroids as rows; an
empty table gives an empty result; further columns are ignored. A component beyond 2^27 after scaling raises an
error, as its distances need not fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.llm import arrays
from dataward.llm.shared import extra_columns_dropped, written

#: Rows handled at a time, so that rows x centroids stays small.
_ROWS = 2048
_LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids, ``rounds`` of assigning and moving them, ``leading`` stored coordinates."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    seed: int = 2
    leading: int = 16


def integers(embedding: Column, spec: Clustering) -> Column:
    """The vector in integers; null for rows that are left out."""
    whole = F.coalesce((F.size(embedding) == spec.dims) & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    small = F.forall(embedding, lambda x: F.abs(x.cast("double")) * spec.scale < _LARGEST)
    said = F.raise_error(F.lit(f"a component of {spec.scale} * x is beyond {_LARGEST}")).cast("array<int>")
    return F.when(whole & small, F.transform(embedding, lambda x: F.floor(x.cast("double") * spec.scale).cast("int"))).when(whole, said)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(dims: int):
    """A map over vectors: one row a task with the count, the sums and the sums of products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(dims + dims * dims)
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            count += len(x)
            total += np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), arrays.list_array(total, [len(total)])], ["n", "sums"])

    return run


class Rotation:
    """Principal axes: leading coordinates and the norm of the rest."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int):
        self.mean, self.axes, self.leading = mean, axes, leading

    @classmethod
    def fitted(cls, vectors: DataFrame, spec: Clustering) -> Rotation:
        """From the moments of all rows of ``vectors`` (v), which are added up before they reach the driver."""
        d = spec.dims
        parts = vectors.select("v").mapInArrow(_moments(d), "n long, sums array<double>")
        sums = parts.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        total = np.zeros(d + d * d)
        for r in sums:
            total[r["at"]] = r["x"]
        n = sums[0]["n"] if sums else 1
        mean = total[:d] / n
        _, axes = np.linalg.eigh(total[d:].reshape(d, d) / n - np.outer(mean, mean))
        return cls(mean, np.ascontiguousarray(axes[:, ::-1]), spec.leading)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x - self.mean) @ self.axes
        return y[:, :self.leading], np.sqrt((y[:, self.leading:] ** 2).sum(axis=1))


def _rotated(rotation, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.value(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), arrays.list_array(lead.ravel(), np.full(len(lead), lead.shape[1])), pa.array(rest)],
                ["vec_id", "v", "lead", "rest"])

    return run


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, the smaller number on ties; how many distances were taken."""
    to, to_rest = rotation(centroids)
    far, near = (to ** 2).sum(axis=1) + to_rest ** 2, (lead ** 2).sum(axis=1) + rest ** 2
    bound = ((lead ** 2).sum(axis=1)[:, None] + (to ** 2).sum(axis=1)[None, :] - 2 * lead @ to.T) + (rest[:, None] - to_rest[None, :]) ** 2
    bound -= 1e-9 * (near[:, None] + far[None, :] + 1)  # far more than rounding can add
    every = np.arange(len(x))
    guess = bound.argmin(axis=1)

    def exact(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((x[rows].astype(np.int64) - centroids[which]) ** 2).sum(axis=1)

    first = exact(every, guess)
    # An integer distance that the bound allows to be equal has to be taken too: the smaller number wins.
    row, which = np.nonzero(bound <= first[:, None])
    distance = exact(row, which)
    order = np.lexsort((which, distance, row))
    row, which, distance = row[order], which[order], distance[order]
    at = np.searchsorted(row, every)
    return which[at], distance[at], len(row) + len(x)


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], spec: Clustering):
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            part = batch.slice(low, _ROWS)
            v, lead, rest = (part.column(c) for c in columns)
            yield part, _matrix(v, spec.dims), _matrix(lead, min(spec.leading, spec.dims)), rest.to_numpy()


def _sums(shared, spec: Clustering):
    """A map over (v, lead, rest): one row a task and centroid with count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centroids = shared.value
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, lead, rest in _blocks(batches, (0, 1, 2), spec):
            which, _, _ = nearest(x, lead, rest, centroids, rotation)
            count += np.bincount(which, minlength=len(centroids))
            np.add.at(total, which, x.astype(np.int64))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), arrays.list_array(total[some].ravel(), np.full(len(some), spec.dims))], ["cluster", "n", "sums"])

    return run


def _assigned(shared, spec: Clustering):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centroids = shared.value
        for part, x, lead, rest in _blocks(batches, (1, 2, 3), spec):
            which, distance, tried = nearest(x, lead, rest, centroids, rotation)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(vectors: DataFrame, spec: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array) for each kept row of ``vectors``.

    ``vectors`` has ``vec_id`` and ``embedding``. Integers and rotated coordinates are written once; a round
    reads them, and sends a count and sums for each task and centroid. Only centroids reach the driver.
    """
    session = vectors.sparkSession
    rows = extra_columns_dropped(vectors, "vec_id", "embedding")
    kind = rows.schema["vec_id"].dataType.simpleString()
    kept = rows.select("vec_id", integers(F.col("embedding"), spec).alias("v")).where("v is not null")
    rotation = session.sparkContext.broadcast(Rotation.fitted(kept, spec))
    table = written(kept.mapInArrow(_rotated(rotation, spec.dims), f"vec_id {kind}, v array<int>, lead array<double>, rest double"))

    rank = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = table.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(spec.k).collect()
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(-1, spec.dims)
    for _ in range(spec.rounds if len(centroids) else 0):
        shared = session.sparkContext.broadcast((rotation.value, centroids))
        moved = table.select("v", "lead", "rest").mapInArrow(_sums(shared, spec), "cluster int, n long, sums array<long>").groupBy("cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(spec.dims)]).alias("sums")).collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]

    shared = session.sparkContext.broadcast((rotation.value, centroids))
    out = written(table.mapInArrow(_assigned(shared, spec), f"vec_id {kind}, cluster int, distance long"))
    inertia = {r["cluster"]: r["x"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    facts = session.createDataFrame(
        [(c, x, sum(inertia.values()), centroids[c].tolist()) for c, x in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
