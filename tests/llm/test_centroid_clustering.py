"""Clusters against a plain k-means in whole numbers, and the filter against every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from dataward.llm.centroid_clustering import Clustering, Rotation, centroid_clusters, nearest

SF = "/root/testdata/sf0.001"


def plain(rows, k=40, rounds=5, dims=64):
    """(vec_id, vector) rows in the order that they come -> rows of the result."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        mine = assign()
        for n in range(len(centroids)):
            held = [v for (_, v), (_, c) in zip(kept, mine) if c == n]
            if held:
                centroids[n] = [sum(x) // len(held) for x in zip(*held)]
    mine = assign()
    total = {n: sum(d for d, c in mine if c == n) for n in range(len(centroids))}
    return sorted(((i is None, i, c, d, total[c], sum(total.values()), tuple(centroids[c])) for (i, _), (d, c) in zip(kept, mine)), key=repr)


def result(df, **spec):
    return sorted(((r["vec_id"] is None, r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"]))
                   for r in centroid_clusters(df, Clustering(**spec)).collect()), key=repr)


def test_embeddings_equal_the_plain_form(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert result(df) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_odd_rows(spark):
    """Nulls, wrong lengths, infinities, repeated ids and rows, a null id, vectors that tie, clashing columns."""
    rnd = random.Random(4)
    some = [[rnd.choice([-0.5, -0.001, 0.0, 0.25]) for _ in range(4)] for _ in range(30)]
    rows = [(k % 23, v) for k, v in enumerate(some)] + [(1, some[0]), (1, some[0]), (None, some[3]), (50, None), (51, [0.1] * 3), (52, [0.1] * 5), (53, []),
                                                        (54, [0.1, None, 0.1, 0.1]), (55, [float("nan")] * 4), (56, [0.1, float("-inf"), 0.0, 0.0]), (57, [3.0e3, -3.0e3, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, centroid string, distance double")
    assert result(df, k=5, dims=4, leading=2) == plain(rows, k=5, dims=4)
    assert result(df, k=100, dims=4, leading=4) == plain(rows, k=100, dims=4)
    assert result(df.where("vec_id > 1000"), dims=4) == []
    doubles = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert result(doubles, k=5, dims=4, rounds=0) == plain(rows, k=5, dims=4, rounds=0)


def test_components_too_large_for_a_long_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        centroid_clusters(df, Clustering(dims=4)).collect()


@pytest.mark.parametrize("spread", [3, 100, 1 << 26])
def test_filter_rules_out_no_nearest_centroid(spread):
    rng = np.random.default_rng(spread)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = rng.integers(-spread, spread, (500, 64)) * np.where(np.arange(64) < 8, 1, 1 / 16)
    x = np.floor(x).astype(np.int64)
    centroids = np.concatenate([x[:30], x[:10]])  # ties: the smaller number wins
    rotation = Rotation(x.mean(axis=0), axes, 8)
    lead, rest = rotation(x)
    which, distance, tried = nearest(x, lead, rest, centroids, rotation)
    every = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert tried <= 500 + 500 * 40
