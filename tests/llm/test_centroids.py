"""Clustering against a plain version; the curve and the bounds on their own."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from storyloom.llm import centroids as C
from storyloom.llm import queries

SF = "/root/testdata/sf0.01"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    """(id, cluster, distance, cluster inertia, inertia) by comparing all vectors with all centroids, in Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for c in range(len(means)):
            mine = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == c]
            if mine:
                means[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    total = sum(d for d, _ in near)
    return sorted(((i, c, d, sum(e for e, f in near if f == c), total) for (i, _), (d, c) in zip(kept, near, strict=True)), key=str), means


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, means = C.cluster_vectors(df, **how)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    return sorted((tuple(r) for r in found.collect()), key=str), means


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 4), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint32)
    keys = [k.tobytes() for k in C.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array(keys, object))].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_keep_every_nearest_centroid():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, means = rng.integers(-6, 7, (20, 3)), rng.integers(-12, 13, (9, 3))
        can = C.candidates(x.min(0)[None], x.max(0)[None], means)[0]
        d = ((x[:, None] - means[None]) ** 2).sum(2)
        assert can[np.nonzero(d == d.min(1, keepdims=True))[1]].all()
    near = C.candidates(np.array([[0, 0]]), np.array([[1, 1]]), np.array([[0, 0], [50, 50], [1, 1]]))
    assert near.tolist() == [[True, False, True]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 3) for _ in range(4)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(700)]
    rows += [(1000 + i, [0.5, -0.25, 0.0, 1.0]) for i in range(400)]
    assert run(spark, rows, dims=4, n_centroids=6) == plain(rows, 6, dims=4)


def test_odd_vectors(spark):
    flat = [0.0] * 64
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [None] + flat[1:]), (5, [math.nan] + flat[1:]), (6, [math.inf] + flat[1:]), (7, flat), (7, flat), (8, flat)]
    rows += [(None, [0.5] * 64), (9, [-0.001] * 64), (10, [0.5] * 64), (7, [1.0] * 64)]
    got = run(spark, rows)
    assert got == plain(rows) and len(got[0]) == 7
    # Beyond what a long distance holds.
    assert len(run(spark, [*rows, (11, [1e30] + flat[1:])])[0]) == 7


def test_empty_tables(spark):
    assert run(spark, []) == ([], []) and run(spark, [(1, None)]) == ([], [])


def test_extra_columns_and_registered_query(spark, tmp_path):
    from pyspark.sql import functions as F

    source = spark.read.parquet(f"{SF}/embeddings.parquet")
    source.withColumns({c: F.lit(1) for c in ("id", "vector", "cluster", "distance", "__v", "inertia", "place", "salt")}).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, means = plain([tuple(r) for r in source.select("vec_id", "embedding").collect()])
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    got = queries.op11_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((*r, digests[r[1]]) for r in want), key=str)
    source.where("false").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op11_centroid_clusters(spark, str(tmp_path / "none")).collect() == []
