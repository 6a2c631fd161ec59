"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are scaled to integers, sorted along a Hilbert curve and packed into blocks that carry the least and the
greatest value of each component (the block's box). A round bounds the distance between every box and every
centroid from both sides; only centroids whose lower bound does not exceed the smallest upper bound can be
nearest to a vector of the block, and those are compared with its vectors exactly. All arithmetic that decides
is on integers, so results do not depend on how the rows are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

COMPONENTS, SCALE = 64, 64
CENTROIDS, ROUNDS = 16, 3
#: Vectors of a block: 16 KB of integers at 64 components.
BLOCK = 64
#: Bits of each component on the curve.
CURVE_BITS = 3
#: Integers of this size or more are left out: their squared distances would not fit a long.
TOO_LARGE = 1 << 27
#: Vectors that a task compares at once.
_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """The place of each row of ``cells`` (integers of ``bits`` bits) on a Hilbert curve, as rows of big-endian bytes.

    The axes are turned into the curve's transposed index by undoing excess work from the highest bit down, then
    Gray encoded; the index takes one bit of every axis in turn.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    dims = len(x)
    levels = [np.uint32(1 << b) for b in range(bits - 1, 0, -1)]
    for level in levels:
        below = level - np.uint32(1)
        for axis in range(dims):
            high = (x[axis] & level) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(high, below, swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in levels:
        turn ^= np.where((x[-1] & level) != 0, level - np.uint32(1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(b) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes), axis=0).T


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _measure(dims: int, scale: float):
    """Number, sum and sum of squares of a task's components."""

    def run(batches):
        n, total, squares = 0, 0.0, 0.0
        for batch in batches:
            x = np.floor(scale * _matrix(batch.column(0), dims))
            n, total, squares = n + x.size, total + float(x.sum()), squares + float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([squares])], names=["n", "total", "squares"])

    return run


def _on_curve(dims: int, scale: float, middle: float, spread: float, bits: int):
    """Integers as bytes, the key on the curve, and a salt that spreads equal keys over partitions."""

    def run(batches):
        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = np.floor(scale * _matrix(part.column(1), dims)).astype(np.int32)
                cells = np.clip(np.floor((x - middle) / spread * (1 << bits - 2)) + (1 << bits - 1), 0, (1 << bits) - 1)
                keys = [k.tobytes() for k in hilbert_keys(cells.astype(np.uint32), bits)]
                salt = (np.arange(seen, seen + len(x)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                seen += len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(keys, pa.binary()), pa.array(salt)], names=["id", "numbers", "place", "salt"]
                )

    return run


def _packed(dims: int, block: int):
    """One row for up to ``block`` vectors that follow each other on the curve: ids, box and numbers."""

    def run(batches):
        ids, numbers = [], []

        def out():
            x = np.frombuffer(b"".join(numbers), np.int32).reshape(-1, dims)
            edges = np.arange(0, len(x), block)
            sizes = np.append(edges, len(x)).astype(np.int32)
            flat = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dims), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(ids, pa.int64())), flat(np.minimum.reduceat(x, edges)), flat(np.maximum.reduceat(x, edges)),
                    pa.array([x[a : a + block].tobytes() for a in edges.tolist()], pa.binary()),
                ],
                names=["ids", "low", "high", "numbers"],
            )

        for batch in batches:
            ids += batch.column(0).to_pylist()
            numbers += batch.column(1).to_pylist()
            if len(ids) >= _ROWS:
                whole = len(ids) // block * block
                rest = ids[whole:], numbers[whole:]
                del ids[whole:], numbers[whole:]
                yield from out()
                ids, numbers = rest
        if ids:
            yield from out()

    return run


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box and centroid, whether the centroid can be nearest (ties included) to a point of the box."""
    under, over = low[:, None, :] - centroids[None], centroids[None] - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(2)
    return least <= most.min(1, keepdims=True)


def nearest(x: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector; the smaller number wins a tie."""
    can = np.repeat(candidates(low, high, centroids), sizes, axis=0)
    best, distance = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        rows = np.flatnonzero(can[:, c])
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        closer = d < distance[rows]
        best[rows[closer]], distance[rows[closer]] = c, d[closer]
    return best, distance


def _assigned(batches, centroids: np.ndarray):
    """Ids, vectors, nearest centroids and distances of some blocks at a time."""
    dims = centroids.shape[1]
    square = lambda lists: lists.flatten().to_numpy().astype(np.int64).reshape(-1, dims)
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS // BLOCK):
            part = batch.slice(at, _ROWS // BLOCK)
            sizes = pc.list_value_length(part.column(0)).to_numpy()
            x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
            yield part.column(0).flatten(), x, *nearest(x, sizes, square(part.column(1)), square(part.column(2)), centroids)


def _sums(sent):
    """Number of vectors and their sum for every centroid that a task assigns."""

    def run(batches):
        centroids = sent.value
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, best, _ in _assigned(batches, centroids):
            n += np.bincount(best, minlength=len(centroids))
            np.add.at(total, best, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _rows(sent):
    def run(batches):
        for ids, _, best, distance in _assigned(batches, sent.value):
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def packed_blocks(rows: DataFrame, dims: int = COMPONENTS, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """``ids``, box (``low``, ``high``) and ``numbers`` of blocks of the rows ``(id, vector)`` in the order of the curve.

    The curve's grid covers two standard deviations around the mean of all components; what lies beyond is in
    the outer cells. Rows with one key are spread by the salt.
    """
    seen = rows.select("vector").mapInArrow(_measure(dims, scale), "n bigint, total double, squares double").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s")).first()
    middle = seen.t / seen.n if seen.n else 0.0
    spread = (max(seen.s / seen.n - middle**2, 0.0) ** 0.5 if seen.n else 0.0) or 1.0
    placed = rows.mapInArrow(_on_curve(dims, scale, middle, spread, CURVE_BITS), "id bigint, numbers binary, place binary, salt bigint")
    return placed.orderBy("place", "salt").select("id", "numbers").mapInArrow(_packed(dims, block), "ids array<bigint>, low array<int>, high array<int>, numbers binary")


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", n_centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = COMPONENTS, scale: float = SCALE, seed: str = "1"
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia`` and ``inertia`` of every vector, and the final centroids.

    Vectors of exactly ``dims`` finite components, taken as ``floor(scale * x)``, are clustered; others have no
    row (so too one whose integers reach ``TOO_LARGE``). The centroids start as the vectors whose ``seed:vec_id``
    has the smallest SHA-256 and move ``rounds`` times to the floored means of their vectors; a centroid without
    vectors stays. Ties go to the smaller number. Fewer vectors than centroids mean as many centroids; none give
    no rows and no centroids. A null id hashes like an empty one. Repeated rows count and return each; equal start
    vectors are two centroids of which the first takes all. An inertia beyond a long is null.
    """
    whole = F.expr(f"size(__v) = {dims} and forall(__v, x -> x is not null and not isnan(x) and abs(floor(x * {scale}D)) < {TOO_LARGE})")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("__v")).where(F.col("__v").isNotNull() & whole).select("id", F.col("__v").alias("vector"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(digest, "id", "vector").limit(n_centroids).select("vector").collect()
    centroids = np.array([np.floor(scale * np.array(r.vector)) for r in first], np.int64).reshape(-1, dims)
    spark = vectors.sparkSession
    blocks = materialize(packed_blocks(rows, dims, scale), "blocks")
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)
        parts = blocks.mapInArrow(_sums(sent), "cluster int, n bigint, total array<bigint>")
        # As many rows as there are centroids.
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims)]).collect()
        centroids = centroids.copy()
        for r in sums:
            centroids[r.cluster] = [r[f"t{i}"] // r.n for i in range(dims)]
    if not len(centroids):
        none = rows.where("false").selectExpr("id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia")
        return none.withColumnRenamed("id", vec_id), []
    assigned = materialize(blocks.mapInArrow(_rows(spark.sparkContext.broadcast(centroids)), "id bigint, cluster int, distance bigint"), "assigned")
    exact = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    long = lambda n: n if n < 1 << 63 else None
    total = long(sum(int(r.d) for r in exact))
    inertia = spark.createDataFrame([(r.cluster, long(int(r.d)), total) for r in exact], "cluster int, cluster_inertia bigint, inertia bigint")
    found = assigned.join(F.broadcast(inertia), "cluster")
    return found.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia"), centroids.tolist()


def centroid_digest(centroid: list[int]) -> str:
    """SHA-256 of the components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
