"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Each of ``TABLES`` tables hashes a vector by ``HASHES`` functions ``floor((a.x + b) / w)`` with normal ``a``; the
width is a multiple of the projections' spread, fitted on a bounded sample. A query visits, per table, its own
bucket and those reached by moving hash values by one, in the order of their estimated success: the sum of the
squared distances to the slot borders that are crossed. Buckets and their visitors are dealt out in blocks, a
block pair gives each visitor its best exact distances, and the tables' candidates are merged by distance.
A query that meets too few others this way (a vector far from the mass, a small table) is compared with all points.
Equal vectors are one point that carries its smallest ids.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

TABLES = 6
HASHES = 6
PROBES = 40
WIDTH = 2.0
#: Vectors (those with the smallest hash of their id) on which the spread is measured.
SAMPLE = 10_000
#: Vectors of a bucket, and visitors of it, that meet in one group on average at most.
BLOCK = 1024
FARTHEST = float(1 << 52)
#: Numbers of the queries that are compared with all points in one pass.
EXACT_NUMBERS = 1 << 18


def usable(column: str) -> Column:
    """Not null, not empty, not all zero, every component a finite number."""
    finite = f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"{column} is not null and size({column}) > 0 and {finite} and exists({column}, x -> x <> 0)")


class Hasher:
    """The hash functions of every table for vectors of any length; ``spread`` by length scales the slots."""

    def __init__(self, spread: dict[int, float], tables: int, hashes: int, probes: int, width: float):
        self.spread, self.tables, self.hashes, self.probes, self.width = spread, tables, hashes, probes, width
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=hashes)), np.int64)

    def slots(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([x.shape[1], table])
        a, b = rng.standard_normal((x.shape[1], self.hashes)), rng.random(self.hashes)
        with np.errstate(over="ignore", invalid="ignore"):
            place = (x / (self.width * self.spread.get(x.shape[1], 1.0))) @ a + b
        # Beyond whole doubles a slot says nothing; such vectors meet at the ends, or in the exact pass.
        place = np.clip(np.nan_to_num(place), -FARTHEST, FARTHEST)
        slot = np.floor(place)
        return slot.astype(np.int64), place - slot

    def keys(self, slots: np.ndarray, dim: int, table: int) -> np.ndarray:
        """One long for a bucket of a table; two buckets with one key only add candidates to each other."""
        key = np.full(slots.shape[:-1], dim * 1009 + table + 1, np.uint64)
        for i in range(self.hashes):
            key = (key ^ slots[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def own(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.keys(self.slots(x, t)[0], x.shape[1], t) for t in range(self.tables)], 1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The keys that each query visits, per table in order of estimated success."""
        out = []
        n = min(self.probes, len(self.moves))
        down, up = (self.moves == -1).astype(float), (self.moves == 1).astype(float)
        for t in range(self.tables):
            slot, inside = self.slots(x, t)
            cost = inside**2 @ down.T + (1 - inside) ** 2 @ up.T
            best = np.argsort(cost, axis=1, kind="stable")[:, :n]
            out.append(self.keys(slot[:, None, :] + self.moves[best], x.shape[1], t))
        return np.concatenate(out, 1)


def _by_dimension(lists: pa.Array):
    """(row numbers, float64 matrix) of the vectors of each length."""
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lens)
    for dim in np.unique(lens).tolist():
        rows = np.nonzero(lens == dim)[0]
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``v``; where squares leave the range of a double, scaled ones."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = x - v
        d = np.sqrt((gap**2).sum(1))
        far = np.nonzero(~((d > 1e-150) & np.isfinite(d)))[0]
        if len(far):
            most = np.abs(gap[far]).max(1)
            scale = np.where((most > 0) & np.isfinite(most), most, 1.0)[:, None]
            d[far] = np.sqrt(((gap[far] / scale) ** 2).sum(1)) * scale[:, 0]
    return d


def _with_buckets(points: DataFrame, hasher: Hasher, visits: bool) -> DataFrame:
    """``id``, ``vector`` and one row for each bucket (of its own, or those it visits)."""
    schema = "id bigint, vector array<double>, buckets array<bigint>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found: list = [None] * part.num_rows
                for rows, x in _by_dimension(part.column(1)):
                    keys = hasher.visits(x) if visits else hasher.own(x)
                    for r, k in zip(rows.tolist(), keys, strict=True):
                        found[r] = k
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "vector", "buckets"])

    return points.select("id", "vector").mapInArrow(run, schema).select("id", "vector", F.explode(F.array_distinct("buckets")).alias("bucket"))


def _best_of_group(k: int):
    def run(indexed: pa.Table, visitors: pa.Table) -> pa.Table:
        queries, ids, marks, scores = [], [], [], []
        if indexed.num_rows and visitors.num_rows:
            index = {x.shape[1]: (rows, x) for rows, x in _by_dimension(indexed.column("vector").combine_chunks())}
            point, mark = indexed.column("id").to_numpy(), indexed.column("mark").to_numpy()
            visitor = visitors.column("id").to_numpy()
            for rows, q in _by_dimension(visitors.column("vector").combine_chunks()):
                if q.shape[1] not in index:
                    continue
                own, x = index[q.shape[1]]
                of, marked = point[own], mark[own]
                for r, v in zip(rows.tolist(), q, strict=True):
                    d = _distances(x, v)
                    best = np.lexsort((marked, of, d))[:k]
                    queries.append(np.full(len(best), visitor[r]))
                    ids.append(of[best])
                    marks.append(marked[best])
                    scores.append(d[best])
        flat = [np.concatenate(c) if c else np.zeros(0, t) for c, t in ((queries, np.int64), (ids, np.int64), (marks, np.int64), (scores, np.float64))]
        return pa.table({"query": pa.array(flat[0], pa.int64()), "id": pa.array(flat[1], pa.int64()), "mark": pa.array(flat[2], pa.int64()), "score": pa.array(flat[3], pa.float64())})

    return run


def _best_of_all(sent, k: int):
    """The ``k`` nearest of a task's points (id, mark, ids, vector) for each broadcast query (query, query_id, vector)."""

    def run(batches):
        block = sent.value
        asked = [(x.shape[1], rows, x) for rows, x in _by_dimension(block.column("vector").combine_chunks())]
        query, query_id = block.column("query").to_numpy(), block.column("query_id").to_numpy()
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * block.num_rows
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                index = {x.shape[1]: (rows, x) for rows, x in _by_dimension(part.column("vector"))}
                point, mark = part.column("id").to_numpy(), part.column("mark").to_numpy()
                single = pc.list_value_length(part.column("ids")).to_numpy() == 1
                for dim, rows, q in asked:
                    if dim not in index:
                        continue
                    own, x = index[dim]
                    of, marked, alone = point[own], mark[own], single[own]
                    for r, v in zip(rows.tolist(), q, strict=True):
                        # A point whose only id is the query's own answers nothing.
                        other = ~(alone & (of == query_id[r]))
                        d = np.append(best[r][0], _distances(x, v)[other])
                        ids = np.append(best[r][1], of[other])
                        marks = np.append(best[r][2], marked[other])
                        near = np.lexsort((marks, ids, d))[:k]
                        best[r] = d[near], ids[near], marks[near]
        sizes = [len(d) for d, _, _ in best]
        columns = [np.repeat(query, sizes), np.repeat(query_id, sizes), *(np.concatenate([b[c] for b in best]) for c in (1, 2, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "id", "mark", "score"])

    return run


def _exact(points: DataFrame, short: DataFrame, k: int) -> DataFrame | None:
    """``query``, ``query_id``, ``id``, ``mark`` and ``score`` of the ``k`` nearest points of each of the ``short`` queries; None without any."""
    size = short.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("numbers")).first()
    out = None
    blocks = -(-(size.numbers or 0) // EXACT_NUMBERS)
    for block in range(blocks):
        asked = short.where(F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)) == block).select("query", "query_id", "vector").toArrow()
        if not asked.num_rows:
            continue
        sent = points.sparkSession.sparkContext.broadcast(asked)
        found = points.select("id", "mark", "ids", "vector").mapInArrow(_best_of_all(sent, k), "query bigint, query_id bigint, id bigint, mark bigint, score double")
        order = Window.partitionBy("query", "query_id").orderBy("score", "id", "mark")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
        found = materialize(found, "exact")  # else every block stays with the driver
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    width: float = WIDTH,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean) of the ``k`` nearest found of every query,
    of all others if there are no more than ``k``.

    ``queries`` is a condition on the id column. Every usable vector is indexed; rows with a null id, or with a
    vector that is null, empty, zero or holds a null or non-finite component take no part. Ties go to the
    smaller id. Repeated rows count once; vectors of different length are never near. An empty table has no
    neighbours. With ``probes`` of 3 ** hashes or more every neighbouring bucket is visited.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null").where(usable("vector"))
    # The k + 1 smallest ids of each vector are all that a query can return, its own id left out.
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    points = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # An id may have several vectors: a point is an id and the mark of its vector, a query the mark of its own.
    mark = F.xxhash64("vector")
    points = materialize(points.select(F.col("ids")[0].alias("id"), mark.alias("mark"), "ids", "vector"), "points")
    asking = materialize(rows.where("asks").select(F.col("id").alias("query_id"), "vector").distinct(), "asking")
    distinct = asking.select("vector").distinct().withColumn("id", mark)
    hasher = Hasher(_spread(points), tables, hashes, probes, width)
    indexed = materialize(_with_buckets(points, hasher, False), "indexed")
    visiting = _with_buckets(distinct, hasher, True)

    # Blocks of a bucket and of its visitors, by counts that are taken first; each block pair is a group.
    here = indexed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    visiting = materialize(visiting.join(here.select("bucket"), "bucket", "left_semi"), "visiting")
    there = visiting.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
    sizes = here.join(there, "bucket")
    part, turn = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.xxhash64("id"), F.col("turns"))
    left = indexed.join(sizes, "bucket").select("bucket", "id", "vector", part.alias("part"), F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"))
    right = visiting.join(sizes, "bucket").select("bucket", "id", "vector", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), turn.alias("turn"))
    keys = [F.col("bucket"), F.col("part").cast("bigint").alias("part"), F.col("turn").cast("bigint").alias("turn")]
    left, right = left.select("id", mark.alias("mark"), "vector", *keys), right.select("id", "vector", *keys)
    found = left.groupBy("bucket", "part", "turn").cogroup(right.groupBy("bucket", "part", "turn")).applyInArrow(_best_of_group(k + 1), "query bigint, id bigint, mark bigint, score double")

    merged = found.groupBy("query", "id", "mark").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "id", "mark")
    merged = merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    answers = merged.join(points.select("id", "mark", "ids"), ["id", "mark"]).select("query", "score", F.explode("ids").alias("vec_id"))
    asked = asking.select(mark.alias("query"), "query_id", "vector")
    answers = answers.join(asked.drop("vector"), "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    answers = materialize(answers.select("query", "query_id", "rank", "vec_id", "score"), "answers")

    # Queries with fewer answers than there are others, k at most, are answered anew from all points.
    there = points.groupBy(F.size("vector").alias("dim")).agg(F.sum(F.size("ids")).alias("n"))
    had = answers.groupBy("query", "query_id").agg(F.count("*").alias("had"))
    short = asked.withColumn("dim", F.size("vector")).join(there, "dim").join(had, ["query", "query_id"], "left")
    short = materialize(short.where(F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("query", "query_id", "vector"), "short")
    exact = _exact(points, short, k)
    if exact is not None:
        exact = exact.join(points.select("id", "mark", "ids"), ["id", "mark"]).select("query", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        exact = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kept = answers.join(short.select("query", "query_id"), ["query", "query_id"], "left_anti")
        answers = kept.unionByName(exact)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _deviation(x: np.ndarray) -> float:
    """Root of the summed variances; by quartiles where some vectors are so long that these are out of range."""
    with np.errstate(over="ignore", invalid="ignore"):
        whole = float(np.sqrt(x.var(0).sum()))
        if not math.isfinite(whole):
            low, high = np.quantile(x, [0.25, 0.75], axis=0)
            whole = float(np.sqrt((((high - low) / 1.349) ** 2).sum()))
    return whole if whole and math.isfinite(whole) else 1.0


def _spread(points: DataFrame) -> dict[int, float]:
    """Standard deviation of a normal projection, by vector length: on the sample, for lengths that are rare in it on all rows."""
    sample = points.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return {}
    parts = list(_by_dimension(sample.column("vector").combine_chunks()))
    if sample.num_rows < SAMPLE:
        return {x.shape[1]: _deviation(x) for _, x in parts}
    spread = {x.shape[1]: _deviation(x) for _, x in parts if len(x) >= SAMPLE // 10}
    rest = points.select(F.size("vector").alias("dim"), "vector").where(~F.col("dim").isin(list(spread)))
    rest = rest.select("dim", F.posexplode("vector").alias("i", "x")).groupBy("dim", "i").agg(F.var_pop("x").alias("v"))
    return spread | {r.dim: (math.sqrt(r.v) or 1.0) if math.isfinite(r.v) else 1.0 for r in rest.groupBy("dim").agg(F.sum("v").alias("v")).collect()}
