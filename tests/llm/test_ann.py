import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=10):
    """All neighbours of every query by brute force, ties by id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(x))
            out[q] = near[:k]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    want = plain(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    got = answers(ann.nearest(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), F.col("vec_id") % 100 == 0))
    assert got.keys() == want.keys()
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in near}) / len(near) for q, near in want.items()])
    assert recall >= 0.9, recall
    for near in got.values():
        assert near == sorted(near) and len(near) == 10


def test_all_probes_equal_brute_force(spark, monkeypatch):
    """Copies, ties, bad vectors, several lengths, small blocks: with all probes the result is exact for close vectors."""
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=6).round(1).tolist()) for i in range(0, 260)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, rows[0][1]), (2000, rows[0][1])]
    rows += [(300, None), (400, []), (500, [0.0] * 6), (600, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(900, [1.0, 2.0]), (901, [1.0, 2.5])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "rank": F.lit(2), "ids": F.lit(3)})
    got = answers(ann.nearest(frame, F.col("vec_id") % 100 == 0, hashes=1, width=8.0, probes=3))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = plain(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])


def test_outliers_and_small_tables_with_default_parameters(spark, monkeypatch):
    """Vectors far from the mass, and lengths with few vectors, get all that there is; several blocks of exact queries."""
    monkeypatch.setattr(ann, "EXACT_NUMBERS", 2000)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1004, 64))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    x[1000:] *= 10
    rows = [(i + 1 if i < 1000 else 100 * i, v.tolist()) for i, v in enumerate(x) if (i + 1) % 100]
    rows += [(100 * (1000 * dim + i), rng.normal(size=dim).tolist()) for dim, n in ((60, 2), (61, 3), (62, 5), (63, 11), (65, 20)) for i in range(n)]
    rows += [(6000000, rng.normal(size=60).tolist()), (7000000, rng.normal(size=59).tolist())]  # an id with two vectors, a length with one
    got = answers(ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0))
    want = plain([(i, np.float32(v).astype(float).tolist()) for i, v in rows])
    # Each of the two vectors of the repeated id has the same two others; the length with one vector has none.
    twice = got.pop(6000000)
    assert [i for _, i in twice] == [6000100, 6000100]
    del want[6000000], want[7000000]
    assert {q: len(near) for q, near in got.items()} == {q: len(near) for q, near in want.items()}
    for q, near in want.items():
        if 100000 <= q < 6500000:
            assert [i for _, i in got[q]] == [i for _, i in near]
            assert np.allclose([s for s, _ in got[q]], [s for s, _ in near])


def test_vectors_out_of_the_range_of_squares(spark):
    """Components whose squares overflow, or vanish, keep their distances and order."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 40)]
    rows += [(100, [1e200, 0.0, 0.0, 0.0]), (101, [2e200, 0.0, 0.0, 0.0]), (102, [4e200, 3e200, 0.0, 0.0]), (103, [1e-200, 0.0, 0.0, 0.0]), (104, [5e-200, 3e-200, 0.0, 0.0])]
    rows += [(200, [0.0, 1e-200, 0.0, 0.0])]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0))

    def distance(a, b):
        gap = [x - y for x, y in zip(a, b, strict=True)]
        most = max(map(abs, gap)) or 1.0
        return most * float(np.sqrt(sum((g / most) ** 2 for g in gap)))

    of = dict(rows)
    for q in (100, 200):
        want = sorted((distance(of[q], v), i) for i, v in rows if i != q)[:10]
        assert [i for _, i in got[q]] == [i for _, i in want]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want], rtol=1e-12, atol=0)


def test_spread_of_rare_lengths_is_measured(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rows = [(i, [float(i), 1.0]) for i in range(400)] + [(1000, [0.0, 0.0, 100.0]), (1001, [0.0, 300.0, 100.0])]
    spread = ann._spread(spark.createDataFrame(rows, "id long, vector array<double>"))
    assert abs(spread[3] - 150) < 1e-9 and spread[2] > 50


def test_visits_come_in_order_of_estimated_success():
    hasher = ann.Hasher({4: 1.0}, 2, 3, 27, 2.0)
    x = np.random.default_rng(1).normal(size=(5, 4))
    visits = hasher.visits(x)
    assert visits.shape == (5, 54)
    assert (visits[:, 0] == hasher.own(x)[:, 0]).all() and (visits[:, 27] == hasher.own(x)[:, 1]).all()


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
    assert ann.nearest(spark.createDataFrame([(100, [1.0, 2.0])], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
