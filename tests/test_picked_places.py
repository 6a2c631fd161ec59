"""The places that whole batches of ranked lists give, against each list on its own."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.operators import diversity, feed


def plain(ranked, limit):
    """Places of a list of (cost, topic, source, explore, cluster) after the collapse, and those of the collapsed ones."""
    seen, kept, again = set(), [], []
    for i, e in enumerate(ranked):
        (again if e[4] is not None and e[4] in seen else kept).append(i)
        seen.add(e[4])
    columns = [[ranked[i][k] for i in kept] for k in range(4)]
    order = diversity.greedy_order(*columns, limit, 0.35, 0.25, 10)
    return [(1 if o > 0 else -1) * (kept[abs(o) - 1] + 1) for o in order], again


def lists(rng, n):
    kinds = [lambda: rng.choice(["a", "b", None]), lambda: rng.randint(1, 3), lambda: rng.random() < 0.1, lambda: rng.choice([None, None, 1, 2, rng.randint(3, 30)])]
    return [[(c, *[k() for k in kinds]) for c in sorted(-rng.choice([0.5, rng.random() * 4]) for _ in range(rng.choice([0, 1, 12, 60])))] for _ in range(n)]


def test_places_of_a_batch():
    rng = random.Random(5)
    rows = lists(rng, 300)
    types = [pa.float64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
    columns = [pa.array([[e[k] for e in r] for r in rows], pa.list_(t)) for k, t in enumerate(types)]
    for part in (slice(0, 300), slice(37, 211)):
        got = diversity.places_in(*[c[part] for c in columns], 28, 0.35, 0.25, 10).to_pylist()
        assert [(g["order"], g["again"]) for g in got] == [plain(r, 28) for r in rows[part]]
    assert any(again for _, again in (plain(r, 28) for r in rows))


def test_lists_are_not_gone_through_entry_by_entry(spark):
    """Neither collapse nor pick calls a lambda for each entry of a list; both agree with the plain loop."""
    rows = lists(random.Random(6), 40)
    data = [(n, [(c, i, s, t, g, x) for i, (c, t, s, x, g) in enumerate(r)]) for n, r in enumerate(rows)]
    worlds = spark.createDataFrame(data, "n int, ranked array<struct<neg:double,id:bigint,source_id:bigint,topic:string,cluster_id:bigint,explore:boolean>>")
    got = feed.picked(worlds, 28)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(ranked" not in plan and "filter(ranked" not in plan
    for r in got.collect():
        order, again = plain(rows[r.n], 28)
        assert [(-1 if p.exploration else 1) * (p.id + 1) for p in r.picks] == order and [e.id for e in r.also] == again
    for r in feed.collapsed(worlds).collect():
        again = plain(rows[r.n], 28)[1]
        assert [e.id for e in r.also] == again and [e.id for e in r.ranked] == [i for i in range(len(rows[r.n])) if i not in again]


def test_a_reader_scores_each_topic_list_once(spark):
    """A story's row looks its terms up by place; no lambda is called for it."""
    from storyloom.checks.readers import scored

    plan = scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate inline")]
    assert "lambda" not in above
