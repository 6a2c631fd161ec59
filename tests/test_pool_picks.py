"""Picks of whole pools for many readers at once, against each reader and world on its own."""

import random

import numpy as np

from storyloom.operators import diversity
from storyloom.operators.diversity import greedy_order


def one(reader, facts, places, limit):
    """(place, explored, score, covered places) of one reader's world, entry by entry."""
    ranked = sorted((p for p in places if not reader[p][2]), key=lambda p: (-reader[p][0], p))
    best, behind, kept = {}, {}, []
    for p in ranked:
        cluster = facts[p][2]
        if cluster >= 0 and cluster in best:
            behind[best[cluster]].append(p)
            continue
        best[cluster], behind[p] = p, []
        kept.append(p)
    topics = [facts[p][0] if facts[p][0] >= 0 else None for p in kept]
    order = greedy_order([-reader[p][0] for p in kept], topics, [facts[p][1] for p in kept], [reader[p][1] for p in kept], limit, 0.35, 0.25, 10)
    return [{"at": kept[abs(o) - 1], "exploration": o < 0, "score": reader[kept[abs(o) - 1]][0], "covered": behind[kept[abs(o) - 1]]} for o in order]


def test_picks_of_many_readers():
    rng = random.Random(9)
    covered = explored = 0
    for n, limit in ((0, 28), (1, 28), (60, 28), (150, 28), (150, 11), (120, 80)):
        facts = [(rng.randint(-1, 4), rng.randint(0, 5), rng.choice([-1, -1, rng.randint(0, 12)])) for _ in range(n)]
        worlds = [sorted(rng.sample(range(n), k)) for k in (n, n // 2, min(n, 3), 0)]
        few = rng.choice([0.02, 0.2])
        readers = [[(rng.choice([0.5, 1.0, rng.random() * 4]), rng.random() < few, rng.random() < 0.2) for _ in range(n)] for _ in range(40)]
        readers[0] = [(s, x, True) for s, x, _ in readers[0]]  # everything muted
        arrays = [np.array([[e[k] for e in r] for r in readers], dtype=t).reshape(40, n) for k, t in enumerate((float, bool, bool))]
        numbers = [np.array([f[k] for f in facts], dtype=np.int64) for k in range(3)]
        got = diversity.pool_picks(*arrays, *numbers, [np.array(w, dtype=np.int64) for w in worlds], limit, 0.35, 0.25, 10).to_pylist()
        assert got == [[one(r, facts, w, limit) for w in worlds] for r in readers]
        covered += sum(len(p["covered"]) for r in got for w in r for p in w)
        explored += sum(p["exploration"] for r in got for w in r for p in w)
    assert covered > 100 and explored > 100


def test_a_reader_stays_one_row_until_its_worlds_are_complete(spark):
    """No row per reader and story, no join and no grouping between the stored readers and their worlds."""
    from storyloom import demo
    from storyloom.checks.readers import tables
    from storyloom.plans import feeds

    stored = []
    feeds.worlds_job(tables(spark, "/root/testdata/sf0.001"), demo.now(), cut=lambda df: stored.append(df) or df)
    plan = stored[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate [profile_id" not in plan and "Generate inline(pool" not in plan
    assert stored[0].count() == 6 * stored[0].select("profile_id").distinct().count() > 0
