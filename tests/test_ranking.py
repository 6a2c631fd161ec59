import datetime
import random

from pyspark.sql import functions as F

from storyloom.operators import affinity, clusters, similarity
from storyloom.operators.diversity import greedy_order

START = datetime.datetime(2026, 7, 1)


def items_table(spark):
    return spark.createDataFrame([(1, 3, "Jane Chen", ["nba"]), (2, 3, None, ["tech", "ai"])], "id bigint, source_id bigint, author string, topics array<string>")


def signal_table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, profile_id string, item_id bigint, type string, value double, created_at timestamp")


def weights(df):
    return {(r.profile_id, r.dimension, r["key"]): r.weight for r in df.collect()}


def test_affinity_goldens(spark):
    rows = signal_table(spark, [
        (1, "a", 1, "save", 1.0, START), (2, "b", 1, "save", 1.0, START), (3, "b", 1, "read_time", 90.0, START),
        (4, "c", 1, "hide_source", 1.0, START), (5, "d", 2, "read_time", 900.0, START),
    ])
    w = weights(affinity.fold_affinities(rows, items_table(spark)))
    assert w[("a", "topic", "nba")] == 3 and w[("a", "source", "3")] == 1.5 and w[("a", "author", "jane chen")] == 1.5
    assert w[("b", "topic", "nba")] == 4.5 and w[("b", "source", "3")] == 2.25
    assert w[("c", "source", "3")] == -5 and w[("d", "topic", "ai")] == 2 and ("d", "author", "") not in w


def test_affinity_fold_matches_python(spark):
    rng = random.Random(3)
    kinds = ["impression", "open", "save", "unsave", "more_like", "less_like", "hide_source"]
    deltas = {"impression": -0.05, "open": 1, "save": 3, "unsave": -3, "more_like": 3, "less_like": -3, "hide_source": -5}
    rows = [(i, rng.choice("ab"), 1, rng.choice(kinds), 1.0, START + datetime.timedelta(hours=rng.randint(0, 900))) for i in range(300)]
    want = {}
    for _, p, _, kind, _, at in sorted(rows, key=lambda r: (r[5], r[0])):
        w, t = want.get(p, (0.0, at))
        gone = (at - t).total_seconds() / 86400
        want[p] = (max(-10, min(10, w * 2 ** (-gone / 14) + deltas[kind])), at)
    for bound in (10_000, 20):
        got = weights(affinity.fold_affinities(signal_table(spark, rows), items_table(spark), heavy_profile=bound))
        for p, (w, _) in want.items():
            assert abs(got[(p, "topic", "nba")] - w) < 1e-9


def slow_order(costs, topics, sources, explore, limit, tp, sp, every):
    left, out, prev = list(range(len(costs))), [], None
    while left and len(out) < limit:
        pick, odd = None, False
        if (len(out) + 1) % every == 0:
            pick = next((e for e in left if explore[e]), None)
            odd = pick is not None
        if pick is None:
            def value(e):
                s = -costs[e]
                if prev is not None:
                    s -= tp if topics[e] is not None and topics[e] == topics[prev] else 0
                    s -= sp if sources[e] == sources[prev] else 0
                return s
            pick = max(left, key=lambda e: (value(e), -e))
        left.remove(pick)
        out.append(-(pick + 1) if odd else pick + 1)
        prev = pick
    return out


def test_greedy_order_matches_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(0, 40)
        costs = sorted(-rng.choice([0.5, 0.75, 1.0, rng.random()]) for _ in range(n))
        topics = [rng.choice(["a", "b", None]) for _ in range(n)]
        sources = [rng.randint(1, 3) for _ in range(n)]
        explore = [rng.random() < 0.2 for _ in range(n)]
        args = (costs, topics, sources, explore, rng.randint(1, 30), 0.35, 0.25, 10)
        assert greedy_order(*args) == slow_order(*args)


def similarity_of(a, b):
    if a["url"] and a["url"] == b["url"]:
        return 1
    return len(a["tok"] & b["tok"]) / len(a["tok"] | b["tok"]) if a["tok"] and b["tok"] else 0


def best_of(item, items):
    best, bar = None, 0.5
    for other in items:
        if other["id"] != item["id"] and other["source"] != item["source"] and similarity_of(item, other) >= bar:
            best, bar = other, similarity_of(item, other)
    return best


def test_matches_and_clusters_match_sequential_loop(spark):
    rng = random.Random(8)
    words = [f"word{i:02d}" for i in range(15)]
    items = []
    for i in range(1, 61):
        tok = set(rng.sample(words, rng.choice([0, 1, 2, 3, 4, 5, 13, 14])))
        items.append({"id": i, "source": rng.randint(1, 4), "tok": tok, "url": rng.choice(["u1", "u2"] + [f"x{i}"] * 8), "cluster": rng.choice([None] * 8 + [7, 8])})
    df = spark.createDataFrame([(i["id"], i["source"], " ".join(sorted(i["tok"])), i["url"], i["cluster"]) for i in items],
                               "id bigint, source_id bigint, title string, canonical_url string, cluster_id bigint")
    want = {i["id"]: best_of(i, items)["id"] for i in items if best_of(i, items)}
    for bound in (10_000, 3):
        assert {r.id: r.match_id for r in similarity.best_matches(df, bound).collect()} == want
    new = 1000
    for item in items:
        if item["cluster"] is None and best_of(item, items):
            match = best_of(item, items)
            if match["cluster"] is None:
                new += 1
                match["cluster"] = new
            item["cluster"] = match["cluster"]
    groups = {}
    for i in items:
        if i["cluster"] is not None:
            groups.setdefault(i["cluster"], []).append(i["id"])
    expected = {m: (f"old-{c}" if c < 1000 else f"new-{min(ms)}") for c, ms in groups.items() for m in ms}
    assert {r.id: r.group_key for r in clusters.cluster_groups(df).collect()} == expected


def test_verification_rules(spark):
    sources = spark.createDataFrame([(1, "social", "ja"), (2, "major", "reuters"), (3, "social", "jb"), (4, "major", "reuters"), (5, "major", "ap")],
                                    "id bigint, credibility_tier string, source_family string")
    rows = [(1, 1, None), (2, 1, 10), (3, 2, 10), (4, 1, 11), (5, 3, 11), (6, 2, 12), (7, 4, 12), (8, 2, 13), (9, 5, 13)]
    got = {r.id: r.verification_status for r in clusters.verification(spark.createDataFrame(rows, "id bigint, source_id bigint, cluster_id bigint"), sources).collect()}
    assert got == {1: "unconfirmed", 2: "corroborated", 3: "corroborated", 4: "unconfirmed", 5: "unconfirmed", 6: "reported", 7: "reported", 8: "corroborated", 9: "corroborated"}
