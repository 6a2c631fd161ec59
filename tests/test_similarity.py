"""The similarity join against all pairs, with tokens that crowd."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import similarity

SCHEMA = "id bigint, source_id bigint, title string, canonical_url string, cluster_id bigint"


def titles(rng, kind, n):
    """Titles of few words, or long ones around a common one, or around a common phrase."""
    words = [f"w{i:03d}" for i in range(300)]
    if kind == "small":
        return [" ".join(["crowd"] * (rng.random() < 0.9) + rng.sample(words[:40], rng.randint(0, 4))) for _ in range(n)]
    if kind == "long":
        made = [["rare", *rng.sample(words, rng.randint(14, 24))] for _ in range(n)]
        for i in range(0, n, 9):  # near copies
            made[i] = [w for w in made[i - 1] if rng.random() < 0.85] + rng.sample(words, 2)
        return [" ".join(w) for w in made]
    phrase = ["live", "from", "the", "final", "stage"]
    return [" ".join([w for w in phrase if rng.random() < 0.95] + rng.sample(words[:60], rng.randint(0, 9))) for _ in range(n)]


def tokens_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: frozenset(r.t) for r in df.select("id", X.title_tokens(F.col("title")).alias("t")).collect()}


def sim(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("kind", ["small", "long", "phrase"])
@pytest.mark.parametrize("hot", [4, 2000])
def test_equals_all_pairs(spark, kind, hot):
    rng = random.Random(f"{kind}{hot}")
    rows = [(i, rng.randint(0, 3), t, rng.choice(["", f"u{i % 50}", None]), None) for i, t in enumerate(titles(rng, kind, 150))]
    words, source, url = tokens_of(spark, rows), {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for i in words:
        found = [(1.0 if url[i] and url[i] == url[j] else sim(words[i], words[j]), j) for j in words if source[j] != source[i]]
        best = max(found)
        if best[0] >= 0.5:
            want[i] = best
    got = similarity.best_matches(df, hot).collect()
    assert {r.id: (round(r.similarity, 9), r.match_id) for r in got} == {i: (round(s, 9), j) for i, (s, j) in want.items()} and len(want) > 20

    groups = {}
    for i, w in words.items():
        if w:
            groups.setdefault(w, []).append(i)
    want = set()
    for a in groups:
        for b in groups:
            i, j = min(groups[a]), min(groups[b])
            if i < j and sim(a, b) >= 0.5 and len({source[x] for x in groups[a] + groups[b]}) > 1:
                want.add((i, j, round(sim(a, b), 9)))
    got = [(r.a, r.b, round(r.similarity, 9)) for r in similarity.title_pairs(df, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_crowd_of_long_titles(spark):
    """20,000 titles of 15 to 25 words around one word: no key gathers them, and near copies are found."""
    rng = random.Random(1)
    rows = []
    for i in range(20_000):
        words = rng.sample(range(20_000), rng.randint(14, 24))
        rows.append((i, i % 3, "rareword " + " ".join(f"x{w}" for w in words), "", None))
    for i in range(0, 20_000, 400):
        rows.append((20_000 + i, 7, rows[i][2] + " more", "", None))
    df = spark.createDataFrame(rows, SCHEMA)
    # Make the common word the rarest of its titles in the frozen order.
    sets = similarity.story_sets(df).withColumn("ranked", F.array_distinct(F.concat(F.array(F.lit("rareword")), "tokens")))
    pairs, crowds = similarity.similar_pairs(sets, 500)
    assert [level for level, _ in crowds] == [1]
    longest = crowds[0][1].count()
    assert longest == len(rows)
    found = {(min(r.a.set_id, r.b.set_id), max(r.a.set_id, r.b.set_id)) for r in pairs.select("a", "b").collect()}
    assert found == {(i, 20_000 + i) for i in range(0, 20_000, 400)}


def test_ranked_tokens_are_numbers_from_the_rarest(spark):
    df = spark.createDataFrame([(0, 0, "alpha beta gamma", "", None), (1, 1, "beta gamma delta", "", None), (2, 2, "gamma omega", "", None)], SCHEMA)
    sets = similarity.order_by_rarity(similarity.story_sets(df))
    assert sets.schema["ranked"].dataType.simpleString() == "array<bigint>"
    ranked = {r.set_id: r.ranked for r in sets.collect()}
    assert ranked[0][1:] == ranked[1][1:] and ranked[0][2] == ranked[2][1] and all(r == sorted(set(r)) for r in ranked.values())
