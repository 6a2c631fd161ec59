"""The title index against plain search, over several levels; a search opens the lists of its needles only."""

import random

from pyspark.sql import functions as F

from storyloom.operators.search import TitleIndex, search_readers

TITLES = "id bigint, title string, position bigint"


def plain(titles, needles, limit):
    out = set()
    for needle in {n.strip().lower() for n in needles if n and n.strip()}:
        hits = sorted((p, i, t) for i, t, p in titles if t is not None and p is not None and needle in t.lower())[:limit]
        out |= {(needle, k + 1, i, t) for k, (_, i, t) in enumerate(hits)}
    return out


def test_levels_equal_plain_search(spark, tmp_path):
    rng = random.Random(5)
    words = ["the", "Rain", "über", "a", "😀😀", "new york", "x.y", "%_", "", "ß"] + ["w%d" % i for i in range(30)]
    titles = [(i, " ".join(rng.choice(words[: 10 if rng.random() < 0.7 else 40]) for _ in range(rng.randint(0, 6))), rng.randint(0, 90)) for i in range(300)]
    titles += [(900, None, 1), (901, "the lost", None), (902, "the " + "long " * 20_000 + "end", 5), (903, "THE RAIN", -4)]
    needles = [None, "", "  ", " The", "the ", "a", "y", "rain a", "über", "😀", "new york the", "w1", "w29", "zzz", "%", "x.y", "g e", "THE RAIN", "the rainbow is nowhere"]
    needles += [t[1][k : k + 7] for t in titles[:40] if t[1] for k in (0, 3)]
    index = TitleIndex.build(str(tmp_path / "i"), spark.createDataFrame(titles, TITLES), buckets=4, first=8)
    assert len(index.levels()) > 2
    got = index.search(spark.createDataFrame([(n,) for n in needles], "needle string"), 5)
    assert {tuple(r) for r in got.collect()} == plain(titles, needles, 5)


def test_only_lists_of_the_needles_are_opened(spark, tmp_path):
    titles = spark.range(2000).select("id", F.concat(F.lit("the story "), F.col("id"), F.lit(" of "), F.col("id") % 7).alias("title"), F.col("id").alias("position"))
    index = TitleIndex.build(str(tmp_path / "i"), titles, buckets=16, first=64)
    pending = index._rarest(spark.createDataFrame([("story 12",)], "needle string"))
    lists = index.candidates(pending, 1)
    plan = lists._jdf.queryExecution().explainString(lists._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(level" in plan and "/titles" not in plan
    # A frequent needle ends in the first level.
    opened = []
    index.candidates, asked = lambda p, level: opened.append(level) or asked(p, level), index.candidates
    assert [r.id for r in index.search(spark.createDataFrame([("story",)], "needle string"), 8).orderBy("place").collect()] == list(range(8))
    assert opened == [0]


def test_only_hits_leave_the_lists(spark, tmp_path):
    """Many titles hold the runs of a needle; only those with the needle go on to the look-up, once each."""
    titles = [(i, f"{i} quiet rain" if i % 10 else f"{i} QUIET-raid, quiet-raid", i) for i in range(400)] + [(900, "ab", 1)]
    index = TitleIndex.build(str(tmp_path / "i"), spark.createDataFrame(titles, TITLES), buckets=4, first=1000)
    asked = {"quiet-rai": 40, "t-raid, quiet-r": 40, "uiet ra": 360, "10 quiet-": 4, "quiet rai, long past the end": 0, "ab": 1, "q": 400}
    pending = index._rarest(spark.createDataFrame([(n,) for n in asked], "needle string"))
    met = [r.needle for r in index.candidates(pending, 0).collect()]
    assert {n: met.count(n) for n in asked} == {n: k for n, k in asked.items()}


def test_empty(spark, tmp_path):
    index = TitleIndex.build(str(tmp_path / "i"), spark.createDataFrame([], TITLES))
    assert index.search(spark.createDataFrame([("a",)], "needle string")).collect() == []


def test_readers(spark):
    shown = spark.createDataFrame([("p", 1, "The one", 3), ("p", 2, "the two", 1), ("q", 1, "The one", 1), ("q", 3, None, 2)], "profile_id string, id bigint, title string, position bigint")
    asked = spark.createDataFrame([("p", " THE "), ("p", "the"), ("p", "one"), ("q", "two"), ("q", "e"), ("r", "the"), (None, "the"), ("p", None)], "profile_id string, needle string")
    got = {(r.profile_id, r.needle, r.place, r.id) for r in search_readers(shown, asked, 1).collect()}
    assert got == {("p", "the", 1, 2), ("p", "one", 1, 1), ("q", "e", 1, 1)}
