"""Best same-story match per item: exact title similarity join without an all-pairs step.

Copies are folded first. Items with equal title tokens form one *set*; a set is known by at most two
entries, its newest item and its newest item from another source, because any item's best partner inside a
set is one of those two. The similarity join then runs over distinct sets only, and its output is folded the
same way, so neither a group of copies nor a popular partner ever produces a row per pair of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import broadcast_if_small, materialize

#: Sets that share a key before the key is made longer.
HOT_BUCKET = 2_000
#: Tokens of the longest key; sets that crowd even such a key meet in blocks.
MAX_LEVEL = 3


def _entry() -> Column:
    return F.struct("sim", "id", "source_id", "cluster_id")


def _two_best(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key, the best (sim, id) entry and the best one from another source.

    ``rows`` has the keys, sim, id, source_id and cluster_id. The first step combines map-side; the rank
    filter is applied before the second shuffle as well.
    """
    per_source = rows.groupBy(*keys, "source_id").agg(F.max(F.struct("sim", "id", "cluster_id")).alias("best"))
    order = Window.partitionBy(*keys).orderBy(F.desc("best"))
    top = per_source.withColumn("rn", F.row_number().over(order)).filter("rn <= 2")
    entry = F.struct("best.sim", "best.id", "source_id", "best.cluster_id")
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, entry)).alias("e1"), F.max(F.when(F.col("rn") == 2, entry)).alias("e2")
    )


def _other_source(e1: Column, e2: Column, source_id: Column) -> Column:
    return F.when(e1["source_id"] != source_id, e1).otherwise(e2)


def story_sets(items: DataFrame) -> DataFrame:
    """Distinct non-empty token sets: set_id, tokens, n and their two entries."""
    rows = items.select(
        F.sort_array(T.title_tokens(F.col("title"))).alias("tokens"), F.lit(1.0).alias("sim"), "id", "source_id", "cluster_id"
    ).filter(F.size("tokens") > 0)
    return _two_best(rows, "tokens").select(F.col("e1.id").alias("set_id"), "tokens", F.size("tokens").alias("n"), "e1", "e2")


def prefix_of(ranked: Column, level: int = 1) -> Column:
    """The rarest tokens of which two sets with similarity >= 1/2 share their first ``level`` common ones, if they have as many.

    Such sets share at least half of either, so the common token number ``level`` has at most n/2 - level + 1 own
    tokens behind it that are not common.
    """
    return F.slice(ranked, F.lit(1), F.floor(F.size(ranked) / 2).cast("int") + level)


def order_by_rarity(sets: DataFrame) -> DataFrame:
    """Add ``ranked``: the tokens, rarest first, as whole numbers in that order, since rows are copied for every key."""
    words = sets.select("set_id", F.explode("tokens").alias("token"))
    frequency = words.groupBy("token").agg(F.count("*").alias("df"))
    numbered = frequency.repartitionByRange("df", "token").sortWithinPartitions("df", "token")
    # Written once: a number must not depend on how often or where it is worked out.
    codes = materialize(numbered.select("token", F.monotonically_increasing_id().alias("code")), "token-codes")
    # One title's tokens, so the collected list is short.
    ranked = words.join(broadcast_if_small(codes), "token").groupBy("set_id").agg(F.sort_array(F.collect_list("code")).alias("ranked"))
    return sets.join(ranked, "set_id")


def _sim(shared: Column, n: Column, m: Column) -> Column:
    return shared / (n + m - shared)


def _met(pairs: DataFrame, level: int) -> DataFrame:
    """Pairs a, b that met at a key of ``level`` tokens: the similar ones, with ``sim``, each at one key only.

    The place of the key's last token in both sets bounds what they can share; the key must be their first common
    tokens.
    """
    n, m = F.col("a.n"), F.col("b.n")
    room = level + F.least(n - F.col("a.at"), m - F.col("b.at")) - 1
    first = F.slice(F.array_intersect(prefix_of(F.col("a.ranked"), level), prefix_of(F.col("b.ranked"), level)), 1, level)
    shared = F.size(F.array_intersect("a.ranked", "b.ranked"))
    pairs = pairs.filter((2 * F.least(n, m) >= F.greatest(n, m)) & (3 * room >= n + m)).filter(first == F.col("key"))
    pairs = pairs.withColumn("shared", shared).filter(3 * F.col("shared") >= n + m)
    return pairs.select("a", "b", _sim(F.col("shared"), n, m).alias("sim"))


def _wanted(a: Column, b: Column, columns: list[str]) -> Column:
    """Each pair once, the smaller set first; where sets say whether they are ``fresh``, with a fresh side."""
    once = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["set_id"] < b["set_id"]))
    return once & (a["fresh"] | b["fresh"]) if "fresh" in columns else once


def _keyed(rows: DataFrame, level: int, columns: list[str], parts: DataFrame | None = None) -> DataFrame:
    """Similar pairs of the rows ``(key, s)`` within each key.

    From the second level on the band of sizes is part of the key: a set meets sets of its own band and of the
    next. ``parts`` (key, parts) deals the sets of crowded keys into blocks that meet in pairs.
    """
    a, b, on = rows.select("key", F.col("s").alias("a")), rows.select("key", F.col("s").alias("b")), ["key"]
    if level > 1:
        band = lambda s: F.floor(F.log2(s["n"])).cast("int")
        a, b, on = a.withColumn("band", band(F.col("a"))), b.withColumn("band", F.explode(F.array(band(F.col("b")), band(F.col("b")) - 1))), [*on, "band"]
    if parts is not None:
        block = lambda s: F.pmod(F.xxhash64(s["set_id"]), F.col("parts"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        a = a.join(parts, "key").withColumn("x", block(F.col("a"))).withColumn("y", every)
        b = b.join(parts, "key").withColumn("y", block(F.col("b"))).withColumn("x", every)
        a, b, on = a.drop("parts"), b.drop("parts"), [*on, "x", "y"]
    return _met(a.join(b, on).filter(_wanted(F.col("a"), F.col("b"), columns)), level)


def _side(columns: list[str], at: Column) -> Column:
    return F.struct(*columns, at.alias("at"))


def similar_pairs(sets: DataFrame, hot_bucket: int = HOT_BUCKET) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Pairs (a, b, sim) of sets with similarity >= 1/2, and what was left out of them: the rows of crowded keys by level.

    ``sets``: set_id, n, ranked and anything else. Sets meet at a token that both hold in their prefix. A token that more than
    ``hot_bucket`` sets hold is no key by itself: its sets meet at two tokens of longer prefixes, then at three.
    Left out are the pairs of sets that share exactly the crowded key; as they are similar all the same, they have
    at most three times as many tokens as the key. Keys of ``MAX_LEVEL`` tokens that are still crowded are compared
    in blocks of bounded size, so no task holds a crowd.
    """
    columns = [c for c in sets.columns if c not in ("tokens", "key")]
    rows = sets.select("*", F.posexplode(prefix_of(F.col("ranked"))).alias("at", "token"))
    rows = rows.select(F.array("token").alias("key"), _side(columns, F.col("at")).alias("s"))
    found, crowds = None, []
    for level in range(1, MAX_LEVEL + 1):
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > hot_bucket)
        sizes = materialize(sizes, "crowded")
        none = sizes.limit(1).count() == 0
        crowded = broadcast_if_small(sizes.select("key"))
        pairs = _keyed(rows if none else rows.join(crowded, "key", "left_anti"), level, columns)
        found = pairs if found is None else found.unionByName(pairs)
        if none:
            break
        hot = rows.join(crowded, "key", "left_semi")
        if level == MAX_LEVEL:
            parts = broadcast_if_small(sizes.select("key", F.ceil(F.col("size") / hot_bucket).cast("bigint").alias("parts")))
            found = found.unionByName(_keyed(hot, level, columns, parts))
            break
        hot = materialize(hot, "crowd")
        crowds.append((level, hot))
        after = F.expr(f"slice(ranked, 1, cast(floor(size(ranked) / 2) as int) + {level + 1})")
        longer = hot.select("key", "s.*").withColumn("next", F.filter(F.transform(after, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["i"] > F.col("at")))
        longer = longer.withColumn("next", F.explode("next"))
        rows = longer.select(F.array_append("key", F.col("next.t")).alias("key"), _side(columns, F.col("next.i")).alias("s"))
    return found, crowds


def _candidates(rows: DataFrame) -> DataFrame:
    """(set_id, sim, e1, e2) to one row per entry."""
    e = F.explode(F.array_compact(F.array("e1", "e2")))
    return rows.select("set_id", "sim", e.alias("e")).select("set_id", "sim", "e.id", "e.source_id", "e.cluster_id")


def _crowd_candidates(level: int, crowd: DataFrame) -> DataFrame:
    """Candidates from the other sets of a crowded key that share just the key: two entries for each size, no pairs.

    The similarity read off the key is a lower bound that is exact where the key is all that is shared.
    """
    small = crowd.select("key", "s.*").filter(F.col("n") <= 2 * level)
    entries = _candidates_of_key(small)
    index = _two_best(entries, "key", "m").withColumnsRenamed({"e1": "i1", "e2": "i2"})
    hits = small.select("key", "set_id", "n").join(index, "key").filter(F.col("n") + F.col("m") <= 3 * level)
    return _candidates(hits.select("set_id", _sim(F.lit(level), F.col("n"), F.col("m")).alias("sim"), F.col("i1").alias("e1"), F.col("i2").alias("e2")))


def _candidates_of_key(small: DataFrame) -> DataFrame:
    e = F.explode(F.array_compact(F.array("e1", "e2")))
    return small.select("key", F.col("n").alias("m"), F.lit(1.0).alias("sim"), e.alias("e")).select("key", "m", "sim", "e.id", "e.source_id", "e.cluster_id")


def similar_sets(sets: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Per set, its two best entries among other sets with similarity >= 1/2."""
    pairs, crowds = similar_pairs(sets.select("set_id", "n", "ranked", "e1", "e2", *_mark(sets)), hot_bucket)
    both = F.explode(F.array(
        F.struct(F.col("a.set_id").alias("set_id"), F.col("b.e1").alias("e1"), F.col("b.e2").alias("e2")),
        F.struct(F.col("b.set_id").alias("set_id"), F.col("a.e1").alias("e1"), F.col("a.e2").alias("e2")),
    ))
    found = _candidates(pairs.select("sim", both.alias("s")).select("sim", "s.*"))
    for level, crowd in crowds:
        found = found.unionByName(_crowd_candidates(level, crowd))
    return _two_best(found, "set_id")


def _mark(sets: DataFrame) -> list[str]:
    return ["fresh"] if "fresh" in sets.columns else []


def best_matches(items: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(id, source_id, cluster_id, match_id, match_cluster, similarity) for every item that has a match.

    Highest similarity wins, then the highest id. Equal canonical URLs count as similarity 1.
    """
    tokens = F.sort_array(T.title_tokens(F.col("title")))
    items = items.select("id", "source_id", "canonical_url", "cluster_id", tokens.alias("tokens"), "title")
    sets = materialize(order_by_rarity(materialize(story_sets(items), "folded-sets")), "story-sets")
    return matches_among(items.drop("title"), sets, hot_bucket)


def matches_among(items: DataFrame, sets: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """As ``best_matches``, for items with ``tokens`` whose distinct token sets, with prefixes, are at hand."""
    near = similar_sets(sets, hot_bucket).withColumnsRenamed({"e1": "n1", "e2": "n2"})
    known = sets.select("set_id", "tokens", "e1", "e2").join(near, "set_id", "left").drop("set_id")
    urls = _two_best(
        items.filter(F.col("canonical_url") != "").select("canonical_url", F.lit(1.0).alias("sim"), "id", "source_id", "cluster_id"),
        "canonical_url",
    ).filter(F.col("e2").isNotNull()).withColumnsRenamed({"e1": "u1", "e2": "u2"})
    # Titles without tokens and empty addresses match nothing, so they get no key that would gather them.
    lone = F.concat(F.lit("-"), F.col("id").cast("string"))
    rows = (
        items.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(lone)))
        .withColumn("canonical_url", F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(lone))
        .join(known, "tokens", "left").join(urls, "canonical_url", "left")
    )
    s = F.col("source_id")
    options = F.array_compact(F.array(
        _other_source(F.col("e1"), F.col("e2"), s), _other_source(F.col("n1"), F.col("n2"), s),
        _other_source(F.col("u1"), F.col("u2"), s),
    ))
    return rows.withColumn("best", F.array_max(options)).filter(F.col("best").isNotNull()).select(
        "id", "source_id", "cluster_id", F.col("best.id").alias("match_id"),
        F.col("best.cluster_id").alias("match_cluster"), F.col("best.sim").alias("similarity"),
    )


def title_pairs(items: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b, similarity) of every two different titles with similarity >= 1/2 that do not all come from one source.

    ``a`` and ``b`` are the lowest ids of the items with each set of title tokens (``title_sets`` has the members), so
    copies of a title are one row and never pairs.
    """
    sets = title_sets(items).groupBy("set_id", "tokens").agg(F.min("source_id").alias("lo"), F.max("source_id").alias("hi"))
    sets = materialize(sets.withColumn("n", F.size("tokens")), "title-sets")
    sets = materialize(order_by_rarity(sets), "pair-sets")
    pairs, crowds = similar_pairs(sets.drop("tokens"), hot_bucket)
    for level, crowd in crowds:
        # Small sets that share just the crowded key; every such pair is part of the result.
        small = crowd.filter(F.col("s.n") <= 2 * level)
        a, b = small.select("key", F.col("s").alias("a")), small.select("key", F.col("s").alias("b"))
        alike = a.join(b, "key").filter(_wanted(F.col("a"), F.col("b"), [])).filter(F.col("a.n") + F.col("b.n") <= 3 * level)
        alike = alike.filter(F.size(F.array_intersect("a.ranked", "b.ranked")) == level)
        pairs = pairs.unionByName(alike.select("a", "b", _sim(F.lit(level), F.col("a.n"), F.col("b.n")).alias("sim")))
    pairs = pairs.filter("a.lo <> b.hi OR a.hi <> b.lo")
    return pairs.select(F.least("a.set_id", "b.set_id").alias("a"), F.greatest("a.set_id", "b.set_id").alias("b"), F.col("sim").alias("similarity"))


def title_sets(items: DataFrame) -> DataFrame:
    """(id, source_id, tokens, set_id): every item with title tokens and the lowest id that has the same ones."""
    rows = items.select("id", "source_id", F.sort_array(T.title_tokens(F.col("title"))).alias("tokens")).filter(F.size("tokens") > 0)
    return rows.join(rows.groupBy("tokens").agg(F.min("id").alias("set_id")), "tokens").select("id", "source_id", "tokens", "set_id")


def shared_addresses(items: DataFrame) -> DataFrame:
    """(id, canonical_url, first_id, items) of the items whose address more than one source has; a group is never paired."""
    rows = items.select("id", "source_id", "canonical_url").filter("canonical_url <> ''")
    groups = rows.groupBy("canonical_url").agg(
        F.min("id").alias("first_id"), F.count("*").alias("items"), F.min("source_id").alias("lo"), F.max("source_id").alias("hi")
    )
    return rows.join(groups.filter("lo <> hi").drop("lo", "hi"), "canonical_url").select("id", "canonical_url", "first_id", "items")
