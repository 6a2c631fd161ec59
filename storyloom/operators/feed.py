"""Candidate pool, reader state, scoring, cluster collapse and the diverse re-rank.

Every reader meets the same pool of at most 500 stories, so the pool travels to the readers: it is a scalar
subquery that each reader row meets. Readers are hash-partitioned once, on profile_id; scoring, collapse and
re-rank all happen inside that partitioning, so no reader x story row is ever shuffled. Feeds and worlds rank
a reader's whole pool in its one row (``picked_worlds``); ``score_readers`` and ``ranked_worlds`` give the rows behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.story import hours_between, recency
from ..functions.text import bind
from ..session import broadcast_if_small, broadcast_of, materialize
from .diversity import picked_places, pool_picked, repeated_places, weighed
from .filters import SUMMARY_COLUMNS, interests_or_default, since

TODAY = K.CATEGORIES[0][0]


def category_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, slug, label, topics) for i, (slug, label, topics) in enumerate(K.CATEGORIES)],
        "ord int, slug string, label string, topics array<string>",
    )


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def slugs_of(topics: Column) -> Column:
    """Tabs that show an item: the first one always, the others when they share a topic."""
    tabs = [F.lit(TODAY)]
    for slug, _, wanted in K.CATEGORIES[1:]:
        tabs.append(F.when(F.arrays_overlap(topics, _texts(wanted)), F.lit(slug)))
    return F.array_compact(F.array(*tabs))


def candidate_pool(items: DataFrame, sources: DataFrame, now: Column, limit: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """The newest stories of the last seven days with their source; at most ``limit`` rows."""
    about = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("homepage_url").alias("source_homepage_url"),
        "source_class", "credibility_tier", "quality_prior", F.col("last_successful_fetch_at").alias("source_checked_at"),
    )
    recent = since(items.select(*[c for c in SUMMARY_COLUMNS if c in items.columns]), "published_at", now, f"{K.CANDIDATE_WINDOW_DAYS} days")
    return recent.join(broadcast_if_small(about), "source_id").orderBy(F.desc("published_at"), "id").limit(limit)


def _pool_entries(pool: DataFrame, now: Column, slugs: Column, more: list[str] = ()) -> DataFrame:
    """What ranking needs of a story, plus one empty entry so that worlds without stories still get a row."""
    c = F.col
    age = hours_between(now, c("published_at"))
    entries = pool.select(
        "id", "source_id", "topics", F.concat(F.lit("source:"), "source_id").alias("source_key"),
        F.concat(F.lit("author:"), F.lower("author")).alias("author_key"), "cluster_id", "quality_prior", "updated_at",
        recency(c("published_at"), c("source_class"), now).alias("recency"), slugs.alias("slugs"),
        F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), age) / K.ACTIVITY_HALF_LIFE_HOURS).alias("mass"), *more,
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "slugs" else _texts([s for s, _, _ in K.CATEGORIES]).alias("slugs") for f in entries.schema]
    return entries.unionByName(entries.sparkSession.range(1).select(*empty))


#: What a reader's affinities are looked up by; stories share their values, so each value is scored once a reader.
_SCORED_BY = ["topics", "source_key", "author_key"]


def _terms(pool: Column) -> list[Column]:
    """What a reader's state says about each topic list, source and author of the pool."""
    c = F.col

    def by_topics(topics: Column) -> Column:
        weights = F.transform(topics, lambda t: F.try_element_at(c("aff"), F.concat(F.lit("topic:"), t)))

        def terms(tw: Column) -> Column:
            known = F.filter(tw, lambda w: w.isNotNull())
            topic = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, w: s + _norm(w)) / F.size(known)).otherwise(F.lit(0.0))
            cold = F.exists(F.arrays_zip(topics.alias("t"), tw.alias("w")), lambda z: z["w"].isNull() & F.array_contains("interests", z["t"]))
            unknown = ~F.exists(tw, lambda w: F.coalesce(w > 0, F.lit(False))) & ~F.arrays_overlap(topics, "interests")
            return F.struct(topic.alias("topic"), cold.alias("cold"), unknown.alias("unknown"))

        return bind(weights, terms)

    def by_key(key: Column) -> Column:
        return F.coalesce(_norm(F.try_element_at("aff", key)), F.lit(0.0))

    scored = {"topics": by_topics, "source_key": by_key, "author_key": by_key}
    return [F.transform(pool[k], scored[k]).alias(k) for k in _SCORED_BY]


def pool_array(pool: DataFrame, now: Column, slugs: Column) -> Column:
    """The pool as one value; safe to hold because the pool is capped: the stories, and the distinct topic lists, sources
    and authors, which a story names by their places."""
    entries = _pool_entries(pool, now, slugs)
    whole = entries.agg(F.collect_list(F.struct(*entries.columns)).alias("stories"), *[F.collect_set(k).alias(k) for k in _SCORED_BY])

    def story(e: Column) -> Column:
        places = [F.array_position(k, e[k]).cast("int").alias(f"{k}_at") for k in _SCORED_BY]
        return F.struct(*[e[n].alias(n) for n in entries.columns if n not in _SCORED_BY], F.get(e["topics"], F.lit(0)).alias("topic"), *places)

    return whole.select(F.struct(F.transform("stories", story).alias("stories"), *_SCORED_BY).alias("pool")).scalar()


def reader_state(profiles, affinities, saves, reads, mutes, pool) -> DataFrame:
    """One row per profile with what it knows about the pool: affinity map, saved, read and muted ids.

    Everything is cut down to the pool first and then meets in a single aggregation on profile_id.
    """
    c = F.col
    spark = pool.sparkSession
    keys = F.concat(
        F.transform("topics", lambda t: F.concat(F.lit("topic:"), t)), F.array(F.concat(F.lit("source:"), c("source_id"))),
        F.array_compact(F.array(F.concat(F.lit("author:"), F.lower("author")))),
    )
    tabs = spark.range(1).select(F.explode(_texts([f"topic:{t}" for _, _, ts in K.CATEGORIES for t in ts])).alias("k"))
    hint = broadcast_of(pool)
    wanted = hint(pool.select(F.explode(keys).alias("k")).unionByName(tabs).distinct())
    ids = hint(pool.select(c("id").alias("item_id")))
    origins = hint(pool.select("source_id").distinct())

    def part(df: DataFrame, **fields: Column) -> DataFrame:
        kinds = {
            "k": "string", "weight": "double", "saved": "bigint", "read": "bigint", "muted": "bigint",
            "profile": "struct<interests:array<string>,last_feed_opened_at:timestamp>",
        }
        return df.select("profile_id", *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    weights = affinities.select("profile_id", F.concat("dimension", F.lit(":"), "key").alias("k"), "weight")
    rows = part(weights.join(wanted, "k", "left_semi"), k=c("k"), weight=c("weight"))
    rows = rows.unionByName(part(saves.join(ids, "item_id", "left_semi"), saved=c("item_id")))
    rows = rows.unionByName(part(reads.join(ids, "item_id", "left_semi"), read=c("item_id")))
    rows = rows.unionByName(part(mutes.join(origins, "source_id", "left_semi"), muted=c("source_id")))
    rows = rows.unionByName(part(profiles, profile=F.struct(interests_or_default(c("interests")), "last_feed_opened_at")))
    return (
        rows.groupBy("profile_id").agg(
            bind(F.sort_array(F.collect_list(F.when(c("k").isNotNull(), F.struct("k", "weight")))), _weight_map).alias("aff"),
            F.collect_set("saved").alias("saved"), F.collect_set("read").alias("read"), F.collect_set("muted").alias("muted"),
            F.first("profile", ignorenulls=True).alias("p"),
        )
        .filter("p IS NOT NULL").select("profile_id", "aff", "saved", "read", "muted", "p.*")
    )


def _weight_map(entries: Column) -> Column:
    """Sorted (key, weight) entries as a map; a key that is stored twice counts once, with its larger weight."""
    return F.map_from_entries(F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["k"] != e["k"], F.lit(True))))


def stored_readers(readers: DataFrame) -> DataFrame:
    """Reader state written once, then spread over the ranking tasks."""
    rows = materialize(readers, "readers")
    return rows.repartition(ranking_partitions(rows.sparkSession, rows.count()), "profile_id")


#: Readers that one ranking task takes; each unpacks the whole pool.
READERS_PER_TASK = 5_000


def ranking_partitions(spark, readers: int) -> int:
    """Reader rows are small but each unpacks the whole pool, so they are dealt by their number and not by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-readers // READERS_PER_TASK))


def _norm(w: Column) -> Column:
    return F.tanh(w / K.AFFINITY_TANH_SCALE)


def score_readers(readers: DataFrame, pool: Column, now: Column) -> DataFrame:
    """(profile, story) rows with score and flags, muted sources left out.

    Each topic list, source and author is scored once a reader, so a story's row is three look-ups by place.
    """
    c = F.col

    rows = readers.withColumn("pool", pool)
    rows = rows.select("*", *_terms(c("pool")))
    rows = rows.select("*", F.inline("pool.stories")).filter(c("id").isNull() | ~F.array_contains("muted", c("source_id")))
    topic, source, author = (F.get(k, c(f"{k}_at") - 1) for k in _SCORED_BY)
    seed = F.when(topic["cold"], F.lit(K.SCORE_WEIGHTS["seed"])).otherwise(F.lit(0.0))
    known = [F.coalesce(v, F.lit(0.0)) for v in (topic["topic"], source, author)]
    score = weighed(K.SCORE_WEIGHTS, *known, c("recency"), c("quality_prior"), seed)
    return rows.select(
        "profile_id", "aff", "saved", "read", "last_feed_opened_at", "updated_at", "slugs", "id", "source_id",
        "topic", "cluster_id", "mass", score.alias("score"), topic["unknown"].alias("explore"),
    )


def _world_affinity(slug: Column) -> Column:
    topics = F.create_map(*[x for s, _, ts in K.CATEGORIES for x in (F.lit(s), _texts(ts))])

    def known(t: Column) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("aff", F.concat(F.lit("topic:"), t)), F.lit(0.0)))

    total = F.aggregate(F.element_at(topics, slug), F.lit(0.0), lambda s, t: s + known(t))
    return F.tanh(total / K.WORLD_AFFINITY_SCALE)


def ranked_worlds(scored: DataFrame) -> DataFrame:
    """(profile, slug) rows with all scoped stories in (score desc, id) order and the reader's marks.

    A group is at most the pool, and the input is already partitioned by profile.
    """
    c = F.col
    entry = F.struct((-c("score")).alias("neg"), "id", "source_id", "topic", "cluster_id", "explore")
    empty = c("id").isNull()
    marks = F.struct("saved", "read", "last_feed_opened_at", "aff")
    # Only the empty entry keeps the reader's marks, so the rows that are grouped stay narrow.
    rows = scored.withColumn("slug", F.explode("slugs")).select(
        "profile_id", "slug", F.when(~empty, entry).alias("entry"), "mass", "updated_at", F.when(empty, marks).alias("marks")
    )
    return (
        rows.groupBy("profile_id", "slug").agg(
            F.sort_array(F.collect_list("entry")).alias("ranked"), F.sum("mass").alias("mass"),
            F.max("updated_at").alias("latest_update"), F.first("marks", ignorenulls=True).alias("marks"),
        )
        .select("profile_id", "slug", "ranked", "mass", "latest_update", "marks.*")
        .withColumn("affinity", _world_affinity(c("slug"))).drop("aff")
    )


def collapsed(worlds: DataFrame) -> DataFrame:
    """Keep the best entry of every cluster in ``ranked``; the others move to ``also``, in the same order."""
    found = worlds.withColumn("again", repeated_places(F.col("ranked")["cluster_id"]))
    first = F.filter("ranked", lambda e, i: ~F.array_contains("again", i))
    # One after the other, as ``also`` names places in the list as it was.
    return found.withColumn("also", _at("again")).withColumn("ranked", first).drop("again")


def _at(places: str) -> Column:
    return F.transform(places, lambda i: F.get("ranked", i))


def covered_by(cluster_id: Column, also: Column) -> Column:
    """Ids of the collapsed stories behind the entry of a cluster."""
    same = F.filter(also, lambda o: o["cluster_id"] == cluster_id)
    return F.when(cluster_id.isNotNull(), same["id"]).otherwise(F.array().cast("array<bigint>"))


def picked(worlds: DataFrame, limit: int, **penalties) -> DataFrame:
    """Worlds with ``picks`` in place of ``ranked``, and ``also`` as ``collapsed`` gives it.

    ``picks`` is the greedy diverse order of the collapsed list: rank, id, cluster_id, score and whether the slot
    explored. Only places are worked out in Python, over Arrow batches of the few columns it takes; the entries
    themselves never leave the JVM, and no step in it goes through a whole list.
    """
    r = F.col("ranked")
    chosen = worlds.withColumn("at", picked_places(r["neg"], r["topic"], r["source_id"], r["explore"], r["cluster_id"], limit, **penalties))

    def entry(o: Column, i: Column) -> Column:
        return bind(F.get("ranked", F.abs(o) - 1), lambda e: F.struct(
            i.alias("rank"), e["id"].alias("id"), e["cluster_id"].alias("cluster_id"), (-e["neg"]).alias("score"), (o < 0).alias("exploration")
        ))

    return chosen.withColumns({"also": _at("at.again"), "picks": F.transform("at.order", entry)}).drop("ranked", "at")


def world_pool(pool: DataFrame, now: Column, slugs: Column, tabs: list[str], told: list[str]) -> Column:
    """The pool as ``picked_worlds`` takes it: the columns ``told`` of its stories in order of id, what ranking needs of them as
    numbers, and for each tab the places of its stories (from 0) and what each source brings to its figures. As small as the
    capped pool."""
    entries = _pool_entries(pool, now, slugs, [n for n in told if n != "id"]).filter("id IS NOT NULL")
    whole = entries.agg(
        F.sort_array(F.collect_list(F.struct(*entries.columns))).alias("stories"), *[F.collect_set(k).alias(k) for k in _SCORED_BY],
        F.collect_set(F.get("topics", F.lit(0))).alias("topic"), F.collect_set("cluster_id").alias("cluster"),
    )

    def numbers(known: str, value) -> Column:
        return F.transform("stories", lambda e: F.coalesce(F.array_position(known, value(e)).cast("int"), F.lit(0)))

    facts = [
        numbers("topic", lambda e: F.get(e["topics"], F.lit(0))), numbers("source_key", lambda e: e["source_key"]),
        numbers("cluster", lambda e: e["cluster_id"]), numbers("topics", lambda e: e["topics"]), numbers("author_key", lambda e: e["author_key"]),
    ]
    # Stories without a figure come last.
    worth = [F.transform("stories", lambda e: F.coalesce(e[n], F.lit(-1e300))) for n in ("recency", "quality_prior")]

    def world(slug: str) -> Column:
        mine = F.filter("stories", lambda e: F.array_contains(e["slugs"], slug))

        def brought(source: Column) -> Column:
            of = F.filter(mine, lambda e: e["source_id"] == source)
            mass = F.aggregate(of, F.lit(0.0), lambda s, e: s + e["mass"])
            return F.struct(source.alias("source_id"), mass.alias("mass"), F.array_max(of["updated_at"]).alias("updated_at"))

        sources = F.transform(F.array_distinct(mine["source_id"]), brought)
        holds = F.transform("stories", lambda e, i: F.when(F.array_contains(e["slugs"], slug), i))
        return F.struct(F.lit(slug).alias("slug"), sources.alias("sources"), F.array_compact(holds).alias("places"))

    return whole.select(F.struct(
        F.transform("stories", lambda e: F.struct(*[e[n].alias(n) for n in told])).alias("stories"), F.array(*facts).alias("facts"),
        F.array(*worth).alias("worth"), *_SCORED_BY, F.array(*[world(s) for s in tabs]).alias("worlds"),
    )).scalar()


def picked_worlds(readers: DataFrame, pool: Column, limit: int, entry, **penalties) -> DataFrame:
    """(profile, slug) rows with ``picks`` in the greedy diverse order, for ``pool`` as ``world_pool`` gives it, and the world's figures.

    A reader stays one row until its worlds are complete: its terms by topic list, source and author go to Python, where numpy
    scores and ranks the pool for a batch of readers, and places in the pool come back. ``entry(rank, pick, stories)`` makes a pick of its ``at``, ``exploration``, ``score`` and ``covered``.
    """
    c = F.col

    def world(w: Column) -> Column:
        slug, heard = w["world"]["slug"], F.filter(w["world"]["sources"], lambda s: ~F.array_contains("muted", s["source_id"]))
        return bind(heard, lambda h: F.struct(
            slug.alias("slug"), F.transform(w["picks"], lambda p, i: entry(i, p, c("pool.stories"))).alias("picks"),
            F.aggregate(h["mass"], F.lit(0.0), lambda s, m: s + m).alias("mass"), F.array_max(h["updated_at"]).alias("latest_update"),
            _world_affinity(slug).alias("affinity"),
        ))

    kept = ["profile_id", "aff", "saved", "read", "muted", "last_feed_opened_at"]
    topics, sources, authors = _terms(c("pool"))
    # No term of a muted source, so that its stories are left out.
    muted = F.transform("muted", lambda s: F.concat(F.lit("source:"), s))
    heard = bind(muted, lambda m: F.transform(F.arrays_zip(c("pool.source_key").alias("k"), sources.alias("w")), lambda z: F.when(~F.array_contains(m, z["k"]), z["w"])))
    taken = F.struct(
        topics.alias("topics"), heard.alias("sources"), authors.alias("authors"),
        *[c(f"pool.{n}").alias(n) for n in ("facts", "worth")], c("pool.worlds.places").alias("places"),
    )
    # The pool is a value of the query: it is named anew above the picks, so that it does not travel beside them.
    rows = readers.withColumn("pool", pool).select(*kept, F.inline(F.array(taken)))
    picks = pool_picked(*[c(n) for n in ("topics", "sources", "authors", "facts", "worth", "places")], limit, **penalties)
    rows = rows.select(*kept, picks.alias("picks")).withColumn("pool", pool)
    worlds = F.transform(F.arrays_zip(c("pool.worlds").alias("world"), c("picks").alias("picks")), world)
    return rows.select("profile_id", "last_feed_opened_at", F.inline(worlds))
