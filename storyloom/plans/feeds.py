"""Reader-facing jobs: ranked feeds, topic worlds, saved stories, source directory and article lookup."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.story import hours_between, reading_minutes
from ..functions.text import bind
from ..operators import feed as O
from ..operators.bridges import list_position
from ..operators.filters import active_sources, in_category, item_summaries
from ..operators.freshness import source_freshness
from ..session import broadcast_if_small, broadcast_of, materialize

TODAY = O.TODAY
ORDS = {slug: i for i, (slug, _, _) in enumerate(K.CATEGORIES)}


class Tables(NamedTuple):
    """Inputs of the reader jobs. ``reads`` are (profile_id, item_id) pairs."""

    profiles: DataFrame
    affinities: DataFrame
    saves: DataFrame
    reads: DataFrame
    mutes: DataFrame
    items: DataFrame
    sources: DataFrame


class Feed(NamedTuple):
    entries: DataFrame
    latest: DataFrame
    updated_at: DataFrame


class Worlds(NamedTuple):
    worlds: DataFrame  # one row per profile and world
    world_entries: DataFrame  # profile, slug, rank, item
    stories: DataFrame  # one row per profile and visible item
    readers: DataFrame  # one row per profile
    freshness: DataFrame  # one row


def stored_pool(t: Tables, now: Column, candidates: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """The candidate pool, written once because several parts of a plan read it.

    ``candidates`` is the feature that bounds it: the pool travels to the readers as one value.
    """
    return materialize(O.candidate_pool(t.items, t.sources, now, candidates), "pool")


def story_columns(saved: Column, read: Column, is_new: Column, exploration: Column, also: Column) -> list[Column]:
    """The delivered story: item and source columns plus the reader's flags."""
    c = F.col
    return [
        c("id"), c("title"), c("url"), c("excerpt"), c("author"), c("image_url"), c("published_at"), c("fetched_at"),
        c("updated_at"), c("source_checked_at"), c("topics"), c("source_id"), c("source_name"), c("source_homepage_url"),
        c("source_class"), c("credibility_tier"), (c("word_count") > 0).alias("has_body"),
        reading_minutes(c("word_count")).alias("reading_minutes"), exploration.alias("exploration"),
        also.alias("also_covered_by"), saved.alias("saved"), read.alias("read"), is_new.alias("is_new"),
        c("status"), c("verification_status"), c("correction_note"),
    ]


def _told(pool: DataFrame, now: Column) -> DataFrame:
    """The pool with what a world's figures take from a story's age."""
    age = hours_between(now, F.col("published_at"))
    fast = F.col("source_class").isin("news", "social")
    return pool.withColumns({"young": age < K.BREAKING_CLUSTER_HOURS, "burst": (age < K.BREAKING_BURST_MINUTES / 60.0) & fast})


def stored_readers(t: Tables, pool: DataFrame) -> DataFrame:
    """Reader state over the pool, written once and spread over the ranking tasks."""
    return O.stored_readers(O.reader_state(t.profiles, t.affinities, t.saves, t.reads, t.mutes, pool))


def _picked(readers: DataFrame, pool: DataFrame, now: Column, slugs: Column, limit: int, tabs: list[str]) -> DataFrame:
    """One row per profile and world with its final ``picks`` in order.

    A pick names stories by their place in the pool, which is one value, so nothing is joined or shuffled for it.
    """
    since = F.coalesce("last_feed_opened_at", now - F.expr(f"interval {K.FIRST_VISIT_NEW_HOURS} hours"))

    def entry(rank: Column, p: Column, stories: Column) -> Column:
        def outlet(place: Column) -> Column:
            return bind(F.get(stories, place), lambda e: F.struct(e["source_name"].alias("source_name"), e["url"].alias("url")))

        return bind(F.get(stories, p["at"]), lambda e: F.struct(
            rank.alias("rank"), e["id"].alias("id"), p["score"].alias("score"), p["exploration"].alias("exploration"),
            F.transform(p["covered"], outlet).alias("also_covered_by"), F.array_contains("saved", e["id"]).alias("saved"),
            F.array_contains("read", e["id"]).alias("read"), (e["published_at"] > since).alias("is_new"),
            e["published_at"].alias("published_at"), e["young"].alias("young"), e["burst"].alias("burst"),
        ))

    told = ["id", "published_at", "young", "burst", "source_name", "url"]
    return O.picked_worlds(readers, O.world_pool(_told(pool, now), now, slugs, tabs, told), limit, entry)


def feed_job(t: Tables, now: Column, category: str = TODAY, limit: int = K.FEED_LIMIT, candidates: int = K.CANDIDATE_LIMIT) -> Feed:
    """The flat ranked feed of every profile, for everything or for one tab."""
    c = F.col
    topics = next(topics for slug, _, topics in K.CATEGORIES if slug == category)
    everything = stored_pool(t, now, candidates)
    pool = in_category(everything, topics)
    readers = stored_readers(t, everything)
    # Every scoped story sits in one list.
    lists = _picked(readers, pool, now, F.array(F.lit(TODAY)), limit, [TODAY])
    picks = lists.select("profile_id", F.inline("picks"))
    about = broadcast_of(everything)(pool)
    entries = picks.select("profile_id", "rank", "id", "score", "exploration", "also_covered_by", "saved", "read").join(about, "id").select(
        "profile_id", "rank", "score", *story_columns(c("saved"), c("read"), F.lit(False), c("exploration"), c("also_covered_by"))
    )
    none = F.array().cast("array<struct<source_name:string,url:string>>")
    fresh = latest_social(readers, pool, now).join(about, "id").select(
        "profile_id", "place", *story_columns(c("saved"), c("read"), F.lit(False), F.lit(False), none)
    )
    by_source = everything.groupBy("source_id").agg(F.max("updated_at").alias("updated_at"))
    updates = readers.withColumn("u", by_source.agg(F.collect_list(F.struct("source_id", "updated_at"))).scalar())
    kept = F.filter("u", lambda e: ~F.array_contains("muted", e["source_id"]))
    return Feed(entries, fresh, updates.select("profile_id", F.array_max(kept["updated_at"]).alias("updated_at")))


def latest_social(readers: DataFrame, pool: DataFrame, now: Column) -> DataFrame:
    """Per profile, the newest social stories of the last twelve hours."""
    recent = pool.filter((F.col("source_class") == "social") & (hours_between(now, F.col("published_at")) < K.LATEST_WINDOW_HOURS))
    newest = F.struct((-F.unix_micros("published_at")).alias("at"), "id", "source_id")
    line = recent.agg(F.sort_array(F.collect_list(newest))).scalar()
    readers = readers.withColumn("line", line)
    mine = F.slice(F.filter("line", lambda e: ~F.array_contains("muted", e["source_id"])), 1, K.LATEST_LIMIT)
    rows = readers.select("profile_id", "saved", "read", F.posexplode(mine["id"]).alias("place", "id"))
    return rows.select(
        "profile_id", "place", "id", F.array_contains("saved", F.col("id")).alias("saved"), F.array_contains("read", F.col("id")).alias("read")
    )


def worlds_job(t: Tables, now: Column, cut=lambda df: materialize(df, "ranked-worlds"), candidates: int = K.CANDIDATE_LIMIT) -> Worlds:
    """All worlds of every profile. ``cut`` stores the ranked worlds, which several outputs read."""
    c = F.col
    pool = stored_pool(t, now, candidates)
    ranked = cut(_picked(stored_readers(t, pool), pool, now, O.slugs_of(c("topics")), K.WORLD_LIMIT, list(ORDS)))
    labels = F.create_map(*[F.lit(x) for slug, label, _ in K.CATEGORIES for x in (slug, label)])
    ords = F.create_map(*[F.lit(x) for slug, i in ORDS.items() for x in (slug, i)])
    breaking = F.exists("picks", lambda p: (F.size(p["also_covered_by"]) >= 1) & p["young"]) | (
        F.size(F.filter("picks", lambda p: p["burst"])) >= K.BREAKING_BURST_COUNT
    )
    unread = F.filter("picks", lambda p: p["is_new"] & ~p["read"])
    # The first tab shows half of its entries, but its figures come from all of them.
    visible = F.when(c("slug") == TODAY, F.slice("picks", 1, K.TODAY_VISIBLE)).otherwise(c("picks"))
    worlds = ranked.select(
        "profile_id", "slug", F.element_at(ords, c("slug")).alias("ord"), F.element_at(labels, c("slug")).alias("label"), "affinity",
        F.tanh(c("mass") / K.ACTIVITY_SCALE).alias("activity"), breaking.alias("breaking"), F.size(unread).alias("new_count"),
        visible.alias("entries"), "last_feed_opened_at", "latest_update",
    )
    shown = worlds.select("profile_id", "slug", "ord", F.inline("entries"))
    stories = visible_stories(shown)
    # An empty feed still has a reader row; every profile has all of its worlds.
    base = worlds.filter(c("slug") == TODAY).select("profile_id", c("last_feed_opened_at").alias("last_visit_at"), c("latest_update").alias("updated_at"))
    catch = catch_up(stories)
    readers = base.join(catch, "profile_id", "left").withColumns(
        {"new_count": F.coalesce("new_count", F.lit(0)), "catch_up": F.coalesce("catch_up", F.array().cast("array<bigint>"))}
    )
    delivered = stories.join(broadcast_of(pool)(pool), "id").select(
        "profile_id", "position", *story_columns(c("saved"), c("read"), c("is_new"), c("exploration"), c("also_covered_by"))
    )
    return Worlds(worlds, shown.select("profile_id", "slug", "rank", c("id").alias("item_id"), "score", "exploration"), delivered, readers, source_freshness(t.sources, now))


def visible_stories(shown: DataFrame) -> DataFrame:
    """One row per profile and item: place of the first world that lists it, flags and coverage of the last one."""
    last = F.struct("also_covered_by", "saved", "read", "is_new", "exploration")
    rows = shown.withColumn("entry_at", F.col("published_at")).groupBy("profile_id", "id").agg(
        F.max_by(last, "ord").alias("s"), F.min(list_position(F.col("ord"), F.col("rank"))).alias("position"), F.first("entry_at").alias("entry_at"),
    )
    return rows.select("profile_id", "id", "position", "entry_at", "s.*")


def catch_up(stories: DataFrame) -> DataFrame:
    """Unread new stories per profile: how many, and the newest eight (ties in world order)."""
    new = stories.filter(F.col("is_new") & ~F.col("read"))
    entry = F.struct((-F.unix_micros("entry_at")).alias("at"), "position", "id")
    # At most the visible entries of one profile.
    return new.groupBy("profile_id").agg(
        F.count("*").alias("new_count"), F.slice(F.sort_array(F.collect_list(entry)), 1, K.CATCH_UP_LIMIT)["id"].alias("catch_up")
    )


def rehydrate(world_entries: DataFrame, stories: DataFrame) -> DataFrame:
    """World entries with their stories again; ids without a story drop out, order stays in ``rank``."""
    return world_entries.select("profile_id", "slug", "rank", F.col("item_id").alias("id")).join(stories, ["profile_id", "id"])


def saved_job(profiles: DataFrame, saves: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Saved stories per profile, newest save first."""
    c = F.col
    about = sources.select(
        c("id").alias("source_id"), c("name").alias("source_name"), c("homepage_url").alias("source_homepage_url"), "source_class",
        "credibility_tier", c("last_successful_fetch_at").alias("source_checked_at"),
    )
    rows = (
        saves.select("profile_id", c("item_id").alias("id"), c("created_at").alias("saved_at"))
        .join(profiles.select("profile_id"), "profile_id", "left_semi")
        .join(item_summaries(items), "id").join(broadcast_if_small(about), "source_id")
    )
    none = F.array().cast("array<struct<source_name:string,url:string>>")
    newest = Window.partitionBy("profile_id").orderBy(F.desc("saved_at"), "id")
    columns = story_columns(F.lit(True), F.lit(False), F.lit(False), F.lit(False), none)
    return rows.withColumn("place", F.row_number().over(newest)).select("profile_id", "place", "saved_at", *columns)


class Directory(NamedTuple):
    sources: DataFrame  # active sources, by name
    muted: DataFrame  # profile_id, muted_ids: the active sources that each profile has muted


def sources_job(profiles: DataFrame, sources: DataFrame, mutes: DataFrame) -> Directory:
    """The list of active sources, which is the same for everybody, and what each profile has muted of it."""
    columns = ["id", "name", "homepage_url", "source_class", "kind", "topic_hints", "credibility_tier", "poll_interval_minutes", "last_successful_fetch_at", "last_status"]
    listed = active_sources(sources).select(*columns)
    known = mutes.join(broadcast_if_small(listed.select(F.col("id").alias("source_id"))), "source_id", "left_semi")
    ids = known.groupBy("profile_id").agg(F.array_sort(F.collect_set("source_id")).alias("muted_ids"))
    muted = profiles.select("profile_id").join(ids, "profile_id", "left")
    empty = F.array().cast(ids.schema["muted_ids"].dataType)
    return Directory(listed.orderBy("name", "id"), muted.withColumn("muted_ids", F.coalesce("muted_ids", empty)))


def reader_items(wanted: DataFrame, items: DataFrame, sources: DataFrame, saves: DataFrame) -> DataFrame:
    """Whole articles for (profile_id, item_id) requests, with the source and a saved flag; unknown ids drop out."""
    c = F.col
    kept = saves.select("profile_id", "item_id").distinct().withColumn("saved", F.lit(True))
    about = sources.select(c("id").alias("source_id"), c("name").alias("source_name"), "source_class", "credibility_tier")
    return (
        wanted.join(items.withColumnRenamed("id", "item_id"), "item_id").join(broadcast_if_small(about), "source_id")
        .join(kept, ["profile_id", "item_id"], "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    )


def items_by_ids(items: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Summaries and sources of the distinct ids asked for."""
    about = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    wanted = ids.select(F.col("item_id").alias("id")).distinct()
    return item_summaries(items).join(wanted, "id", "left_semi").join(broadcast_if_small(about), "source_id")
