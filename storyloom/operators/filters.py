"""Row filters and validations shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.story import hours_between
from ..functions.text import trim_all


def has_named_author(required: Column, author: Column) -> Column:
    return ~(F.coalesce(required, F.lit(False)) & (trim_all(F.coalesce(author, F.lit(""))) == ""))


def max_age_hours(source_class: Column) -> Column:
    hours = F.lit(K.MAX_AGE_HOURS["news"])
    for name, limit in K.MAX_AGE_HOURS.items():
        hours = F.when(source_class == name, F.lit(limit)).otherwise(hours)
    return hours


def is_young_enough(published_at: Column, source_class: Column, now: Column) -> Column:
    return hours_between(now, published_at) <= max_age_hours(source_class)


def not_far_future(published_at: Column, now: Column) -> Column:
    return hours_between(published_at, now) <= K.FUTURE_TOLERANCE_HOURS


def clamp_to_now(published_at: Column, now: Column) -> Column:
    return F.least(published_at, now)


def due_sources(sources: DataFrame, now: Column, force: bool = False) -> DataFrame:
    if force:
        return sources
    return sources.filter(F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now))


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("active")


def since(df: DataFrame, column: str, now: Column, window: str) -> DataFrame:
    """Rows whose timestamp is at or after ``now`` minus an interval such as ``'7 days'``.

    A table that is partitioned by the timestamp's date is filtered by it too, so that only those folders are read.
    """
    earliest = now - F.expr(f"interval {window}")
    day = column.removesuffix("_at") + "_date"
    if day in df.columns:
        df = df.filter(F.col(day) >= earliest.cast("date"))
    return df.filter(F.col(column) >= earliest)


def in_category(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    if not topics:
        return df
    return df.filter(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))


def parse_signal_batches(batches: DataFrame, limit: int | None = None) -> DataFrame:
    """(profile_id, batch_id, payload, ...) JSON batches to valid signals.

    With a ``limit`` only so many entries of a batch count, cut before validation, as for a request.
    """
    keep = [c for c in batches.columns if c != "payload"]
    entries = F.from_json("payload", "signals array<string>")["signals"]
    raw = batches.select(
        *keep, F.posexplode(entries if limit is None else F.slice(entries, 1, limit)).alias("pos", "entry")
    ).withColumn("v", F.try_parse_json("entry"))

    def field(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "variant")

    def is_number(name: str) -> Column:
        return F.schema_of_variant(field(name)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")

    item, value = F.try_variant_get("v", "$.itemId", "double"), F.try_variant_get("v", "$.value", "double")
    kind = F.try_variant_get("v", "$.type", "string")
    return raw.filter(
        is_number("itemId") & (item == F.floor(item)) & (F.schema_of_variant(field("type")) == "STRING") & kind.isin(*K.SIGNAL_TYPES)
    ).select(
        *keep, "pos", item.cast("bigint").alias("item_id"), kind.alias("type"),
        F.when(is_number("value"), F.greatest(F.lit(0.0), F.least(value, F.lit(K.SIGNAL_VALUE_MAX))))
        .otherwise(F.lit(1.0)).alias("value"),
    )


def known_items(signals: DataFrame, items: DataFrame) -> DataFrame:
    """Signals on items that exist."""
    return signals.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi")


def valid_interests(interests: Column) -> Column:
    known = F.array(*[F.lit(t) for t in K.KNOWN_TOPICS])
    return F.slice(F.filter(interests, lambda t: F.array_contains(known, t)), 1, K.MAX_INTERESTS)


def interests_or_default(interests: Column) -> Column:
    return F.coalesce(interests, F.array(*[F.lit(t) for t in K.DEFAULT_INTERESTS]))


SUMMARY_COLUMNS = [
    "id", "source_id", "guid", "author", "title", "url", "canonical_url", "excerpt", "image_url", "published_at",
    "fetched_at", "source_updated_at", "updated_at", "first_seen_at", "last_seen_at", "content_fingerprint",
    "word_count", "status", "verification_status", "correction_note", "topics", "cluster_id",
]


def item_summaries(items: DataFrame) -> DataFrame:
    """Every item column but the body, so scans never read it."""
    return items.select(*SUMMARY_COLUMNS)


def search_stories(index: DataFrame, needle: str, limit: int = K.SEARCH_STORY_LIMIT) -> DataFrame:
    """The first stories of each reader, in index order, whose title holds the needle; an index without
    ``profile_id`` is one reader's."""
    needle = needle.strip().lower()
    if not needle:
        return index.limit(0)
    hits = index.filter(F.lower("title").contains(needle))
    if "profile_id" not in index.columns:
        return hits.orderBy("position").limit(limit)
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("position"))
    return hits.withColumn("place", place).filter(F.col("place") <= limit)


def search_worlds(categories: DataFrame, needle: str) -> DataFrame:
    needle = needle.strip().lower()
    if not needle:
        return categories.orderBy("ord")
    hit = F.lower("label").contains(needle) | F.col("slug").contains(needle)
    return categories.filter(hit).orderBy("ord").limit(K.SEARCH_WORLD_LIMIT)


def search_sources(sources: DataFrame, needle: str) -> DataFrame:
    needle = needle.strip().lower()
    if not needle:
        return sources
    return sources.filter(F.lower("name").contains(needle) | F.exists("topic_hints", lambda t: t.contains(needle)))
