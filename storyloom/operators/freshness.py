"""Source freshness and tab counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .feed import slugs_of
from .filters import active_sources, since


def is_stale(now: Column, floor_minutes: int = K.STALE_FLOOR_MINUTES) -> Column:
    allowance = F.greatest(F.lit(floor_minutes), F.col("poll_interval_minutes") * 2)
    minutes = (F.unix_micros(now) - F.unix_micros("last_successful_fetch_at")) / F.lit(60_000_000.0)
    return F.col("last_successful_fetch_at").isNull() | (minutes > allowance)


def source_freshness(sources: DataFrame, now: Column) -> DataFrame:
    return active_sources(sources).agg(
        F.max("last_successful_fetch_at").alias("latest_checked_at"), F.min("last_successful_fetch_at").alias("oldest_checked_at"),
        F.count_if(is_stale(now)).alias("stale_sources"), F.count("*").alias("total_sources"),
    )


def any_stale(sources: DataFrame, now: Column, floor_minutes: int = K.STALE_FLOOR_MINUTES) -> DataFrame:
    return active_sources(sources).agg(F.coalesce(F.bool_or(is_stale(now, floor_minutes)), F.lit(False)).alias("stale"))


def tab_counts(items: DataFrame, now: Column) -> DataFrame:
    """Stories of the last six hours per topic tab, capped for display. Empty tabs count zero."""
    recent = since(items.select("id", "topics", "published_at"), "published_at", now, f"{K.TAB_COUNT_WINDOW_HOURS} hours")
    tabs = F.filter(slugs_of(F.col("topics")), lambda s: s != K.CATEGORIES[0][0])
    counts = recent.select(F.explode(tabs).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))
    names = items.sparkSession.createDataFrame([(slug,) for slug, _, _ in K.CATEGORIES[1:]], "slug string")
    return names.join(counts, "slug", "left").select("slug", F.least(F.coalesce("n", F.lit(0)), F.lit(K.TAB_COUNT_CAP)).alias("n"))


def tab_of(topics: Column) -> Column:
    """First tab, in tab order, that shares a topic; null when none does."""
    return F.get(F.filter(slugs_of(topics), lambda s: s != K.CATEGORIES[0][0]), F.lit(0))
