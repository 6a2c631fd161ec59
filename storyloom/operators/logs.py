"""Reader state folded from logs: saves, mutes, profile touches, reads and dwell time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def fold_set(log: DataFrame, keys: list[str], adds: Column, removes: Column) -> DataFrame:
    """Members left after a log of adds and removes; created_at is the first add since the last remove.

    Two partial aggregates over the same keys, so a hot key combines map-side.
    """
    at = F.struct("created_at", "id")
    log = log.filter(adds | removes).withColumns({"_at": at, "_add": adds})
    last = log.groupBy(*keys).agg(F.max(F.when(~F.col("_add"), F.col("_at"))).alias("removed"))
    return (
        log.filter("_add").join(last, keys)
        .filter(F.col("removed").isNull() | (F.col("_at") > F.col("removed")))
        .groupBy(*keys).agg(F.min("created_at").alias("created_at"))
    )


def save_set(signals: DataFrame) -> DataFrame:
    return fold_set(signals, ["profile_id", "item_id"], F.col("type") == "save", F.col("type") == "unsave")


def mute_set(signals: DataFrame, toggles: DataFrame, items: DataFrame) -> DataFrame:
    """Muted sources: ``hide_source`` signals add, explicit toggles (id, profile_id, source_id, muted, created_at) add or remove."""
    hidden = (
        signals.filter("type = 'hide_source'")
        .join(items.select(F.col("id").alias("item_id"), "source_id"), "item_id")
        .select("id", "profile_id", "source_id", F.lit(True).alias("muted"), "created_at")
    )
    log = hidden.unionByName(toggles.select(*hidden.columns))
    return fold_set(log, ["profile_id", "source_id"], F.col("muted"), ~F.col("muted"))


def touch_profiles(profiles: DataFrame, opens: DataFrame) -> DataFrame:
    """last_feed_opened_at moves to the latest open."""
    latest = opens.groupBy("profile_id").agg(F.max("opened_at").alias("opened_at"))
    return profiles.join(latest, "profile_id", "left").withColumn(
        "last_feed_opened_at", F.greatest("last_feed_opened_at", "opened_at")
    ).drop("opened_at")


def new_since(opens: DataFrame) -> DataFrame:
    """For every open, the open before it (what "new" is measured from)."""
    earlier = Window.partitionBy("profile_id").orderBy("opened_at", "id")
    return opens.withColumn("new_since", F.lag("opened_at").over(earlier))


def read_items(signals: DataFrame, now: Column) -> DataFrame:
    """Distinct items each profile opened in the last fourteen days."""
    recent = F.col("created_at") >= now - F.expr(f"interval {K.READ_WINDOW_DAYS} days")
    return signals.filter((F.col("type") == "open") & recent).select("profile_id", "item_id").distinct()


def dwell_times(visibility: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visible seconds per reading, from (profile_id, item_id, ts, visible) events.

    A reading ends after ``gap`` without events; readings under five seconds are not reported. Events of one
    instant are taken in the order of their ids, or hidden before visible where they have none.
    """
    tie = "id" if "id" in visibility.columns else "visible"
    order = Window.partitionBy("profile_id", "item_id").orderBy("ts", tie)
    steps = visibility.withColumn("until", F.lead("ts").over(order))
    seconds = (F.unix_micros("until") - F.unix_micros("ts")) / F.lit(1e6)
    within = F.col("visible") & (F.col("until") < F.col("ts") + F.expr(f"interval {gap}"))
    steps = steps.withColumn("seconds", F.when(within, seconds).otherwise(F.lit(0.0)))
    read = steps.groupBy("profile_id", "item_id", F.session_window("ts", gap).alias("w")).agg(F.sum("seconds").alias("s"))
    whole = F.floor(F.col("s") + 0.5).cast("bigint")
    return read.select("profile_id", "item_id", F.col("w.start").alias("started_at"), whole.alias("seconds")).filter(
        F.col("seconds") >= K.MIN_DWELL_SECONDS
    )
