"""One-off repairs: duplicate item keys with remapped references, and column backfills."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Repaired(NamedTuple):
    items: DataFrame
    signals: DataFrame
    saves: DataFrame


def keepers(items: DataFrame) -> DataFrame:
    """(id, keeper_id) of every item that shares its key with a newer one.

    The newest id per key is a map-side aggregate, so many copies of one key never meet in one task.
    """
    newest = items.groupBy("source_id", "guid").agg(F.max("id").alias("keeper_id"), F.count("*").alias("n"))
    return (
        items.select("id", "source_id", "guid").join(newest.filter("n > 1"), ["source_id", "guid"])
        .filter("id <> keeper_id").select("id", "keeper_id")
    )


def repair_duplicates(items: DataFrame, signals: DataFrame, saves: DataFrame) -> Repaired:
    """Keep the newest item per key; signals follow it, saves merge into it with the earliest time."""
    moved = keepers(items)
    target = moved.select(F.col("id").alias("item_id"), "keeper_id")
    new_signals = signals.join(target, "item_id", "left").withColumn(
        "item_id", F.coalesce("keeper_id", "item_id")
    ).drop("keeper_id").select(*signals.columns)
    tagged = saves.join(target, "item_id", "left")
    own = F.col("keeper_id").isNull()
    # A save already on the keeper wins over merged ones, whatever its time.
    new_saves = (
        tagged.groupBy("profile_id", F.coalesce("keeper_id", "item_id").alias("item_id"))
        .agg(F.coalesce(F.min(F.when(own, F.col("created_at"))), F.min("created_at")).alias("created_at"))
    )
    return Repaired(items.join(moved.select("id"), "id", "left_anti"), new_signals, new_saves)


def backfill_word_count(items: DataFrame) -> DataFrame:
    plain = F.length(F.regexp_replace("content_html", "<[^>]+>", " "))
    estimate = F.greatest(F.lit(1), F.floor(plain / 6).cast("int"))
    return items.withColumn(
        "word_count", F.when(F.length("content_html") > 500, estimate).otherwise(F.col("word_count"))
    )


def backfill_fetch_times(sources: DataFrame, now: Column) -> DataFrame:
    fetched = F.col("last_fetched_at").isNotNull()
    return sources.withColumns(
        {
            "last_successful_fetch_at": F.when(fetched, F.col("last_fetched_at")).otherwise(F.col("last_successful_fetch_at")),
            "next_fetch_at": F.when(fetched, now).otherwise(F.col("next_fetch_at")),
        }
    )
