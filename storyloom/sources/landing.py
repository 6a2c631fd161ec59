"""Incremental reading of landed payloads: cursors, unchanged payloads, reposts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def original_posts(posts: DataFrame) -> DataFrame:
    """Neither reposts nor replies."""
    return posts.filter(~F.coalesce("is_repost", F.lit(False)) & ~F.coalesce("is_reply", F.lit(False)))


def newer_than_cursor(posts: DataFrame, cursors: DataFrame, cap: int | None = None) -> DataFrame:
    """Per source, the posts past the stored cursor; with a ``cap`` the oldest so many.

    The oldest come first so that a cursor advanced over what was kept has passed nothing that was not.
    """
    fresh = posts.join(cursors.select("source_id", "last_id"), "source_id", "left").filter(
        F.col("last_id").isNull() | (F.col("post_id") > F.col("last_id"))
    )
    if cap is None:
        return fresh.drop("last_id")
    oldest = Window.partitionBy("source_id").orderBy("post_id")
    return fresh.withColumn("n", F.row_number().over(oldest)).filter(F.col("n") <= cap).drop("n", "last_id")


def advance_cursors(cursors: DataFrame, posts: DataFrame) -> DataFrame:
    """The largest id seen per source, kept where nothing new arrived."""
    seen = posts.groupBy("source_id").agg(F.max("post_id").alias("newest"))
    return cursors.join(seen, "source_id", "full_outer").select(
        "source_id", F.greatest("last_id", "newest").alias("last_id")
    )


def changed_payloads(fetched: DataFrame, ledger: DataFrame) -> DataFrame:
    """Fetched payloads whose digest differs from the last one stored for the source."""
    digest = fetched.withColumn("digest", F.sha2("payload", 256))
    return digest.join(ledger.select("source_id", "digest"), ["source_id", "digest"], "left_anti")
