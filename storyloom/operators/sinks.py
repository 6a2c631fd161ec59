"""Parquet sinks: items by publication date, and the normalised delivery payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.feeds import Worlds
from ..session import broadcast_if_small, materialize
from .upsert import DATE, ITEM_COLUMNS, KEY


def _dated(items: DataFrame) -> DataFrame:
    return items.select(*ITEM_COLUMNS).withColumn(DATE, F.to_date("published_at"))


def _spread(rows: DataFrame) -> DataFrame:
    """By date, where AQE splits a large date over many tasks and puts small ones together, by size."""
    return rows.hint("rebalance", DATE)


def write_items(items: DataFrame, path: str) -> None:
    """A fresh item table, one directory per publication date."""
    _spread(_dated(items)).write.partitionBy(DATE).mode("overwrite").parquet(path)


def read_items_table(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def rewrite_touched(path: str, rows: DataFrame) -> None:
    """Merge upserted rows into the item table, rewriting only the dates that lose or gain a row.

    A changed date moves a row between directories, so the old dates come from a key-only scan. The new content
    is staged in the shared folder first, because a job must not overwrite what it still reads; the final
    overwrite replaces exactly the touched directories, and can be repeated from the stage.
    """
    spark = rows.sparkSession
    stored = spark.read.parquet(path)
    fresh = _dated(rows)
    old_dates = stored.select(*KEY, DATE).join(fresh.select(*KEY), KEY, "left_semi").select(DATE)
    dates = materialize(old_dates.unionByName(fresh.select(DATE)).distinct(), "touched-dates")
    kept = stored.join(broadcast_if_small(dates), DATE, "left_semi").join(fresh.select(*KEY), KEY, "left_anti")
    staged = materialize(kept.select(*fresh.columns).unionByName(fresh), "touched-items")
    _spread(staged).write.option("partitionOverwriteMode", "dynamic").partitionBy(DATE).mode("overwrite").parquet(path)


def append_versions(versions: DataFrame, path: str) -> None:
    versions.withColumn("captured_date", F.to_date("captured_at")).write.partitionBy("captured_date").mode("append").parquet(path)


def write_worlds(worlds: Worlds, path: str) -> None:
    """World rows carry only story ids; every story is written once per profile."""
    worlds.worlds.drop("entries").write.mode("overwrite").parquet(f"{path}/worlds")
    worlds.world_entries.write.mode("overwrite").parquet(f"{path}/world_entries")
    worlds.stories.write.mode("overwrite").parquet(f"{path}/stories")
    worlds.readers.write.mode("overwrite").parquet(f"{path}/readers")
    worlds.freshness.write.mode("overwrite").parquet(f"{path}/freshness")
