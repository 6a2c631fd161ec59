"""Registered queries against their SQL on the smallest tables, and the item table sink."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from storyloom import demo
from storyloom.operators import sinks, upsert

SF = "/root/testdata/sf0.001"
NAMES = [
    "canonical_urls", "html_text", "excerpts", "feed_entries", "bluesky_posts", "clean_entries", "item_upsert", "item_versions",
    "saved_items", "repaired_saves", "reader_affinities", "best_matches_crowded", "verification", "reader_feeds", "visible_stories", "stream_affinities",
]


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    result, _, _ = compare.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert result.startswith("ok"), result


def test_names_and_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rewrite_touched_dates(spark, tmp_path):
    path = str(tmp_path / "items")
    items = demo.items(spark, SF).withColumn("id", F.col("id"))
    sinks.write_items(items.filter("id % 3 <> 0"), path)
    stored = spark.read.parquet(path)
    batch = items.filter("id % 2 = 0").withColumns({"ord": F.col("id"), "content_fingerprint": F.lit("new"), "published_at": F.col("published_at") - F.expr("interval 1 day")})
    plan = upsert.plan_upsert(stored, batch, demo.now())
    rows = upsert.assign_ids(plan.rows, stored)
    n_before, expected = stored.count(), stored.select("guid").union(batch.select("guid")).distinct().count()
    sinks.rewrite_touched(path, rows)
    after = spark.read.parquet(path)
    assert n_before < after.count() == expected == after.select("guid").distinct().count()
    assert after.filter("content_fingerprint = 'new'").count() == batch.count()


def test_stored_table_is_pruned(spark, tmp_path):
    """Windows read only their dates; key look-ups read no bodies."""
    path = str(tmp_path / "items")
    sinks.write_items(demo.items(spark, SF), path)
    stored = spark.read.parquet(path)

    def plan(df):
        return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    from storyloom.operators.filters import since

    recent = since(stored, "published_at", demo.now(), "1 day")
    assert "PartitionFilters: [isnotnull(published_date" in plan(recent)
    assert recent.count() == demo.items(spark, SF).filter(F.col("published_at") >= demo.now() - F.expr("interval 1 day")).count()
    batch = demo.items(spark, SF).filter("id = 5").withColumns({"ord": F.col("id"), "content_fingerprint": F.lit("new")})
    scans = []
    touched = upsert.touched_items(stored, batch.select(*upsert.KEY).distinct(), cut=lambda df: scans.append(plan(df)) or df)
    assert "content_html" not in scans[0].split("ReadSchema")[1].split("\n")[0]
    assert [r.id for r in touched.collect()] == [5]
    plain = upsert.plan_upsert(demo.items(spark, SF), batch, demo.now()).rows
    assert upsert.plan_upsert(stored, batch, demo.now()).rows.select("guid", "action").collect() == plain.select("guid", "action").collect()


def test_versions_and_worlds_sinks(spark, tmp_path):
    from storyloom.checks.readers import tables
    from storyloom.plans import feeds

    items = demo.items(spark, SF)
    batch = items.filter("id % 4 = 0").withColumns({"ord": F.col("id"), "content_fingerprint": F.lit("new")})
    versions = upsert.plan_upsert(items, batch, demo.now()).versions
    for _ in range(2):
        sinks.append_versions(versions, str(tmp_path / "versions"))
    assert spark.read.parquet(str(tmp_path / "versions")).count() == 2 * versions.count() > 0
    worlds = feeds.worlds_job(tables(spark, SF), demo.now())
    sinks.write_worlds(worlds, str(tmp_path / "payload"))
    read = {n: spark.read.parquet(str(tmp_path / "payload" / n)) for n in ("worlds", "world_entries", "stories", "readers", "freshness")}
    assert read["world_entries"].count() == worlds.world_entries.count() and "entries" not in read["worlds"].columns
    assert read["stories"].groupBy("profile_id", "id").count().filter("count > 1").count() == 0
