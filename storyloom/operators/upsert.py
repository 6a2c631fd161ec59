"""Keyed upserts: items with version history, the source registry and the fetch ledger."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import broadcast_if_small, materialize

KEY = ["source_id", "guid"]
CONTENT = [
    "author", "title", "url", "canonical_url", "excerpt", "content_html", "image_url", "published_at",
    "source_updated_at", "content_fingerprint", "word_count", "status", "correction_note", "topics",
]
ITEM_COLUMNS = [
    "id", "source_id", "guid", *CONTENT, "fetched_at", "updated_at", "first_seen_at", "last_seen_at",
    "verification_status", "cluster_id",
]


class Upsert(NamedTuple):
    rows: DataFrame  # every touched item in its new form, plus `action` and `n_changed`
    versions: DataFrame  # what changed items looked like before


#: The partition column of a stored item table.
DATE = "published_date"


def touched_items(existing: DataFrame, keys: DataFrame, cut=lambda df: df) -> DataFrame:
    """The stored rows of the keys, in all item columns.

    In a table with a date partition the keys are looked up in a scan of key columns only; whole rows are then
    read from the dates that hold one, and no body of another date is touched.
    """
    if DATE in existing.columns:
        found = cut(existing.select(*KEY, DATE).join(keys, KEY, "left_semi"))
        dates = found.select(DATE).distinct()
        existing = existing.join(broadcast_if_small(dates), DATE, "left_semi")
    return existing.select(*ITEM_COLUMNS).join(keys, KEY, "left_semi")


def plan_upsert(existing: DataFrame, batch: DataFrame, now: Column, cut=lambda df: df) -> Upsert:
    """Fold a batch (with its order in ``ord``) into the items it touches.

    A new key takes its first row. A known key takes its last row that differs from what is stored; it then
    loses its cluster and leaves a version behind. Only touched keys come out, so the cost follows the batch.
    Copies of one entry collapse before the shuffle. ``cut`` may store the merged rows, since several outputs
    read them.
    """
    row = F.struct(*CONTENT, "verification_status")
    copies = batch.groupBy(*KEY, "content_fingerprint").agg(
        F.min_by(row, "ord").alias("first"), F.min("ord").alias("first_ord"),
        F.max_by(row, "ord").alias("last"), F.max("ord").alias("last_ord"), F.count("*").alias("n"),
    ).withColumnRenamed("content_fingerprint", "fp")
    keys = copies.select(*KEY).distinct()
    old = touched_items(existing, keys, cut).select(*KEY, F.struct(*[c for c in ITEM_COLUMNS if c not in KEY]).alias("old"))
    differs = F.col("old").isNotNull() & (F.col("fp") != F.col("old.content_fingerprint"))
    merged = (
        copies.join(old, KEY, "left").groupBy(*KEY)
        .agg(
            F.first("old").alias("old"),
            F.min_by("first", "first_ord").alias("fresh"), F.min("first_ord").alias("ord"),
            F.max_by(F.when(differs, F.col("last")), F.when(differs, F.col("last_ord"))).alias("change"),
            F.sum(F.when(differs, F.col("n")).otherwise(0)).alias("n_changed"),
        )
    )
    merged = cut(merged)
    c = F.col
    is_new, is_changed = c("old").isNull(), c("change").isNotNull()
    action = F.when(is_new, "insert").when(is_changed, "update").otherwise("seen")
    new_status = F.when(
        (c("old.content_fingerprint") != "") & (c("change.status") == "active"), F.lit("updated")
    ).otherwise(c("change.status"))

    def content(name: str) -> Column:
        changed = new_status if name == "status" else c(f"change.{name}")
        return F.when(is_new, c(f"fresh.{name}")).when(is_changed, changed).otherwise(c(f"old.{name}")).alias(name)

    def kept(name: str, initial: Column) -> Column:
        return F.when(is_new, initial).otherwise(c(f"old.{name}")).alias(name)

    rows = merged.select(
        c("old.id").alias("id"), *KEY, *[content(name) for name in CONTENT],
        kept("fetched_at", now),
        F.when(is_new | is_changed, now).otherwise(c("old.updated_at")).alias("updated_at"),
        kept("first_seen_at", now), now.alias("last_seen_at"),
        kept("verification_status", c("fresh.verification_status")),
        F.when(~is_new & ~is_changed, c("old.cluster_id")).alias("cluster_id"),
        action.alias("action"), "n_changed", "ord",
    )
    # One snapshot per changed row of the batch, taken from the stored form.
    stored = (c("old.content_fingerprint") != "") & is_changed
    versions = merged.filter(stored).select(
        c("old.id").alias("item_id"), c("old.title").alias("title"), c("old.excerpt").alias("excerpt"),
        c("old.content_fingerprint").alias("content_fingerprint"), c("old.status").alias("status"),
        now.alias("captured_at"), F.explode(F.sequence(F.lit(1), c("n_changed").cast("int"))).alias("copy"),
    ).drop("copy")
    return Upsert(rows, versions)


def assign_ids(rows: DataFrame, existing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give inserted rows ids above every stored one, in batch order. Ids have gaps; equal inputs give equal ids.

    Only keys are sorted and numbered; the rows get their number by a join.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    inserted = rows.filter("action = 'insert'")
    numbered = (
        inserted.select("ord", *KEY).repartitionByRange(partitions, "ord", *KEY).sortWithinPartitions("ord", *KEY)
        .select(*KEY, (top + 1 + F.monotonically_increasing_id()).alias("new_id"))
    )
    fresh = inserted.join(numbered, KEY).withColumn("id", F.col("new_id")).drop("new_id").select(*rows.columns)
    return fresh.unionByName(rows.filter("action <> 'insert'"))


def dense_ids(rows: DataFrame, top: int, order: list[str], name: str = "new_id") -> DataFrame:
    """The ``order`` columns of the rows and a number above ``top``, without gaps, in their order.

    The rows are sorted over many tasks; how many each holds, one count a task, shifts its numbers.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*order).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(placed.select(*order, F.spark_partition_id().alias("__task"), in_task.alias("__place")), "numbered")
    starts, at = [], top + 1
    for r in placed.groupBy("__task").agg(F.count("*").alias("n")).orderBy("__task").collect():
        starts.append((r["__task"], at))
        at += r.n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__task int, __start bigint"))
    return placed.join(starts, "__task").select(*order, (F.col("__start") + F.col("__place")).alias(name))


def apply_upsert(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole table after the upsert: untouched rows plus the touched ones. A date partition column stays one."""
    fresh, columns = rows.select(*ITEM_COLUMNS), ITEM_COLUMNS
    if DATE in existing.columns:
        fresh, columns = fresh.withColumn(DATE, F.to_date("published_at")), [*ITEM_COLUMNS, DATE]
    untouched = existing.join(rows.select(*KEY), KEY, "left_anti").select(*columns)
    return untouched.unionByName(fresh)


def sync_registry(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """Upsert on feed_url: policy columns follow the registry, fetch state and ``active`` stay."""
    policy = [c for c in registry.columns if c != "feed_url"]
    state = [c for c in stored.columns if c not in policy and c not in ("feed_url", "active")]
    new = registry.select("feed_url", F.struct(*policy).alias("new"))
    old = stored.select("feed_url", F.struct(*policy, *state, "active").alias("old"))
    both = old.join(new, "feed_url", "full_outer")
    return both.select(
        "feed_url",
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{p}")).otherwise(F.col(f"old.{p}")).alias(p) for p in policy],
        *[F.col(f"old.{s}").alias(s) for s in state],
        F.coalesce("old.active", F.lit(True)).alias("active"),
    )


def fetch_ledger(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """Source fetch state after the latest attempt of each source.

    ``attempts``: source_id, at, error, not_modified, inserted, updated.
    """
    latest = attempts.groupBy("source_id").agg(
        F.max_by(F.struct("at", "error", "not_modified", "inserted", "updated"), "at").alias("a")
    )
    c = F.col
    failed = c("a.error").isNotNull()
    wait = F.when(failed, F.least(F.lit(K.RETRY_MINUTES), c("poll_interval_minutes"))).otherwise(c("poll_interval_minutes"))
    status = (
        F.when(failed, F.concat(F.lit("error: "), F.substring("a.error", 1, 200)))
        .when(c("a.not_modified"), F.lit("not-modified"))
        .otherwise(F.concat(F.lit("ok:"), c("a.inserted"), F.lit("+"), c("a.updated"), F.lit("u")))
    )
    joined = sources.join(latest, sources["id"] == latest["source_id"], "left")
    tried = c("a").isNotNull()
    return joined.withColumns(
        {
            "last_fetched_at": c("a.at"),
            "last_successful_fetch_at": F.when(tried & ~failed, c("a.at")).otherwise(c("last_successful_fetch_at")),
            "next_fetch_at": F.when(tried, c("a.at") + F.make_dt_interval(mins=wait)).otherwise(c("next_fetch_at")),
            "last_status": F.when(tried, status).otherwise(c("last_status")),
        }
    ).drop("a", "source_id")


def ingest_stats(attempts: DataFrame) -> DataFrame:
    """Fetched, inserted, updated and failed fetches per source, with a total row (null source)."""
    return attempts.rollup("source").agg(
        F.sum("fetched").alias("fetched"), F.sum("inserted").alias("inserted"), F.sum("updated").alias("updated"),
        F.count("error").alias("errors"),
    )


def ingest_errors(attempts: DataFrame) -> DataFrame:
    failed = attempts.filter(F.col("error").isNotNull())
    return failed.select("source", F.concat("source", F.lit(": error: "), "error").alias("message"))
