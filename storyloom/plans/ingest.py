"""Raw entries to stored items, versions and counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markup import sanitize_html
from ..functions.urls import canonicalize_url
from ..operators import filters as L
from ..operators import upsert as U
from ..operators.clusters import Clustered, cluster_and_verify
from ..operators.increments import cluster_changes
from ..operators.item_store import ItemStore
from ..operators.upsert import Upsert, assign_ids, plan_upsert
from ..session import broadcast_if_small, materialize


def clean_entries(raw: DataFrame, sources: DataFrame, now: Column, taxonomy=None) -> DataFrame:
    """Raw entries joined to their source, filtered, and turned into item content. ``ord`` passes through."""
    c = F.col
    policy = sources.select(
        c("id").alias("source_id"), "source_class", "credibility_tier", "named_author_required", "topic_hints"
    )
    rows = raw.join(broadcast_if_small(policy), "source_id").filter(
        L.has_named_author(c("named_author_required"), c("author"))
        & L.is_young_enough(c("published_at"), c("source_class"), now)
        & L.not_far_future(c("published_at"), now)
    )
    author = T.trim_all(c("author"))
    rows = rows.select(
        "source_id", "guid", "ord", F.when(author != "", author).alias("author"),
        T.strip_html(c("title")).alias("title"), T.trim_all(c("url")).alias("url"),
        canonicalize_url(F.coalesce("canonical_url", "url")).alias("canonical_url"),
        T.make_excerpt(c("excerpt"), c("content_html")).alias("excerpt"),
        sanitize_html(F.when(c("content_html") != "", c("content_html"))).alias("content_html"), "image_url",
        L.clamp_to_now(c("published_at"), now).alias("published_at"), c("updated_at").alias("source_updated_at"),
        F.coalesce("status_hint", F.lit("active")).alias("status"), "correction_note", "topic_hints",
        c("title").alias("raw_title"),
        F.when(c("credibility_tier") == "social", "unconfirmed").otherwise("reported").alias("verification_status"),
    )
    return rows.select(
        "source_id", "guid", "ord", "author", "title", "url", "canonical_url", "excerpt", "content_html", "image_url",
        "published_at", "source_updated_at",
        T.fingerprint(
            c("title"), c("excerpt"), c("content_html"), c("canonical_url"), c("status"), T.iso_millis(c("source_updated_at"))
        ).alias("content_fingerprint"),
        T.count_words(c("content_html")).alias("word_count"), "status", "correction_note",
        T.classify(c("raw_title"), c("excerpt"), c("topic_hints"), taxonomy).alias("topics"), "verification_status",
    )


class Ingest(NamedTuple):
    rows: DataFrame
    versions: DataFrame
    stats: DataFrame


def ingest_entries(raw: DataFrame, sources: DataFrame, items: DataFrame, now: Column, taxonomy=None) -> Ingest:
    """The whole ingest step. ``raw`` carries its arrival order in ``ord``."""
    cleaned = clean_entries(raw, sources, now, taxonomy)
    plan: Upsert = plan_upsert(items, cleaned, now, cut=lambda df: materialize(df, "upsert"))
    return Ingest(assign_ids(plan.rows, items), plan.versions, _counts(raw, plan.rows))


def _counts(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """Per source: entries fetched, and items inserted and updated."""
    counts = rows.groupBy("source_id").agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.sum("n_changed").alias("updated"))
    fetched = raw.groupBy("source_id").agg(F.count("*").alias("fetched"))
    return fetched.join(counts, "source_id", "left").na.fill(0, ["inserted", "updated"])


class IngestRun(NamedTuple):
    sources: DataFrame  # registry after sync, with the fetch state after this run
    rows: DataFrame  # touched items in their new form, with ``action``
    versions: DataFrame  # what changed items looked like before
    stats: DataFrame  # per source and in total: fetched, inserted, updated, errors
    errors: DataFrame  # source, message of failed fetches
    clustered: Clustered | None  # None if nothing was inserted or changed


def synced_sources(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry's policy on the stored sources; sources that are new get ids above the stored ones."""
    merged = materialize(U.sync_registry(stored, registry), "sources")
    partitions = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    fresh = merged.filter("id IS NULL").repartitionByRange(partitions, "feed_url").sortWithinPartitions("feed_url")
    return merged.filter("id IS NOT NULL").unionByName(fresh.withColumn("id", top + 1 + F.monotonically_increasing_id()))


class _Due(NamedTuple):
    sources: DataFrame  # the registry after sync
    raw: DataFrame  # landed entries of due sources
    attempts: DataFrame  # their fetches, with the source's name


def _due(registry: DataFrame, sources: DataFrame, raw: DataFrame, attempts: DataFrame, now: Column) -> _Due:
    c = F.col
    known = materialize(synced_sources(sources, registry), "sources")
    due = broadcast_if_small(L.due_sources(L.active_sources(known), now).select(c("id").alias("source_id")))
    names = known.select(c("id").alias("source_id"), c("name").alias("source"))
    tried = attempts.join(due, "source_id", "left_semi").join(names, "source_id", "left")
    return _Due(known, raw.join(due, "source_id", "left_semi"), tried)


def _run(due: _Due, rows: DataFrame, versions: DataFrame, stats: DataFrame, cluster) -> IngestRun:
    tried = due.attempts.join(stats, "source_id", "left").na.fill(0, ["fetched", "inserted", "updated"])
    tried = materialize(tried, "attempts")
    clustered = cluster() if rows.filter("action <> 'seen'").limit(1).count() else None
    return IngestRun(U.fetch_ledger(due.sources, tried), rows, versions, U.ingest_stats(tried), U.ingest_errors(tried), clustered)


def ingest_run(
    registry: DataFrame, sources: DataFrame, raw: DataFrame, attempts: DataFrame, items: DataFrame, clusters: DataFrame, now: Column, taxonomy=None
) -> IngestRun:
    """One whole run: sync the registry, take what due sources landed, upsert it, keep the ledger, cluster on change.

    ``attempts``: source_id, at, error, not_modified of the fetches. Entries and attempts of sources that are not
    active or not due are left out.
    """
    due = _due(registry, sources, raw, attempts, now)
    done = ingest_entries(due.raw, due.sources, items, now, taxonomy)
    rows, stats = materialize(done.rows, "rows"), materialize(done.stats, "stats")
    return _run(due, rows, done.versions, stats, lambda: cluster_and_verify(U.apply_upsert(items, rows), due.sources, clusters, now))


def ingest_run_into(
    store: ItemStore, registry: DataFrame, sources: DataFrame, raw: DataFrame, attempts: DataFrame, now: Column, taxonomy=None, number: int | None = None
) -> IngestRun:
    """As ``ingest_run``, into an item store: keys, bodies and clusters of what landed are looked up, nothing else is read.

    With a ``number`` the upsert of a run that is tried again is not repeated; its counts then are zero.
    """
    due = _due(registry, sources, raw, attempts, now)
    entries = materialize(clean_entries(due.raw, due.sources, now, taxonomy), "entries")
    done = store.upsert(entries.limit(0) if number is not None and store.has_done(number) else entries, now, number)
    stats = materialize(_counts(due.raw, done.rows), "stats")
    return _run(due, done.rows, done.versions, stats, lambda: cluster_changes(store, due.sources, now))
