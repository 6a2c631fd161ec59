"""Clusters kept up to date: only new or changed titles look for matches, among all titles of the window.

After a run every item that has a match in the window is in a cluster. So an item without one can only gain a
match through a title that is new or changed since, and the pairs of such titles with all others, looked at from
both sides, are all that a next run needs. They meet through the rarest tokens of the stored titles; a title
that shares none of these with a new one is not looked at further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import cluster_key
from ..session import broadcast_if_small, materialize
from .clusters import Clustered, assign_matched, verification
from .item_store import ItemStore
from .similarity import HOT_BUCKET, _two_best, matches_among, prefix_of
from .upsert import DATE, dense_ids


def touched_titles(titles: DataFrame, after: int) -> DataFrame:
    """The titles that may match one that changed after a version: those that share a prefix token or an address with one.

    ``fresh`` tells which ones changed.
    """
    titles = titles.withColumn("fresh", F.col("changed") > after)
    new = titles.where("fresh")
    tokens = new.select(F.explode(prefix_of(F.col("ranked"))).alias("token")).distinct()
    near = titles.select("id", F.explode(prefix_of(F.col("ranked"))).alias("token")).join(broadcast_if_small(tokens), "token", "left_semi").select("id")
    urls = new.where("canonical_url <> ''").select("canonical_url").distinct()
    there = titles.select("id", "canonical_url").join(broadcast_if_small(urls), "canonical_url", "left_semi").select("id")
    return titles.join(near.unionByName(there).distinct(), "id", "left_semi")


def fresh_matches(titles: DataFrame, places: DataFrame, after: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """The best match (see ``best_matches``) of every item that a title changed after a version gives one or another.

    ``places`` has ``id`` and ``cluster_id`` of the same items. Rows of items that are in a cluster are not to be used.
    """
    rows = touched_titles(titles, after).join(places.select("id", "cluster_id"), "id")
    rows = materialize(rows.select("id", "source_id", "canonical_url", "cluster_id", "tokens", "ranked", "fresh"), "touched-titles")
    worded = rows.where(F.size("tokens") > 0)
    entries = _two_best(worded.select("tokens", F.lit(1.0).alias("sim"), "id", "source_id", "cluster_id"), "tokens")
    about = worded.groupBy("tokens").agg(F.max("fresh").alias("fresh"), F.first("ranked").alias("ranked"))
    sets = entries.join(about, "tokens").select(F.col("e1.id").alias("set_id"), "tokens", F.size("tokens").alias("n"), "e1", "e2", "ranked", "fresh")
    return matches_among(rows.drop("ranked", "fresh"), materialize(sets, "touched-sets"), hot_bucket)


def cluster_changes(store: ItemStore, sources: DataFrame, now: Column, hot_bucket: int = HOT_BUCKET) -> Clustered:
    """Cluster what changed in the store since the last call, re-verify the window, and commit both.

    Gives the clusters that clustering all items of the last 72 hours anew would give. No body is read: titles
    and places are narrow, and of the window only the sources and clusters are gone through for verification.
    """
    c, at = F.col, store.tables.manifest()
    start = now - F.expr(f"interval {K.CLUSTER_WINDOW_HOURS} hours")
    titles = store.titles(start, at)
    window = store.items(since=start, at=at).select("id", "source_id", "cluster_id", "verification_status", DATE)
    found = materialize(assign_matched(fresh_matches(titles, window, at.facts["clustered"], hot_bucket)), "assigned")
    roots = found.where("cluster IS NULL").select("root").distinct()
    new = materialize(dense_ids(roots, at.facts["top_cluster"], ["root"]), "new-clusters")
    named = titles.select(c("id").alias("root"), "title").join(new, "root")
    named = named.select(c("new_id").alias("id"), cluster_key(c("title")).alias("key"), "title", now.alias("created_at"))
    members = materialize(found.join(new, "root", "left").select("id", F.coalesce("cluster", "new_id").alias("joined")), "members")
    current = window.join(members, "id", "left").withColumn("is", F.coalesce("cluster_id", "joined"))
    status = verification(current.select("id", "source_id", c("is").alias("cluster_id")), sources).withColumnRenamed("verification_status", "now")
    moved = current.join(status, "id").where("joined IS NOT NULL OR NOT verification_status <=> now")
    moved = moved.select("id", c("is").alias("cluster_id"), c("now").alias("verification_status"), DATE)
    top = new.agg(F.max("new_id").alias("top")).first().top
    moved, named = materialize(moved, "moved-places"), materialize(named, "named")
    store.place(moved, named, {"clustered": at.version, "top_cluster": top or at.facts["top_cluster"]})
    return Clustered(members.withColumnRenamed("joined", "cluster_id"), named, moved.select("id", "verification_status"))
