"""Same-story clusters and corroboration."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import cluster_key
from ..session import broadcast_if_small, materialize
from .filters import since
from .similarity import HOT_BUCKET, best_matches

# Halving distances: enough for any number of items that a long can count.
MAX_ROUNDS = 64


class Clustered(NamedTuple):
    members: DataFrame  # id, cluster_id of newly clustered items
    clusters: DataFrame  # id, key, title, created_at of new clusters
    verified: DataFrame  # id, verification_status of every item in the window


def blocked_items(edges: DataFrame) -> DataFrame:
    """Items that were given a cluster, as somebody's match, before their own turn came.

    Taken in id order, an item acts on its best match unless an acting item with a lower id already chose it.
    Only edges to a higher id can block, so they form a forest: an item acts exactly when none of its children
    does. Each round settles items without open children (rake); an item with one open child is the opposite of
    it, and such links are composed by pointer jumping (compress). So chains of any length take logarithmically
    many rounds.
    """
    c = F.col
    up = materialize(edges.filter("match_id > id AND match_cluster IS NULL").select("id", "match_id"), "up-edges")
    # link, flip: this item acts exactly when the linked one acts (flip: does not act).
    state = up.select("id", c("match_id").alias("parent"), F.lit(None).cast("bigint").alias("link"), F.lit(False).alias("flip"))
    settled = state.select("id", "parent", F.lit(None).cast("boolean").alias("acting")).limit(0)
    acting = settled.select("id")
    while True:
        told = settled.select(c("id").alias("link"), c("acting").alias("told"))
        chosen = settled.filter("acting").select(c("parent").alias("id"), F.lit(True).alias("chosen")).distinct()
        children = state.groupBy("parent").agg(F.count("*").alias("open"), F.min("id").alias("child")).withColumnRenamed("parent", "id")
        seen = state.join(told, "link", "left").join(chosen, "id", "left").join(children, "id", "left")
        decided = F.when(c("chosen"), False).when(c("told").isNotNull(), c("told") != c("flip")).when(c("open").isNull(), True)
        fresh = c("link").isNull() & (c("open") == 1)
        round_ = materialize(
            seen.select(
                "id", "parent", F.coalesce("link", F.when(c("open") == 1, c("child"))).alias("link"),
                F.when(fresh, True).otherwise(c("flip")).alias("flip"), decided.alias("acting"),
            ),
            "cluster-round",
        )
        settled = round_.filter("acting IS NOT NULL").select("id", "parent", "acting")
        acting = acting.unionByName(settled.filter("acting").select("id"))
        left = round_.filter("acting IS NULL").drop("acting")
        ahead = left.filter("link IS NOT NULL").select(c("id").alias("link"), c("link").alias("next"), c("flip").alias("next_flip"))
        jumped = left.join(ahead, "link", "left").select(
            "id", "parent", F.coalesce("next", "link").alias("link"), (c("flip") != F.coalesce("next_flip", F.lit(False))).alias("flip")
        )
        state = materialize(jumped, "cluster-state")
        if state.limit(1).count() == 0:
            return up.join(acting, "id", "left_semi").select(c("match_id").alias("id")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(id, root, cluster) for every node with an outgoing edge, by pointer jumping.

    ``edges``: id, parent, cluster (the parent's existing cluster, which ends the walk). Each round halves the
    distance; parents are looked up once per distinct parent.
    """
    state = materialize(edges, "walk")
    for _ in range(MAX_ROUNDS):
        step = state.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("cluster").alias("next_cluster"))
        wanted = state.filter("cluster IS NULL").select("parent").distinct()
        ahead = materialize(wanted.join(step, "parent"), "ahead")
        if ahead.limit(1).count() == 0:
            return state.select("id", F.col("parent").alias("root"), "cluster")
        state = materialize(
            state.join(ahead, "parent", "left").select(
                "id", F.when(F.col("cluster").isNull(), F.coalesce("next", "parent")).otherwise(F.col("parent")).alias("parent"),
                F.coalesce("cluster", "next_cluster").alias("cluster"),
            ),
            "walk",
        )
    raise RuntimeError(f"cluster roots did not settle in {MAX_ROUNDS} rounds")


def assign_clusters(items: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(id, root, cluster): newly clustered items with the root item of their tree and, if any, its existing cluster."""
    return assign_matched(best_matches(items, hot_bucket))


def assign_matched(matches: DataFrame) -> DataFrame:
    """As ``assign_clusters``, from the best matches of the items."""
    matches = materialize(matches.filter("cluster_id IS NULL"), "matches")
    blocked = blocked_items(matches)
    acting = matches.join(blocked, "id", "left_anti").select("id", F.col("match_id").alias("parent"), F.col("match_cluster").alias("cluster"))
    walked = roots(acting)
    founders = walked.filter("cluster IS NULL").select(F.col("root").alias("id")).distinct()
    return walked.unionByName(founders.select("id", F.col("id").alias("root"), F.lit(None).cast("bigint").alias("cluster")))


def cluster_groups(items: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(id, group_key): clustered items, keyed by existing cluster or by the lowest member of a new one."""
    found = materialize(assign_clusters(items, hot_bucket), "groups")
    lowest = found.filter("cluster IS NULL").groupBy("root").agg(F.min("id").alias("low"))
    fresh = found.filter("cluster IS NULL").join(lowest, "root").select("id", F.concat(F.lit("new-"), "low").alias("group_key"))
    joined = found.filter("cluster IS NOT NULL").select("id", F.concat(F.lit("old-"), "cluster").alias("group_key"))
    before = items.filter("cluster_id IS NOT NULL").select("id", F.concat(F.lit("old-"), "cluster_id").alias("group_key"))
    return fresh.unionByName(joined).unionByName(before)


def number_clusters(found: DataFrame, items: DataFrame, clusters: DataFrame, now: Column, partitions: int | None = None):
    """Ids above every stored cluster for the new ones; returns (members, new clusters)."""
    partitions = partitions or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    new = (
        found.filter("cluster IS NULL").select("root").distinct().repartitionByRange(partitions, "root")
        .sortWithinPartitions("root").withColumn("new_id", top + 1 + F.monotonically_increasing_id())
    )
    new = materialize(new, "new-clusters")
    titled = new.join(items.select(F.col("id").alias("root"), "title"), "root").select(
        F.col("new_id").alias("id"), cluster_key(F.col("title")).alias("key"), "title", now.alias("created_at")
    )
    members = found.join(new, "root", "left").select("id", F.coalesce("cluster", "new_id").alias("cluster_id"))
    return members, titled


def verification(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, verification_status) from the editorial families that cover the same cluster.

    Two families differ exactly when the least and the greatest name differ, so a cluster of any size is four
    values and no set is ever collected.
    """
    c = F.col
    tiers = broadcast_if_small(sources.select(c("id").alias("source_id"), "credibility_tier", "source_family"))
    rows = items.select("id", "source_id", "cluster_id").join(tiers, "source_id")
    outlet = F.when(c("credibility_tier") != "social", c("source_family"))
    groups = rows.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(
        F.min("source_family").alias("lo"), F.max("source_family").alias("hi"),
        F.min(outlet).alias("outlet_lo"), F.max(outlet).alias("outlet_hi"),
    )
    social = c("credibility_tier") == "social"
    independent = (c("outlet_lo") != c("source_family")) | (c("outlet_hi") != c("source_family"))
    confirmed = (c("lo") != c("hi")) & (~social | F.coalesce(independent, F.lit(False)))
    # Items without a cluster have nothing to look up, so they stay out of the join.
    alone = rows.filter("cluster_id IS NULL").withColumns({n: F.lit(None).cast("string") for n in ("lo", "hi", "outlet_lo", "outlet_hi")})
    joined = rows.filter("cluster_id IS NOT NULL").join(groups, "cluster_id")
    return joined.unionByName(alone.select(*joined.columns)).select(
        "id",
        F.when(F.coalesce(confirmed, F.lit(False)), "corroborated").when(social, "unconfirmed").otherwise("reported").alias("verification_status"),
    )


def cluster_and_verify(items: DataFrame, sources: DataFrame, clusters: DataFrame, now: Column, hot_bucket: int = HOT_BUCKET) -> Clustered:
    """Cluster the items of the last 72 hours and re-verify all of them."""
    recent = since(items, "published_at", now, f"{K.CLUSTER_WINDOW_HOURS} hours").select(
        "id", "source_id", "title", "canonical_url", "cluster_id"
    )
    found = materialize(assign_clusters(recent, hot_bucket), "assigned")
    members, new = number_clusters(found, recent, clusters, now)
    members = materialize(members, "members")
    current = recent.join(members.withColumnRenamed("cluster_id", "joined"), "id", "left").select(
        "id", "source_id", F.coalesce("cluster_id", "joined").alias("cluster_id")
    )
    return Clustered(members, new, verification(current, sources))
