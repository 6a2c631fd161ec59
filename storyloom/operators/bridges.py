"""Stories that span two worlds, and the search index over worlds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def bridges(shown: DataFrame, limit: int = K.BRIDGE_LIMIT) -> DataFrame:
    """Per profile, the stories whose topics fall in two worlds: the first two in topic order, best place first.

    ``shown``: profile_id, ord, rank, id, topics.
    """
    world_of = F.create_map(*[F.lit(x) for slug, _, topics in K.CATEGORIES for t in topics for x in (t, slug)])
    slugs = F.array_distinct(F.filter(F.transform("topics", lambda t: F.try_element_at(world_of, t)), lambda s: s.isNotNull()))
    spanning = shown.withColumn("slugs", slugs).filter(F.size("slugs") >= 2)
    best = spanning.groupBy("profile_id", "id").agg(
        F.min("rank").alias("rank"), F.min(F.struct("ord", "rank")).alias("seen"),
        F.first("slugs").alias("slugs"),
    )
    order = Window.partitionBy("profile_id").orderBy("rank", "seen")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(
        "profile_id", "place", "id", F.col("slugs")[0].alias("a"), F.col("slugs")[1].alias("b"), "rank"
    )


def list_position(world: Column, rank: Column) -> Column:
    """One number that orders by world, then by rank, for lists of any length."""
    return F.shiftleft(world.cast("bigint"), 32) + rank


def search_index(shown: DataFrame, about: tuple[str, ...] = ()) -> DataFrame:
    """Every story once per profile, under the first world that lists it; ``position`` is index order.

    ``about`` columns of ``shown``, such as the title and the source's name, come along for searching.
    """
    return shown.groupBy("profile_id", "id").agg(
        *[F.first(a).alias(a) for a in about], F.min_by("slug", F.struct("ord", "rank")).alias("slug"), F.min(list_position(F.col("ord"), F.col("rank"))).alias("position")
    )
