"""Source policy: tier, editorial family, poll interval and author rule derived from a seed row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .registry_seeds import SEEDS

OPTIONAL = {
    "credibility_tier": "string",
    "source_family": "string",
    "poll_interval_minutes": "int",
    "named_author_required": "boolean",
}


def with_policy(seeds: DataFrame) -> DataFrame:
    """Fill the four policy columns wherever the seed row leaves them null or has no such column."""
    for name, kind in OPTIONAL.items():
        if name not in seeds.columns:
            seeds = seeds.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    families = F.create_map(*[F.lit(x) for kv in K.SOURCE_FAMILIES.items() for x in kv])
    host = F.regexp_replace(F.lower(F.regexp_extract("homepage_url", "^[a-zA-Z]+://([^/:?#]+)", 1)), "^www\\.", "")
    labels = F.split(host, "\\.")
    from_host = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), "-")
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    social = c("source_class") == "social"
    tier = F.coalesce(
        "credibility_tier",
        F.when(c("name").isin(*K.MAJOR_OUTLETS), "major").when(social, "social").otherwise("independent"),
    )
    seeds = seeds.withColumn("credibility_tier", tier)
    return seeds.withColumns(
        {
            "source_family": F.coalesce(
                "source_family", F.try_element_at(families, c("name")), F.when(host != "", from_host).otherwise(slug)
            ),
            "poll_interval_minutes": F.coalesce(
                "poll_interval_minutes",
                F.when(c("source_class") == "longform", K.POLL_MINUTES_LONGFORM)
                .when((c("credibility_tier") == "major") | social, K.POLL_MINUTES_FAST)
                .otherwise(K.POLL_MINUTES_DEFAULT),
            ),
            "named_author_required": F.coalesce(
                "named_author_required",
                (c("source_class") == "longform") | (social & (c("credibility_tier") == "social")),
            ),
        }
    )


def registry(spark: SparkSession) -> DataFrame:
    """The built-in sources with their policy."""
    schema = (
        "kind string, source_class string, name string, feed_url string, homepage_url string, topic_hints array<string>,"
        " quality_prior double, credibility_tier string, source_family string, poll_interval_minutes int, named_author_required boolean"
    )
    rows = [tuple(row) + (None,) * (11 - len(row)) for row in SEEDS]
    return with_policy(spark.createDataFrame(rows, schema))
