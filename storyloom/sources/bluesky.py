"""Bluesky author feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .raw import parse_date, raw_items

FEED_SCHEMA = (
    "feed array<struct<reason:string, post:struct<uri:string, author:struct<handle:string,displayName:string>,"
    " record:struct<text:string,createdAt:string,reply:string>,"
    " embed:struct<external:struct<uri:string,title:string,description:string,thumb:string>>>>>"
)


def parse_author_feeds(payloads: DataFrame, drop_replies: bool = False) -> DataFrame:
    """(source_id, handle, payload) feed JSON to raw items: the account's own words, no reposts."""
    p = (
        payloads.select("source_id", "handle", F.explode(F.from_json("payload", FEED_SCHEMA)["feed"]).alias("entry"))
        .filter(F.col("entry.reason").isNull() & (F.col("entry.post.author.handle") == F.col("handle")))
        .select("source_id", "handle", "entry.post.*")
    )
    if drop_replies:
        p = p.filter(F.col("record.reply").isNull())
    c = F.col
    p = (
        p.select(
            "source_id", "handle", "uri", "author", c("embed.external").alias("link"),
            T.trim_all(c("record.text")).alias("said"), parse_date(c("record.createdAt")).alias("published_at"),
            F.element_at(F.split("uri", "/"), -1).alias("key"),
        )
        .filter((c("said") != "") & c("published_at").isNotNull() & (c("key") != ""))
        .withColumn("text", T.bind(T.strip_urls(c("said")), lambda t: F.when(t != "", t).otherwise(c("said"))))
    )
    described = T.trim_all(c("link.description"))
    return raw_items(
        p, source_id=c("source_id"), guid=c("uri"), title=T.shorten(c("text"), K.BLUESKY_TITLE_CHARS),
        url=F.concat(F.lit("https://bsky.app/profile/"), c("author.handle"), F.lit("/post/"), c("key")),
        canonical_url=F.when(c("link.uri") != "", c("link.uri")),
        author=F.coalesce(c("author.displayName"), c("author.handle")),
        excerpt=F.when(described != "", described),
        content_html=T.post_html(c("text"), c("link.uri"), c("link.title")), image_url=c("link.thumb"),
        published_at=c("published_at"),
    )
