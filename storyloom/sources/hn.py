"""Hacker News stories and front-page lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .raw import raw_items

STORY_SCHEMA = (
    "id bigint, type string, title string, url string, `by` string, time bigint, score bigint, descendants bigint,"
    " dead boolean, deleted boolean"
)


def parse_stories(payloads: DataFrame) -> DataFrame:
    """(source_id, payload) story JSON to raw items; only live stories over the score bar."""
    s = payloads.select("source_id", F.from_json("payload", STORY_SCHEMA).alias("s")).select("source_id", "s.*")
    live = ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)) & (F.col("type") == "story")
    s = s.filter(live & (F.col("title") != "") & (F.col("time") != 0) & (F.coalesce("score", F.lit(0)) >= K.HN_MIN_SCORE))
    thread = F.concat(F.lit("https://news.ycombinator.com/item?id="), "id")
    return raw_items(
        s, source_id=F.col("source_id"), guid=F.concat(F.lit("hn-"), "id"), title=F.col("title"),
        url=F.coalesce("url", thread), author=F.col("by"),
        excerpt=F.concat("score", F.lit(" points · "), F.coalesce("descendants", F.lit(0)), F.lit(" comments on Hacker News")),
        published_at=F.timestamp_seconds("time"),
    )


def front_page(lists: DataFrame, stories: DataFrame, top_n: int = K.HN_TOP_N) -> DataFrame:
    """Stories named in the first ``top_n`` places of a list, with their place."""
    places = lists.select("list_id", F.posexplode(F.slice("ids", 1, top_n)).alias("place", "id"))
    return places.join(stories, "id")
