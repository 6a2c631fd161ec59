"""X recent-search responses, restricted to an author allowlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from .raw import parse_date, raw_items

RESPONSE_SCHEMA = (
    "data array<struct<id:string,text:string,author_id:string,created_at:string,note_tweet:struct<text:string>,"
    " entities:struct<urls:array<struct<expanded_url:string,unwound_url:string>>>,"
    " referenced_tweets:array<struct<type:string,id:string>>>>,"
    " includes struct<users:array<struct<id:string,name:string,username:string,verified:boolean,verified_type:string>>>,"
    " meta struct<newest_id:string>"
)


def allowlist(names: Sequence[str] | None = None) -> list[str]:
    wanted = [n.strip() for n in names or [] if n.strip()]
    return [n.lower() for n in wanted or K.X_DEFAULT_AUTHORS]


def run_cap(requested: int = K.X_RUN_DEFAULT) -> int:
    return min(K.X_RUN_MAX, max(K.X_RUN_MIN, requested))


def parse_search(payloads: DataFrame, authors: Sequence[str] | None = None, original_only: bool = False) -> DataFrame:
    """(source_id, payload) response JSON to raw items.

    Posts and users of one response sit in the same row, so the author lookup needs no shuffle.
    """
    c = F.col
    r = payloads.select("source_id", F.from_json("payload", RESPONSE_SCHEMA).alias("r"))
    p = r.select("source_id", c("r.includes.users").alias("users"), F.explode("r.data").alias("post"))
    if original_only:
        p = p.filter(F.coalesce(F.size("post.referenced_tweets"), F.lit(0)) <= 0)
    same = F.filter("users", lambda u: u["id"] == c("post.author_id"))
    p = p.withColumn("user", F.try_element_at(same, F.lit(-1))).filter(F.lower("user.username").isin(*allowlist(authors)))
    note, plain = T.trim_all(c("post.note_tweet.text")), T.trim_all(c("post.text"))
    addresses = F.transform(c("post.entities.urls"), lambda u: F.coalesce(u["unwound_url"], u["expanded_url"]))
    p = (
        p.select(
            "source_id", "user", c("post.id").alias("id"), parse_date(c("post.created_at")).alias("published_at"),
            F.when(note != "", note).otherwise(plain).alias("said"),
            F.get(F.filter(addresses, lambda a: a.startswith("http")), F.lit(0)).alias("link"),
        )
        .filter((c("said") != "") & c("published_at").isNotNull())
        .withColumn("text", T.bind(T.strip_urls(c("said")), lambda t: F.when(t != "", t).otherwise(c("said"))))
    )
    badge = (
        F.when((c("user.verified_type") != "") & (c("user.verified_type") != "none"), c("user.verified_type"))
        .when(c("user.verified"), F.lit("verified"))
        .otherwise(F.lit("allowlisted"))
    )
    return raw_items(
        p, source_id=c("source_id"), guid=F.concat(F.lit("x:"), "id"), title=T.shorten(c("text"), K.X_TITLE_CHARS),
        url=F.concat(F.lit("https://x.com/"), c("user.username"), F.lit("/status/"), c("id")), canonical_url=c("link"),
        author=F.concat(c("user.name"), F.lit(" (@"), c("user.username"), F.lit(") · "), badge),
        content_html=T.post_html(c("text")), published_at=c("published_at"),
    )
