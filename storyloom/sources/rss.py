"""RSS 2.0 and Atom feeds, from landed payload columns or straight from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .raw import parse_date, raw_items

URL_ATTR = "array<struct<_url:string>>"
RSS_ITEM = (
    "struct<title:string, link:string, guid:struct<_VALUE:string>, pubDate:string, `dc:date`:string, description:string,"
    f" summary:string, `content:encoded`:string, `dc:creator`:string, creator:string, author:string, `media:content`:{URL_ATTR},"
    f" enclosure:{URL_ATTR}, updated:string>"
)
ATOM_ENTRY = (
    "struct<title:struct<_VALUE:string>, link:array<struct<_href:string,_rel:string>>, id:string, published:string, updated:string,"
    f" summary:struct<_VALUE:string>, content:struct<_VALUE:string>, author:struct<name:string>, `media:content`:{URL_ATTR}>"
)
FEED_SCHEMA = f"channel struct<item:array<{RSS_ITEM}>>, entry array<{ATOM_ENTRY}>"


def _atom_link(links: Column) -> Column:
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"])


def _entry(**fields: Column) -> Column:
    return F.struct(*[value.cast("string").alias(name) for name, value in fields.items()])


def _rss_entry(i: Column) -> Column:
    return _entry(
        title=i["title"], link=i["link"], guid=i["guid"]["_VALUE"],
        author=F.coalesce(i["dc:creator"], i["creator"], i["author"]), summary=i["summary"],
        description=i["description"], body=i["content:encoded"],
        image=F.coalesce(F.get(i["enclosure"], F.lit(0))["_url"], F.get(i["media:content"], F.lit(0))["_url"]),
        date=F.coalesce(i["pubDate"], i["dc:date"]), updated=i["updated"],
    )


def _atom_entry(i: Column) -> Column:
    return _entry(
        title=i["title"]["_VALUE"], link=_atom_link(i["link"]), guid=i["id"], author=i["author"]["name"],
        summary=i["summary"]["_VALUE"], description=i["content"]["_VALUE"], body=F.lit(None),
        image=F.get(i["media:content"], F.lit(0))["_url"], date=F.coalesce(i["published"], i["updated"]),
        updated=i["updated"],
    )


def _complete(entries: DataFrame) -> DataFrame:
    """(source_id, e) entries to raw items; incomplete entries are dropped, never filled in."""
    c = F.col
    rows = (
        entries.select("source_id", "e.*")
        .withColumns({"title": F.trim("title"), "link": F.trim("link"), "author": F.trim("author")})
        .withColumns({"published_at": parse_date(c("date")), "updated_at": parse_date(c("updated"))})
        .filter((c("link") != "") & (c("title") != "") & c("published_at").isNotNull())
        .withColumn("status_hint", T.status_hint(c("title"), c("summary")))
    )
    return raw_items(
        rows, source_id=c("source_id"), guid=F.when(c("guid") != "", c("guid")).otherwise(c("link")), title=c("title"),
        url=c("link"), author=F.when(c("author") != "", c("author")),
        excerpt=F.coalesce(c("summary"), T.strip_html(c("description"))), content_html=c("body"),
        image_url=F.coalesce(c("image"), T.first_image(c("body"))), published_at=c("published_at"),
        updated_at=c("updated_at"), status_hint=c("status_hint"),
        correction_note=F.when(c("status_hint").isNotNull(), c("title")),
    )


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """(source_id, payload) feed documents to raw items; a malformed document yields no rows."""
    feed = payloads.select("source_id", F.from_xml("payload", FEED_SCHEMA).alias("feed"))
    none = F.array().cast(feed.select(F.transform("feed.channel.item", _rss_entry).alias("e")).schema["e"].dataType)
    entries = F.concat(
        F.coalesce(F.transform("feed.channel.item", _rss_entry), none),
        F.coalesce(F.transform("feed.entry", _atom_entry), none),
    )
    return _complete(feed.select("source_id", F.explode(entries).alias("e")))


def read_feed_files(spark: SparkSession, path: str, source_id: Column) -> DataFrame:
    """RSS files through the XML source; ``source_id`` may use ``_metadata.file_path``."""
    fields = spark.createDataFrame([], f"i {RSS_ITEM}").schema["i"].dataType
    rows = spark.read.format("xml").option("rowTag", "item").schema(fields).load(path)
    item = F.struct(*[F.col(f"`{n}`") for n in fields.names])
    return _complete(rows.select(source_id.cast("bigint").alias("source_id"), _rss_entry(item).alias("e")))
