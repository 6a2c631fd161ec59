"""Source queries: payloads are built from the driver's tables, parsed back, and compared with the rows they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import demo
from ..functions import text as T
from ..functions.story import minutes
from ..sources import bluesky, hn, landing, registry, rss, x
from .base import NOW, check, quote
from .texts import squeeze_sql

EPOCH = 1_700_000_000


def _escape(c):
    return T.escape_html(c)


def feed_payloads(spark, d):
    """One RSS document per 25 pages; every seventh entry lacks something."""
    p = F.col("page_id")
    title = F.concat(F.when(p % 5 == 0, "Correction: ").otherwise(""), F.lit("Page "), p, F.lit(" & <more>"))
    stamp = F.date_format(demo.now() - minutes((p * 11 % 9000).cast("int")), "EEE, dd MMM yyyy HH:mm:ss")
    date = F.when(p % 7 == 3, "not a date").otherwise(F.concat(stamp, F.lit(" GMT")))
    entry = F.concat(
        F.lit("<item><title>"), F.when(p % 7 == 1, "").otherwise(_escape(title)), F.lit("</title>"),
        F.when(p % 7 == 2, "").otherwise(F.concat(F.lit("<link>"), _escape(F.trim("url")), F.lit("</link>"))),
        F.when(p % 4 == 0, "").otherwise(F.concat(F.lit('<guid isPermaLink="false">page-'), p, F.lit("</guid>"))),
        F.lit("<pubDate>"), date, F.lit("</pubDate><description>"), _escape(F.concat(F.lit("<p>About "), p, F.lit("</p>"))),
        F.lit("</description><content:encoded>"), _escape(F.col("html")), F.lit("</content:encoded>"),
        F.when(p % 3 == 0, F.concat(F.lit("<dc:creator>Writer "), p % 9, F.lit("</dc:creator>"))).otherwise(""),
        F.when(p % 2 == 0, F.concat(F.lit('<media:content url="https://m.example.com/'), p, F.lit('.jpg"/>'))).otherwise(""),
        F.lit("</item>"),
    )
    docs = demo.pages(spark, d).select((p % 20).alias("source_id"), F.floor(p / 500).alias("part"), p, entry.alias("entry"))
    head = ('<?xml version="1.0"?><rss version="2.0" xmlns:content="c" xmlns:media="m" xmlns:dc="d"><channel><title>t</title>')
    return docs.groupBy("source_id", "part").agg(
        F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "entry"))), lambda s: s["entry"]), ""),
                 F.lit("</channel></rss>")).alias("payload")
    )


@check("feed_entries", f"""SELECT page_id % 20 AS source_id, CASE WHEN page_id % 4 = 0 THEN trim(url) ELSE 'page-' || page_id END AS guid,
      CASE WHEN page_id % 5 = 0 THEN 'Correction: ' ELSE '' END || 'Page ' || page_id || ' & <more>' AS title, trim(url) AS url,
      CASE WHEN page_id % 3 = 0 THEN 'Writer ' || (page_id % 9) END AS author, 'About ' || page_id AS excerpt, length(html) AS body_length,
      CASE WHEN page_id % 2 = 0 THEN 'https://m.example.com/' || page_id || '.jpg'
           WHEN starts_with(regexp_extract(html, '(?is)<img[^>]+src=["'']([^"'']+)["'']', 1), 'http') THEN regexp_extract(html, '(?is)<img[^>]+src=["'']([^"'']+)["'']', 1) END AS image_url,
      {NOW} - to_minutes(page_id * 11 % 9000) AS published_at, CASE WHEN page_id % 5 = 0 THEN 'corrected' END AS status_hint
      FROM web WHERE page_id % 7 NOT IN (1, 2, 3)""", "web")
def feed_entries(spark, d):
    return rss.parse_feeds(feed_payloads(spark, d)).select(
        "source_id", "guid", "title", "url", "author", "excerpt", F.length("content_html").cast("bigint").alias("body_length"),
        "image_url", "published_at", "status_hint",
    )


@check("atom_entries", f"""SELECT page_id % 20 AS source_id, 'tag:' || page_id AS guid, 'Page ' || page_id AS title, trim(url) AS url,
      'Writer' AS author, CASE WHEN page_id % 2 = 0 THEN 'Sum ' || page_id ELSE 'Body ' || page_id END AS excerpt,
      {NOW} - to_minutes(page_id * 11 % 9000) AS published_at, {NOW} AS updated_at FROM web""", "web")
def atom_entries(spark, d):
    p = F.col("page_id")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    payload = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="text">Page '), p,
        F.lit('</title><link rel="self" href="https://self.example.com/"/><link rel="alternate" href="'), _escape(F.trim("url")),
        F.lit('"/><id>tag:'), p, F.lit("</id><published>"),
        F.date_format(demo.now() - minutes((p * 11 % 9000).cast("int")), iso), F.lit("</published><updated>"),
        F.date_format(demo.now(), iso), F.lit("</updated>"),
        F.when(p % 2 == 0, F.concat(F.lit("<summary>Sum "), p, F.lit("</summary>")))
        .otherwise(F.concat(F.lit('<content type="html">&lt;b&gt;Body '), p, F.lit("&lt;/b&gt;</content>"))),
        F.lit("<author><name>Writer</name></author></entry></feed>"),
    )
    docs = demo.pages(spark, d).select((p % 20).alias("source_id"), payload.alias("payload"))
    return rss.parse_feeds(docs).select("source_id", "guid", "title", "url", "author", "excerpt", "published_at", "updated_at")


def story_payloads(spark, d):
    i = F.col("doc_id")
    story = F.struct(
        i.alias("id"), F.when(i % 9 == 0, "job").otherwise("story").alias("type"), demo.first_sentence(F.col("text")).alias("title"),
        F.when(i % 4 != 0, F.concat(F.lit("https://example.com/"), i)).alias("url"),
        F.when(i % 6 != 0, F.concat(F.lit("user"), i % 30)).alias("by"), (F.lit(EPOCH) + i * 60).alias("time"),
        F.when(i % 8 != 0, F.col("n_chars") % 400).alias("score"), F.when(i % 7 != 0, i % 50).alias("descendants"),
        F.when(i % 31 == 0, F.lit(True)).alias("dead"),
    )
    return demo.table(spark, d, "documents").select(F.lit(1).alias("source_id"), i, F.to_json(story).alias("payload"))


STORY_OK = "doc_id % 9 <> 0 AND doc_id % 31 <> 0 AND doc_id % 8 <> 0 AND n_chars % 400 >= 100"
STORY_SQL = f"""SELECT 'hn-' || doc_id AS guid, regexp_extract(text, '^[^.\n]*') AS title,
      CASE WHEN doc_id % 4 <> 0 THEN 'https://example.com/' || doc_id ELSE 'https://news.ycombinator.com/item?id=' || doc_id END AS url,
      CASE WHEN doc_id % 6 <> 0 THEN 'user' || (doc_id % 30) END AS author,
      (n_chars % 400) || ' points · ' || (CASE WHEN doc_id % 7 <> 0 THEN doc_id % 50 ELSE 0 END) || ' comments on Hacker News' AS excerpt,
      TIMESTAMP '1970-01-01' + to_seconds({EPOCH} + doc_id * 60) AS published_at FROM documents WHERE {STORY_OK}"""


@check("hn_stories", STORY_SQL)
def hn_stories(spark, d):
    return hn.parse_stories(story_payloads(spark, d)).select("guid", "title", "url", "author", "excerpt", "published_at")


@check("hn_front_page", f"""SELECT l.doc_id AS list_id, s.doc_id - l.doc_id AS place, s.doc_id AS id FROM documents l
      JOIN documents s ON s.doc_id >= l.doc_id AND s.doc_id < l.doc_id + {K.HN_TOP_N} WHERE l.doc_id % 50 = 0""")
def hn_front_page(spark, d):
    docs = demo.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    lists = docs.filter(F.col("id") % 50 == 0).select(F.col("id").alias("list_id"), F.sequence("id", F.col("id") + 60).alias("ids"))
    return hn.front_page(lists, docs).select("list_id", F.col("place").cast("bigint").alias("place"), "id")


def bluesky_payloads(spark, d):
    i = F.col("doc_id")
    handle = F.concat(F.lit("h"), F.floor(i / 10) % 4, F.lit(".test"))
    text = F.when(i % 11 == 0, F.lit("   ")).otherwise(F.concat("text", F.lit(" https://t.co/"), i))
    entry = F.struct(
        F.when(i % 13 == 0, "repost").alias("reason"),
        F.struct(
            F.concat(F.lit("at://did/app.feed.post/k"), i).alias("uri"),
            F.struct(F.when(i % 9 == 0, "other.test").otherwise(handle).alias("handle"), F.when(i % 2 == 0, F.concat(F.lit("Name "), i % 7)).alias("displayName")).alias("author"),
            F.struct(text.alias("text"), F.when(i % 17 == 0, "never").otherwise("2024-01-05T10:00:00Z").alias("createdAt"), F.when(i % 19 == 0, "r").alias("reply")).alias("record"),
            F.struct(F.when(i % 3 == 0, F.struct(
                F.concat(F.lit("https://example.com/a?x=1&y="), i).alias("uri"), F.when(i % 2 == 0, F.lit("A <title>")).alias("title"),
                F.when(i % 4 == 0, "  said  ").otherwise(" ").alias("description"), F.lit("https://img.test/t").alias("thumb"))).alias("external")).alias("embed"),
        ).alias("post"),
    )
    return (
        demo.table(spark, d, "documents").select(F.floor(i / 10).alias("part"), handle.alias("handle"), entry.alias("entry"))
        .groupBy("part", "handle").agg(F.to_json(F.struct(F.collect_list("entry").alias("feed"))).alias("payload"))
        .withColumn("source_id", F.col("part") % 4)
    )


def _no_links_sql(text: str) -> str:
    from .texts import RE2_SPACE as S

    out = f"regexp_replace({text}, '(?i)https?://[^{S}]+', '', 'g')"
    out = f"regexp_replace({out}, '(?i)\\b[a-z0-9-]+\\.[a-z]{{2,6}}/[^{S}]+', '', 'g')"
    out = f"regexp_replace({out}, '[{S}]{{2,}}', ' ', 'g')"
    out = f"regexp_replace({out}, '[{S}]+([.,;:!?])', '\\1', 'g')"
    return f"regexp_replace({out}, '^[{S}]+|[{S}]+$', '', 'g')"


def _short_sql(text: str, n: int) -> str:
    from .texts import RE2_SPACE as S

    return f"CASE WHEN length({text}) > {n} THEN regexp_replace(substr({text}, 1, {n}), '[{S}]+$', '') || '…' ELSE {text} END"


def _escape_sql(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@check("bluesky_posts", f"""WITH p AS (SELECT doc_id, doc_id // 10 % 4 AS h, {_no_links_sql("text || ' https://t.co/' || doc_id")} AS t FROM documents
        WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 9 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0)
      SELECT h AS source_id, 'at://did/app.feed.post/k' || doc_id AS guid, {_short_sql('t', 140)} AS title,
      'https://bsky.app/profile/h' || h || '.test/post/k' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'https://example.com/a?x=1&y=' || doc_id END AS canonical_url,
      CASE WHEN doc_id % 2 = 0 THEN 'Name ' || (doc_id % 7) ELSE 'h' || h || '.test' END AS author, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'said' END AS excerpt,
      '<p>' || {_escape_sql('t')} || '</p>' || CASE WHEN doc_id % 3 = 0 THEN '<p><a href="https://example.com/a?x=1&amp;y=' || doc_id || '" rel="noopener noreferrer" target="_blank">' ||
        CASE WHEN doc_id % 2 = 0 THEN 'A &lt;title&gt;' ELSE 'https://example.com/a?x=1&amp;y=' || doc_id END || '</a></p>' ELSE '' END AS content_html,
      CASE WHEN doc_id % 3 = 0 THEN 'https://img.test/t' END AS image_url, TIMESTAMP '2024-01-05 10:00:00' AS published_at FROM p""")
def bluesky_posts(spark, d):
    return bluesky.parse_author_feeds(bluesky_payloads(spark, d), drop_replies=True).drop("updated_at", "status_hint", "correction_note")


def x_payloads(spark, d):
    i = F.col("doc_id")
    post = F.struct(
        i.cast("string").alias("id"), F.concat("text", F.lit(" https://t.co/x")).alias("text"), (i % 5).cast("string").alias("author_id"),
        F.lit("2024-01-06T00:00:00.000Z").alias("created_at"),
        F.when(i % 6 == 0, F.struct(F.concat(F.lit("Long form "), i).alias("text"))).alias("note_tweet"),
        F.struct(F.array(F.struct(F.lit("ftp://no").alias("expanded_url"), F.lit(None).cast("string").alias("unwound_url")),
                         F.struct(F.concat(F.lit("https://e.test/"), i).alias("expanded_url"), F.when(i % 2 == 0, F.concat(F.lit("https://u.test/"), i)).alias("unwound_url"))).alias("urls")).alias("entities"),
        F.when(i % 10 == 0, F.array(F.struct(F.lit("retweeted").alias("type"), F.lit("1").alias("id")))).alias("referenced_tweets"),
    )
    users = F.array(*[
        F.struct(F.lit(str(u)).alias("id"), F.lit(n).alias("name"), F.lit(n).alias("username"), F.lit(v).alias("verified"), F.lit(t).cast("string").alias("verified_type"))
        for u, n, v, t in [(0, "Reuters", True, None), (1, "nobody", True, None), (2, "AP", False, "business"), (3, "npr", False, "none")]
    ])
    return (
        demo.table(spark, d, "documents").select(F.floor(i / 10).alias("part"), post.alias("post"))
        .groupBy("part").agg(F.collect_list("post").alias("data"))
        .select((F.col("part") * 0).alias("source_id"), F.to_json(F.struct("data", F.struct(users.alias("users")).alias("includes"))).alias("payload"))
    )


@check("x_posts", f"""WITH p AS (SELECT doc_id, ['Reuters', '', 'AP', 'npr'][doc_id % 5 + 1] AS u, ['verified', '', 'business', 'allowlisted'][doc_id % 5 + 1] AS badge,
        CASE WHEN doc_id % 6 = 0 THEN 'Long form ' || doc_id ELSE {_no_links_sql("text || ' https://t.co/x'")} END AS t FROM documents
        WHERE doc_id % 5 IN (0, 2, 3) AND doc_id % 10 <> 0)
      SELECT 'x:' || doc_id AS guid, {_short_sql('t', 180)} AS title, 'https://x.com/' || u || '/status/' || doc_id AS url,
      CASE WHEN doc_id % 2 = 0 THEN 'https://u.test/' ELSE 'https://e.test/' END || doc_id AS canonical_url, u || ' (@' || u || ') · ' || badge AS author,
      '<p>' || {_escape_sql('t')} || '</p>' AS content_html, TIMESTAMP '2024-01-06' AS published_at FROM p""")
def x_posts(spark, d):
    return x.parse_search(x_payloads(spark, d), original_only=True).select(
        "guid", "title", "url", "canonical_url", "author", "content_html", "published_at")


def posts(spark, d):
    e = F.col("event_id")
    return demo.table(spark, d, "events").select(
        (F.col("user_id") % 20).alias("source_id"), e.alias("post_id"), (e % 7 == 0).alias("is_repost"), F.when(e % 5 != 1, e % 5 == 0).alias("is_reply"))


@check("original_posts", "SELECT user_id % 20 AS source_id, event_id AS post_id FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def original_posts(spark, d):
    return landing.original_posts(posts(spark, d)).select("source_id", "post_id")


@check("posts_past_cursor", """WITH p AS (SELECT user_id % 20 AS source_id, event_id AS post_id FROM events),
      c AS (SELECT source_id, quantile_disc(post_id, 0.5) AS last_id FROM p WHERE source_id % 4 > 0 GROUP BY source_id),
      f AS (SELECT p.*, row_number() OVER (PARTITION BY p.source_id ORDER BY post_id) AS n FROM p LEFT JOIN c USING (source_id) WHERE last_id IS NULL OR post_id > last_id)
      SELECT source_id, post_id, n <= 25 AS in_request FROM f""")
def posts_past_cursor(spark, d):
    """All posts past the cursor, and which of them one request of 25 brings."""
    p = posts(spark, d)
    cursors = p.filter(F.col("source_id") % 4 > 0).groupBy("source_id").agg(F.expr("percentile_disc(0.5) within group (order by post_id)").cast("bigint").alias("last_id"))
    first = landing.newer_than_cursor(p, cursors, x.run_cap()).select("source_id", "post_id", F.lit(True).alias("first"))
    fresh = landing.newer_than_cursor(p, cursors).join(first, ["source_id", "post_id"], "left")
    return fresh.select("source_id", "post_id", F.coalesce("first", F.lit(False)).alias("in_request"))


@check("advanced_cursors", """WITH p AS (SELECT user_id % 20 AS source_id, event_id AS post_id FROM events WHERE user_id % 20 > 2),
      c AS (SELECT DISTINCT user_id % 20 AS source_id, 5 + user_id % 20 AS last_id FROM events WHERE user_id % 20 < 10)
      SELECT source_id, greatest(max(last_id), max(post_id)) AS last_id FROM (SELECT source_id, NULL AS last_id, post_id FROM p UNION ALL SELECT source_id, last_id, NULL FROM c) GROUP BY source_id""")
def advanced_cursors(spark, d):
    p = posts(spark, d)
    cursors = p.filter("source_id < 10").select("source_id", (F.col("source_id") + 5).alias("last_id")).distinct()
    return landing.advance_cursors(cursors, p.filter("source_id > 2"))


@check("changed_payloads", """SELECT page_id AS source_id, sha256(html) AS digest FROM pages WHERE page_id % 3 = 0""")
def changed_payloads(spark, d):
    p = demo.table(spark, d, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("payload"))
    ledger = p.select("source_id", F.when(F.col("source_id") % 3 != 0, F.sha2("payload", 256)).otherwise("stale").alias("digest"))
    return landing.changed_payloads(p, ledger).select("source_id", "digest")


@check("source_policy", f"""SELECT id, CASE WHEN id % 11 = 0 THEN 'social' WHEN name IN ('Reuters', 'CNBC') THEN 'major' WHEN cls = 'social' THEN 'social' ELSE 'independent' END AS credibility_tier,
      CASE WHEN name = 'Reuters' THEN 'reuters' WHEN id % 8 = 0 THEN 'outlet-number-' || id ELSE 'src' || id || '-example' END AS source_family,
      CASE WHEN cls = 'longform' THEN 30 WHEN cls = 'social' OR (name IN ('Reuters', 'CNBC') AND id % 11 <> 0) THEN 5 ELSE 10 END AS poll_interval_minutes,
      cls = 'longform' OR (cls = 'social' AND (id % 11 = 0 OR name NOT IN ('Reuters', 'CNBC'))) AS named_author_required
      FROM (SELECT id, cls, CASE id % 6 WHEN 1 THEN 'Reuters' WHEN 3 THEN 'CNBC' ELSE 'Outlet: number ' || id END AS name FROM source_class)""", "source_class")
def source_policy(spark, d):
    n = F.col("id")
    seeds = demo.sources(spark, d).select(
        "id", F.when(n % 6 == 1, "Reuters").when(n % 6 == 3, "CNBC").otherwise(F.concat(F.lit("Outlet: number "), n)).alias("name"),
        "source_class", F.when(n % 8 == 0, "no address").otherwise(F.col("homepage_url")).alias("homepage_url"),
        F.when(n % 11 == 0, "social").alias("credibility_tier"))
    return registry.with_policy(seeds).select("id", "credibility_tier", "source_family", "poll_interval_minutes", "named_author_required")
