import json

from pyspark.sql import functions as F

from storyloom.sources import bluesky, hn, landing, registry, rss, x


def entry(**parts):
    return "<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in parts.items()) + "</item>"


def feed(*entries):
    return f'<rss version="2.0"><channel><description>harbor notes</description>{"".join(entries)}</channel></rss>'


GOOD = {"title": "Dredging &amp; tides", "link": "https://harbor.example/dredging", "guid": "tag:harbor,7", "pubDate": "Tue, 05 May 2026 06:07:08 GMT"}
LANDED = feed(
    entry(**GOOD),
    *(entry(**{k: v for k, v in GOOD.items() if k != gone}) for gone in ("title", "pubDate")),
    entry(title="No address", pubDate=GOOD["pubDate"]),
    entry(**{**GOOD, "guid": "tag:harbor,8", "title": "Retraction: dredging figures"}),
    entry(**{**GOOD, "pubDate": "the fifth of May"}),
)


def payloads(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id bigint, payload string")


def test_rss(spark):
    rows = rss.parse_feeds(payloads(spark, (3, LANDED), (4, "<rss><channel>"), (5, ""), (6, feed()))).collect()
    assert sorted((r.source_id, r.guid, r.title, r.status_hint) for r in rows) == [
        (3, "tag:harbor,7", "Dredging & tides", None), (3, "tag:harbor,8", "Retraction: dredging figures", "retracted")]
    assert {(r.published_at.month, r.published_at.second) for r in rows} == {(5, 8)}


def test_rss_files(spark, tmp_path):
    for n in (12, 13):
        (tmp_path / f"{n}.rss").write_text(feed(entry(**{**GOOD, "guid": str(n)})))
    rows = rss.read_feed_files(spark, str(tmp_path), F.regexp_extract("_metadata.file_path", "([0-9]+)[.]rss", 1)).collect()
    assert sorted((r.source_id, r.guid) for r in rows) == [(12, "12"), (13, "13")]


def test_hn(spark):
    story = {"id": 9001, "type": "story", "title": "A tide clock", "url": "https://harbor.example/clock", "time": 1_778_000_000, "score": 100, "descendants": 7}
    rejected = [{"score": 99}, {"deleted": True}, {"dead": True}, {"type": "poll"}, {"title": None}]
    sent = [story, {k: v for k, v in story.items() if k != "url"}, *({**story, **r} for r in rejected)]
    rows = hn.parse_stories(payloads(spark, *((2, json.dumps(s)) for s in sent))).collect()
    assert sorted(r.url for r in rows) == ["https://harbor.example/clock", "https://news.ycombinator.com/item?id=9001"]
    assert {r.excerpt for r in rows} == {"100 points · 7 comments on Hacker News"}


def test_bluesky_text_is_escaped(spark):
    def post(key, text, **more):
        return {"post": {"uri": f"at://did/app.bsky.feed.post/{key}", "author": {"handle": "keeper.example"}, "record": {"text": text, "createdAt": "2026-05-05T06:07:08Z"}}, **more}

    sent = {"feed": [post("k1", "spring & neap <tides>"), post("k2", "second")]}
    rows = bluesky.parse_author_feeds(spark.createDataFrame([(8, "keeper.example", json.dumps(sent))], "source_id bigint, handle string, payload string")).collect()
    by_url = {r.url: r.content_html for r in rows}
    assert by_url["https://bsky.app/profile/keeper.example/post/k1"].startswith("<p>spring &amp; neap &lt;tides&gt;</p>")
    assert len(by_url) == 2


def test_x_authors(spark):
    users = [{"id": f"u{i}", "name": f"Keeper {i}", "username": f"keeper{i}", "verified": i % 2 == 0} for i in range(30)]
    posts = [{"id": str(700 + i), "text": f"water level {i}", "author_id": f"u{i}", "created_at": "2026-05-05T06:07:08Z"} for i in range(30)]
    sent = payloads(spark, (4, json.dumps({"data": posts, "includes": {"users": users}})))
    rows = x.parse_search(sent, [f" Keeper{i} " for i in range(25)]).collect()
    assert sorted(r.guid for r in rows) == sorted(f"x:{700 + i}" for i in range(25))
    by_guid = {r.guid: r for r in rows}
    assert by_guid["x:703"].url == "https://x.com/keeper3/status/703" and by_guid["x:702"].author.endswith("verified")
    assert x.parse_search(sent).collect() == []


def test_cursors_lose_nothing(spark):
    posts = spark.createDataFrame([(1, i) for i in range(1, 101)] + [(2, 5)], "source_id bigint, post_id bigint")
    cursors = spark.createDataFrame([(1, 10)], "source_id bigint, last_id bigint")
    assert landing.newer_than_cursor(posts, cursors).count() == 91
    seen = []
    for _ in range(4):
        part = landing.newer_than_cursor(posts, cursors, cap=30)
        rows = part.collect()
        seen += [(r.source_id, r.post_id) for r in rows]
        cursors = spark.createDataFrame(landing.advance_cursors(cursors, part).collect(), "source_id bigint, last_id bigint")
    assert sorted(seen) == [(1, i) for i in range(11, 101)] + [(2, 5)]


def test_registry(spark):
    rows = registry.registry(spark).collect()
    assert len(rows) == 42 and len({(r["name"], r.kind) for r in rows}) == 42
    assert {r.poll_interval_minutes for r in rows} == {5, 10, 30}
    for r in rows:
        assert (r.poll_interval_minutes == 30) == (r.source_class == "longform")
        assert 0 < r.quality_prior <= 1 and r.source_family


def test_written_dates(spark):
    from storyloom.sources.raw import parse_date

    same = [
        "Tue, 05 May 2026 06:07:08 GMT", "05 May 26 06:07:08 +0000", "5 May 2026 08:07:08 +0200", "2026-05-05T06:07:08Z", "2026/05/05 06:07:08", "Tuesday,  5  May  26 01:07:08 EST",
    ]
    days = ["May 5, 2026", "5 May 2026", "Tuesday, May 5, 2026", "2026/05/05"]
    rest = ["06 Nov 94 08:49:00 GMT", "the fifth of May", "", "31 Feb 2026 00:00:00 GMT", "5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(same + days + rest)], "i int, t string")
    got = [r.x for r in rows.select("i", parse_date(F.col("t")).cast("string").alias("x")).orderBy("i").collect()]
    assert got[: len(same)] == ["2026-05-05 06:07:08"] * len(same)
    assert got[len(same) : len(same) + len(days)] == ["2026-05-05 00:00:00"] * len(days)
    assert got[-len(rest) :] == ["1994-11-06 08:49:00", None, None, None, None]
