"""Affinity, ranking, world and clustering queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import constants as K
from .. import demo
from ..functions import story as S
from ..functions import text as T
from ..operators import affinity, bridges, clusters, feed, filters, freshness, increments, logs, search, similarity
from ..operators.item_store import ItemStore
from ..plans import feeds
from ..plans import signals as signals_plan
from ..session import materialize, scratch_path
from .base import NOW, TABLES, check, quote, sql_list
from .texts import TOKENS

CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.SIGNAL_DELTAS.items())
TABLES["deltas"] = (
    "signals items",
    f"""SELECT id, profile_id, created_at, d.dimension, d.key, d.delta FROM (
      SELECT s.id, profile_id, created_at, unnest(list_concat(
        list_transform(i.topics, lambda t: struct_pack(dimension := 'topic', key := t, delta := s.delta)),
        [struct_pack(dimension := 'source', key := i.source_id::varchar, delta := CASE WHEN s.type = 'hide_source' THEN s.delta ELSE s.delta * 0.5 END)],
        CASE WHEN i.author IS NOT NULL THEN [struct_pack(dimension := 'author', key := lower(i.author), delta := s.delta * 0.5)] ELSE [] END)) AS d
      FROM (SELECT *, CASE type WHEN 'read_time' THEN least(value / 60.0, 2.0) {CASES} END::double AS delta FROM signals) s JOIN items i ON i.id = s.item_id)""",
)
TABLES["affinities"] = (
    "deltas",
    """SELECT profile_id, dimension, key, w.w AS weight, make_timestamp(w.t) AS updated_at FROM (
      SELECT profile_id, dimension, key, list_reduce(list_prepend(struct_pack(t := NULL::bigint, w := 0.0::double), list(struct_pack(t := epoch_us(created_at), w := delta) ORDER BY created_at, id)),
        lambda a, x: struct_pack(t := x.t, w := greatest(-10.0, least(10.0, a.w * (CASE WHEN a.t IS NOT NULL AND x.t > a.t THEN pow(2.0, -(x.t - a.t) / 1209600000000.0) ELSE 1.0 END) + x.w)))) AS w
      FROM deltas GROUP BY ALL)""",
)
TABLES["saves"] = (
    "signals",
    """SELECT profile_id, item_id, min(created_at) AS created_at FROM (SELECT *, max(CASE WHEN type = 'unsave' THEN (created_at, id) END) OVER (PARTITION BY profile_id, item_id) AS removed FROM signals WHERE type IN ('save', 'unsave'))
    WHERE type = 'save' AND (removed IS NULL OR (created_at, id) > removed) GROUP BY ALL""",
)
TABLES["reads"] = ("signals", f"SELECT DISTINCT profile_id, item_id FROM signals WHERE type = 'open' AND created_at >= {NOW} - INTERVAL 14 DAY")
HALF = "CASE source_class WHEN 'social' THEN 3.0 WHEN 'news' THEN 24.0 ELSE 96.0 END"
TABLES["pool"] = (
    "items sources",
    f"""SELECT i.*, s.name AS source_name, s.source_class, s.quality_prior, s.credibility_tier, date_diff('microsecond', published_at, {NOW}) / 3600000000.0 AS age,
    pow(2.0, -(date_diff('microsecond', published_at, {NOW}) / 3600000000.0) / {HALF}) AS recency FROM items i JOIN sources s ON s.id = i.source_id
    WHERE published_at >= {NOW} - INTERVAL 7 DAY ORDER BY published_at DESC, i.id LIMIT 500""",
)
TABLES["candidates"] = (
    "pool profiles mutes",
    """SELECT r.profile_id, r.interests, r.last_feed_opened_at, p.* FROM profiles r CROSS JOIN pool p WHERE NOT EXISTS (SELECT 1 FROM mutes m WHERE m.profile_id = r.profile_id AND m.source_id = p.source_id)""",
)
TABLES["topic_terms"] = (
    "candidates affinities",
    """SELECT c.profile_id, c.id, avg(tanh(a.weight / 3)) FILTER (WHERE a.weight IS NOT NULL) AS topic,
      bool_or(a.weight IS NULL AND list_contains(c.interests, c.t)) AS cold, bool_or(list_contains(c.interests, c.t) OR coalesce(a.weight, 0) > 0) AS familiar
    FROM (SELECT profile_id, id, interests, unnest(topics) AS t FROM candidates) c LEFT JOIN affinities a ON a.profile_id = c.profile_id AND a.dimension = 'topic' AND a.key = c.t GROUP BY ALL""",
)
TABLES["scored"] = (
    "topic_terms saves reads",
    """SELECT c.profile_id, c.id, c.source_id, c.topics, c.topics[1] AS topic1, c.cluster_id, c.published_at, c.age, c.source_class, c.source_name, c.url, c.updated_at,
      1.2 * coalesce(t.topic, 0) + 0.6 * coalesce(tanh(s.weight / 3), 0) + 0.6 * coalesce(tanh(a.weight / 3), 0) + 1.5 * c.recency + 0.5 * c.quality_prior + CASE WHEN t.cold THEN 0.4 ELSE 0 END AS score,
      NOT coalesce(t.familiar, false) AS explore, v.item_id IS NOT NULL AS saved, r.item_id IS NOT NULL AS was_read,
      c.published_at > coalesce(c.last_feed_opened_at, TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR) AS is_new
    FROM candidates c LEFT JOIN topic_terms t ON t.profile_id = c.profile_id AND t.id = c.id
    LEFT JOIN affinities s ON s.profile_id = c.profile_id AND s.dimension = 'source' AND s.key = c.source_id::varchar
    LEFT JOIN affinities a ON a.profile_id = c.profile_id AND a.dimension = 'author' AND a.key = lower(c.author)
    LEFT JOIN saves v ON v.profile_id = c.profile_id AND v.item_id = c.id LEFT JOIN reads r ON r.profile_id = c.profile_id AND r.item_id = c.id""",
)
TABLES["scoped"] = (
    "scored categories",
    "SELECT s.*, g.slug, g.ord FROM scored s JOIN categories g ON len(g.topics) = 0 OR list_has_any(s.topics, g.topics)",
)
TABLES["collapsed"] = (
    "scoped",
    """SELECT * EXCLUDE (members, n), list_transform(members[2:], lambda m: m.id) AS covered, row_number() OVER (PARTITION BY profile_id, slug ORDER BY score DESC, id) AS base FROM (
      SELECT *, row_number() OVER w AS n, list(struct_pack(id := id)) OVER (PARTITION BY profile_id, slug, coalesce(cluster_id, -id - 1) ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM scoped
      WINDOW w AS (PARTITION BY profile_id, slug, coalesce(cluster_id, -id - 1) ORDER BY score DESC, id)) WHERE n = 1""",
)


def stored_affinities(spark, d):
    return affinity.fold_affinities(demo.signals(spark, d), demo.items(spark, d))


def tables(spark, d) -> feeds.Tables:
    """The stored tables of the reader jobs. The item table is derived once, as a job finds it stored."""
    signals, items = demo.signals(spark, d), materialize(demo.items(spark, d).drop("content_html"), "items")
    return feeds.Tables(
        demo.profiles(spark, d), affinity.fold_affinities(signals, items), logs.save_set(signals), logs.read_items(signals, demo.now()),
        demo.mutes(spark, d), items, demo.sources(spark, d),
    )


@check("signal_deltas", "SELECT id, profile_id, dimension, key, round(delta, 6) AS delta FROM deltas", "deltas")
def signal_deltas(spark, d):
    return affinity.affinity_deltas(demo.signals(spark, d), demo.items(spark, d)).select("id", "profile_id", "dimension", "key", F.round("delta", 6).alias("delta"))


@check("reader_affinities", "SELECT profile_id, dimension, key, round(weight, 6) AS weight, updated_at FROM affinities", "affinities")
def reader_affinities(spark, d):
    return stored_affinities(spark, d).withColumn("weight", F.round("weight", 6))


@check("reader_affinities_chunked", "SELECT profile_id, dimension, key, round(weight, 6) AS weight, updated_at FROM affinities", "affinities")
def reader_affinities_chunked(spark, d):
    """The path for profiles with very long histories, forced for all of the busier ones."""
    return affinity.fold_affinities(demo.signals(spark, d), demo.items(spark, d), heavy_profile=60).withColumn("weight", F.round("weight", 6))


@check("affinities_continued", "SELECT profile_id, dimension, key, round(weight, 6) AS weight FROM affinities", "affinities")
def affinities_continued(spark, d):
    """The second half of the log folded onto the stored result of the first half."""
    signals, items = demo.signals(spark, d), demo.items(spark, d)
    half = F.lit("2024-01-15").cast("timestamp")
    first = materialize(affinity.fold_affinities(signals.filter(F.col("created_at") < half), items), "first-half")
    touched = affinity.fold_affinities(signals.filter(F.col("created_at") >= half), items, stored=first)
    return affinity.upsert_affinities(first, touched).select("profile_id", "dimension", "key", F.round("weight", 6).alias("weight"))


TABLES["batched_signals"] = ("signals", "SELECT * REPLACE (date_trunc('hour', created_at) AS created_at, greatest(0, least(3600, value)) AS value) FROM signals")
for _name, _of in (("deltas", "signals"), ("affinities", "deltas"), ("saves", "signals")):
    _needs, _sql = TABLES[_name]
    TABLES[f"batched_{_name}"] = (" ".join(f"batched_{n}" if n == _of else n for n in _needs.split()), _sql.replace(f"FROM {_of}", f"FROM batched_{_of}"))
HALF = "2024-01-15"


def half_state(spark, d, items) -> signals_plan.ReaderState:
    """What the first half of the log leaves behind."""
    c = F.col
    rows = demo.signals(spark, d).withColumn("created_at", F.date_trunc("hour", "created_at"))
    before = rows.filter(c("created_at") < F.lit(HALF).cast("timestamp")).withColumn("value", F.greatest(F.lit(0.0), F.least("value", F.lit(K.SIGNAL_VALUE_MAX))))
    hidden = before.filter("type = 'hide_source'").join(items.select(c("id").alias("item_id"), "source_id"), "item_id")
    return signals_plan.ReaderState(
        materialize(affinity.fold_affinities(before, items), "half-affinities"), logs.save_set(before),
        hidden.groupBy("profile_id", "source_id").agg(F.min("created_at").alias("created_at")),
    )


def half_batches(spark, d):
    """The second half of the log as landed batches, one for each reader and hour."""
    c = F.col
    rows = demo.signals(spark, d).withColumn("created_at", F.date_trunc("hour", "created_at"))
    entry = F.to_json(F.struct(c("item_id").alias("itemId"), "type", "value"))
    batches = rows.filter(c("created_at") >= F.lit(HALF).cast("timestamp")).groupBy("profile_id", c("created_at").alias("received_at")).agg(
        F.min("id").alias("batch_id"), F.array_sort(F.collect_list(F.struct("id", entry.alias("entry")))).alias("entries"))
    payload = F.concat(F.lit('{"signals": ['), F.array_join(F.transform("entries", lambda e: e["entry"]), ","), F.lit("]}"))
    return batches.select("profile_id", "batch_id", "received_at", payload.alias("payload"))


def batched_run(spark, d) -> signals_plan.SignalRun:
    items = materialize(demo.items(spark, d).select("id", "source_id", "author", "topics"), "facts")
    return signals_plan.signals_job(half_batches(spark, d), items, half_state(spark, d, items))


@check("signal_job_affinities", "SELECT profile_id, dimension, key, round(weight, 6) AS weight, updated_at FROM batched_affinities", "batched_affinities")
def signal_job_affinities(spark, d):
    return batched_run(spark, d).state.affinities.withColumn("weight", F.round("weight", 6))


@check("signal_job_saves", "SELECT * FROM batched_saves", "batched_saves")
def signal_job_saves(spark, d):
    return batched_run(spark, d).state.saves


@check("signal_job_mutes", "SELECT profile_id, i.source_id, min(created_at) AS created_at FROM batched_signals g JOIN docs i ON i.id = g.item_id WHERE type = 'hide_source' GROUP BY ALL", "batched_signals docs")
def signal_job_mutes(spark, d):
    return batched_run(spark, d).state.mutes


@check("signal_job_log", f"SELECT profile_id, item_id, type, value, created_at FROM batched_signals WHERE created_at >= TIMESTAMP '{HALF}' AND item_id IN (SELECT doc_id FROM documents)", "batched_signals")
def signal_job_log(spark, d):
    return batched_run(spark, d).log.select("profile_id", "item_id", "type", "value", "created_at")


@check("signal_job_seen", f"SELECT profile_id, max(created_at) AS last_seen_at FROM batched_signals WHERE created_at >= TIMESTAMP '{HALF}' GROUP BY 1", "batched_signals")
def signal_job_seen(spark, d):
    return batched_run(spark, d).seen


@check("decayed_affinities", f"SELECT profile_id, dimension, key, round(weight * pow(2.0, -date_diff('microsecond', updated_at, {NOW}) / 1209600000000.0), 6) AS weight FROM affinities", "affinities")
def decayed_affinities(spark, d):
    return affinity.decayed(stored_affinities(spark, d), demo.now()).select("profile_id", "dimension", "key", F.round("weight", 6).alias("weight"))


@check("unopened_impressions", "SELECT count(*) AS n, sum(id) AS ids FROM signals s WHERE type <> 'impression' OR NOT EXISTS (SELECT 1 FROM signals o WHERE o.type = 'open' AND o.profile_id = s.profile_id AND o.item_id = s.item_id)", "signals")
def unopened_impressions(spark, d):
    return affinity.unopened_impressions(demo.signals(spark, d)).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@check("candidate_pool", "SELECT id, source_id, source_name, source_class, round(recency, 6) AS recency FROM pool", "pool")
def candidate_pool(spark, d):
    pool = feed.candidate_pool(demo.items(spark, d), demo.sources(spark, d), demo.now())
    return pool.select("id", "source_id", "source_name", "source_class", F.round(S.recency(F.col("published_at"), F.col("source_class"), demo.now()), 6).alias("recency"))


def scored(spark, d):
    t = tables(spark, d)
    pool = feeds.stored_pool(t, demo.now())
    readers = feed.reader_state(t.profiles, t.affinities, t.saves, t.reads, t.mutes, pool)
    return feed.score_readers(readers, feed.pool_array(pool, demo.now(), feed.slugs_of(F.col("topics"))), demo.now())


@check("story_scores", "SELECT profile_id, id, round(score, 6) AS score, explore FROM scored", "scored")
def story_scores(spark, d):
    return scored(spark, d).filter("id IS NOT NULL").select("profile_id", "id", F.round("score", 6).alias("score"), "explore")


@check("collapsed_worlds", "SELECT profile_id, slug, base::int AS place, id, round(score, 6) AS score, array_to_string(covered, ',') AS covered FROM collapsed", "collapsed")
def collapsed_worlds(spark, d):
    worlds = feed.collapsed(feed.ranked_worlds(scored(spark, d)))
    rows = worlds.select("profile_id", "slug", "also", F.posexplode("ranked").alias("pos", "e"))
    return rows.select("profile_id", "slug", (F.col("pos") + 1).alias("place"), "e.id", F.round(-F.col("e.neg"), 6).alias("score"),
                       F.array_join(feed.covered_by(F.col("e.cluster_id"), F.col("also")), ",").alias("covered"))


def greedy_sql(limit: int, where: str) -> str:
    """The greedy order as a recursion over slots."""
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT profile_id, slug, id, source_id, topic1, score, explore, covered, is_new, was_read, published_at, age, source_class, ord FROM collapsed WHERE {where}),
    lists AS MATERIALIZED (SELECT profile_id, slug, list(struct_pack(id := id, s := source_id, t := topic1, score := score, x := explore) ORDER BY score DESC, id) AS l FROM base GROUP BY ALL),
    walk AS (
      SELECT profile_id, slug, 0 AS slot, l, NULL::bigint AS id, NULL::varchar AS t, NULL::bigint AS s, false AS exploration FROM lists
      UNION ALL
      SELECT profile_id, slug, slot + 1, list_filter(l, lambda e: e.id <> pick.id), pick.id, pick.t, pick.s, odd IS NOT NULL FROM (
        SELECT *, CASE WHEN (slot + 1) % 10 = 0 THEN list_filter(l, lambda e: e.x)[1] END AS odd, coalesce(CASE WHEN (slot + 1) % 10 = 0 THEN list_filter(l, lambda e: e.x)[1] END,
          list_sort(list_transform(l, lambda e: struct_pack(cost := -(e.score - CASE WHEN slot > 0 AND e.t = w.t THEN 0.35 ELSE 0 END - CASE WHEN slot > 0 AND e.s = w.s THEN 0.25 ELSE 0 END), neg := -e.score, id := e.id, e := e)))[1].e) AS pick
        FROM walk w WHERE slot < {limit} AND len(l) > 0)
    ),
    picks AS MATERIALIZED (SELECT w.profile_id, w.slug, b.ord, w.slot - 1 AS rank, w.id, w.exploration, b.score, b.covered, b.is_new, b.was_read, b.published_at, b.age, b.source_class FROM walk w JOIN base b ON b.profile_id = w.profile_id AND b.slug = w.slug AND b.id = w.id)"""


@check("reader_feeds", greedy_sql(80, "slug = 'today'") + " SELECT profile_id, rank::int AS rank, id, round(score, 6) AS score, exploration, len(covered)::int AS also_covered FROM picks", "collapsed")
def reader_feeds(spark, d):
    entries = feeds.feed_job(tables(spark, d), demo.now()).entries
    return entries.select("profile_id", "rank", "id", F.round("score", 6).alias("score"), "exploration", F.size("also_covered_by").alias("also_covered"))


TABLES["tech_scoped"] = ("scoped", "SELECT * FROM scoped WHERE slug = 'tech'")


@check("tech_feeds", greedy_sql(80, "slug = 'tech'") + """ SELECT p.profile_id, rank::int AS rank, p.id, i.title, i.excerpt, i.author, p.exploration, s.name AS source_name, s.credibility_tier, i.word_count > 0 AS has_body,
      CASE WHEN i.word_count > 0 THEN greatest(1, floor(i.word_count / 230.0 + 0.5))::int END AS reading_minutes, i.status, i.verification_status, c.saved, c.was_read AS read, s.last_successful_fetch_at AS source_checked_at
      FROM picks p JOIN items i ON i.id = p.id JOIN sources s ON s.id = i.source_id JOIN scored c ON c.profile_id = p.profile_id AND c.id = p.id""", "collapsed")
def tech_feeds(spark, d):
    entries = feeds.feed_job(tables(spark, d), demo.now(), "tech").entries
    return entries.select("profile_id", "rank", "id", "title", "excerpt", "author", "exploration", "source_name", "credibility_tier", "has_body", "reading_minutes", "status", "verification_status", "saved", "read", "source_checked_at")


@check("latest_social", f"""SELECT profile_id, (row_number() OVER (PARTITION BY profile_id ORDER BY published_at DESC, id) - 1)::int AS place, id, saved, was_read AS read FROM scored WHERE source_class = 'social' AND age < 12
      QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY published_at DESC, id) <= 6""", "scored")
def latest_social(spark, d):
    return feeds.feed_job(tables(spark, d), demo.now()).latest.select("profile_id", "place", "id", "saved", "read")


@check("latest_updates", "SELECT r.profile_id, max(s.updated_at) AS updated_at FROM profiles r LEFT JOIN scored s USING (profile_id) GROUP BY ALL", "scored profiles")
def latest_updates(spark, d):
    return feeds.feed_job(tables(spark, d), demo.now()).updated_at


WORLD_SQL = greedy_sql(28, "true")
SHOWN_SQL = WORLD_SQL + ", shown AS MATERIALIZED (SELECT * FROM picks WHERE slug <> 'today' OR rank < 14)"


@check("world_reports", WORLD_SQL + """ SELECT r.profile_id, g.slug, g.ord::int AS ord, g.label, round(tanh(coalesce(f.w, 0) / 6), 6) AS affinity, round(tanh(coalesce(m.mass, 0) / 40), 6) AS activity,
      coalesce(b.hot, false) AS breaking, coalesce(b.new_count, 0)::int AS new_count, coalesce(b.n, 0)::int AS n
      FROM profiles r CROSS JOIN categories g
      LEFT JOIN (SELECT a.profile_id, t.slug, sum(greatest(0, a.weight)) AS w FROM affinities a JOIN category_topics t ON a.dimension = 'topic' AND a.key = t.topic GROUP BY ALL) f ON f.profile_id = r.profile_id AND f.slug = g.slug
      LEFT JOIN (SELECT profile_id, slug, sum(pow(2.0, -age / 24)) AS mass FROM scoped GROUP BY ALL) m ON m.profile_id = r.profile_id AND m.slug = g.slug
      LEFT JOIN (SELECT profile_id, slug, bool_or(len(covered) > 0 AND age < 2) OR count(*) FILTER (WHERE age < 0.75 AND source_class IN ('news', 'social')) >= 3 AS hot,
        count(*) FILTER (WHERE is_new AND NOT was_read) AS new_count, least(count(*), max(CASE WHEN slug = 'today' THEN 14 ELSE 28 END)) AS n FROM picks GROUP BY profile_id, slug) b ON b.profile_id = r.profile_id AND b.slug = g.slug""", "collapsed profiles category_topics")
def world_reports(spark, d):
    worlds = feeds.worlds_job(tables(spark, d), demo.now()).worlds
    return worlds.select("profile_id", "slug", "ord", "label", F.round("affinity", 6).alias("affinity"), F.round("activity", 6).alias("activity"), "breaking", "new_count", F.size("entries").alias("n"))


@check("world_entries", SHOWN_SQL + " SELECT profile_id, slug, rank::int AS rank, id AS item_id, round(score, 6) AS score, exploration FROM shown", "collapsed")
def world_entries(spark, d):
    return feeds.worlds_job(tables(spark, d), demo.now()).world_entries.withColumn("score", F.round("score", 6))


@check("visible_stories", SHOWN_SQL + """ SELECT profile_id, s.id, min(s.ord::bigint * 4294967296 + rank)::bigint AS position, bool_or(is_new) AS is_new, bool_or(was_read) AS read,
      len(max_by(covered, s.ord))::int AS also_covered, any_value(i.title) AS title FROM shown s JOIN items i ON i.id = s.id GROUP BY profile_id, s.id""", "collapsed")
def visible_stories(spark, d):
    s = feeds.worlds_job(tables(spark, d), demo.now()).stories
    return s.select("profile_id", "id", "position", "is_new", "read", F.size("also_covered_by").alias("also_covered"), "title")


@check("reader_summaries", SHOWN_SQL + """, st AS (SELECT profile_id, id, min(ord::bigint * 4294967296 + rank) AS position, any_value(published_at) AS published_at FROM shown WHERE is_new AND NOT was_read GROUP BY ALL),
      c AS (SELECT profile_id, count(*) AS n, array_to_string(list(id ORDER BY published_at DESC, position)[1:8], ',') AS ids FROM st GROUP BY ALL)
      SELECT r.profile_id, r.last_feed_opened_at AS last_visit_at, (SELECT max(updated_at) FROM scored s WHERE s.profile_id = r.profile_id) AS updated_at, coalesce(n, 0) AS new_count, coalesce(ids, '') AS catch_up
      FROM profiles r LEFT JOIN c USING (profile_id)""", "collapsed profiles")
def reader_summaries(spark, d):
    r = feeds.worlds_job(tables(spark, d), demo.now()).readers
    return r.select("profile_id", "last_visit_at", "updated_at", "new_count", F.array_join("catch_up", ",").alias("catch_up"))


@check("rehydrated_worlds", SHOWN_SQL + " SELECT s.profile_id, s.slug, s.rank::int AS rank, s.id, i.title FROM shown s JOIN items i ON i.id = s.id WHERE s.id % 7 <> 0", "collapsed")
def rehydrated_worlds(spark, d):
    job = feeds.worlds_job(tables(spark, d), demo.now(), cut=lambda df: materialize(df, "worlds"))
    known = job.stories.filter("id % 7 <> 0")
    return feeds.rehydrate(job.world_entries, known).select("profile_id", "slug", "rank", "id", "title")


def shown_with_topics(spark, d):
    job = feeds.worlds_job(tables(spark, d), demo.now())
    shown = job.worlds.select("profile_id", "slug", "ord", F.inline("entries"))
    return shown.join(demo.items(spark, d).select("id", "topics", "title"), "id")


@check("world_bridges", SHOWN_SQL + """, s AS (SELECT s.profile_id, s.ord, s.rank, s.id, (SELECT list(slug ORDER BY p) FROM (SELECT t.slug, min(u.p) AS p FROM (SELECT unnest(i.topics) AS t, generate_subscripts(i.topics, 1) AS p) u JOIN category_topics t ON t.topic = u.t GROUP BY ALL)) AS slugs
        FROM shown s JOIN items i ON i.id = s.id),
      b AS (SELECT profile_id, id, min(rank) AS rank, min(ord::bigint * 4294967296 + rank) AS seen, any_value(slugs) AS slugs FROM s WHERE len(slugs) >= 2 GROUP BY ALL)
      SELECT profile_id, (row_number() OVER (PARTITION BY profile_id ORDER BY rank, seen))::int AS place, id, slugs[1] AS a, slugs[2] AS b, rank::int AS rank FROM b QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY rank, seen) <= 5""", "collapsed category_topics")
def world_bridges(spark, d):
    return bridges.bridges(shown_with_topics(spark, d))


@check("search_index", SHOWN_SQL + " SELECT profile_id, id, min_by(slug, ord::bigint * 4294967296 + rank) AS slug, min(ord::bigint * 4294967296 + rank)::bigint AS position FROM shown GROUP BY ALL", "collapsed")
def search_index(spark, d):
    return bridges.search_index(shown_with_topics(spark, d))


@check("reader_search", SHOWN_SQL + """, x AS (SELECT profile_id, id, min_by(slug, ord::bigint * 4294967296 + rank) AS slug, min(ord::bigint * 4294967296 + rank) AS position FROM shown GROUP BY ALL),
      f AS (SELECT profile_id, x.id, slug, i.title, row_number() OVER (PARTITION BY profile_id ORDER BY position) AS place FROM x JOIN items i ON i.id = x.id WHERE contains(lower(i.title), 'the'))
      SELECT profile_id, place::int AS place, id, slug, title FROM f WHERE place <= 8""", "collapsed items")
def reader_search(spark, d):
    """Each reader's search over the stories that the reader is shown."""
    index = bridges.search_index(shown_with_topics(spark, d), ("title",))
    return filters.search_stories(index, " The ").select("profile_id", "place", "id", "slug", "title")


@check("title_search", """SELECT id, title FROM items WHERE contains(lower(title), 'the') ORDER BY id LIMIT 8""", "items")
def title_search(spark, d):
    index = demo.items(spark, d).select("id", "title", F.col("id").alias("position"))
    return filters.search_stories(index, " The").select("id", "title")


@check("title_searches", """WITH n AS (SELECT DISTINCT lower(trim(substr(title, (1 + id % 20)::int, (2 + id % 9)::int))) AS needle FROM items)
      SELECT needle, row_number() OVER (PARTITION BY needle ORDER BY id)::int AS place, id, title FROM n JOIN items i ON contains(lower(i.title), needle) WHERE needle <> '' QUALIFY place <= 8""", "items")
def title_searches(spark, d):
    """One needle out of every title, all answered in one job from the title index."""
    titles = materialize(demo.items(spark, d).select("id", "title", F.col("id").alias("position")), "titles")
    index = search.TitleIndex.build(scratch_path(spark, "title-index"), titles, first=64)
    return index.search(titles.select(F.substring(F.col("title"), (1 + F.col("id") % 20).cast("int"), (2 + F.col("id") % 9).cast("int")).alias("needle")))


@check("reader_searches", SHOWN_SQL + """, x AS (SELECT profile_id, id, min(ord::bigint * 4294967296 + rank) AS position FROM shown GROUP BY ALL),
      q AS (SELECT DISTINCT profile_id, unnest([substr(profile_id, 2, 1), ['the', 'ing', 'an', 'er'][substr(profile_id, 2)::int % 4 + 1]]) AS needle FROM profiles)
      SELECT profile_id, needle, row_number() OVER (PARTITION BY profile_id, needle ORDER BY position, x.id)::int AS place, x.id FROM x JOIN q USING (profile_id) JOIN items i ON i.id = x.id
      WHERE contains(lower(i.title), needle) QUALIFY place <= 8""", "collapsed items profiles")
def reader_searches(spark, d):
    """Requests of all readers at once, two of each."""
    n = F.substring("profile_id", 2, 10).cast("int")
    asked = F.array(F.substring("profile_id", 2, 1), F.get(F.array(*[F.lit(x) for x in ("the", "ing", "an ", "er")]), n % 4))
    requests = demo.profiles(spark, d).select("profile_id", F.explode(asked).alias("needle"))
    index = bridges.search_index(shown_with_topics(spark, d), ("title",))
    return search.search_readers(index, requests).select("profile_id", "needle", "place", "id")


@check("world_search", """SELECT slug, count(*) AS items FROM items JOIN category_topics t ON list_contains(topics, t.topic) WHERE slug IN (SELECT slug FROM categories WHERE contains(lower(label), 'tai') OR contains(slug, 'tai') ORDER BY ord LIMIT 3) GROUP BY slug""", "items category_topics")
def world_search(spark, d):
    found = filters.search_worlds(feed.category_table(spark), "TAI")
    hits = found.select("slug", F.explode("topics").alias("topic"))
    return demo.items(spark, d).select("id", F.explode("topics").alias("topic")).join(F.broadcast(hits), "topic").groupBy("slug").agg(F.count("*").alias("items"))


@check("source_search", "SELECT id, name FROM sources WHERE contains(lower(name), 'ce 1') OR list_contains(topic_hints, 'media')", "sources")
def source_search(spark, d):
    s = demo.sources(spark, d)
    return filters.search_sources(s, "ce 1").unionByName(filters.search_sources(s, "media")).select("id", "name").distinct()


@check("tab_counts", f"""SELECT g.slug, least(count(DISTINCT i.id), 99) AS n FROM category_topics g LEFT JOIN (SELECT * FROM items WHERE published_at >= {NOW} - INTERVAL 6 HOUR) i ON list_contains(i.topics, g.topic) GROUP BY g.slug""", "items category_topics")
def tab_counts(spark, d):
    return freshness.tab_counts(demo.items(spark, d), demo.now())


@check("item_tabs", "SELECT i.id, (SELECT min_by(slug, ord) FROM category_topics g WHERE list_contains(i.topics, g.topic)) AS slug FROM items i", "items category_topics")
def item_tabs(spark, d):
    return demo.items(spark, d).select("id", freshness.tab_of(F.col("topics")).alias("slug"))


STALE = f"(last_successful_fetch_at IS NULL OR date_diff('second', last_successful_fetch_at, {NOW}) > greatest(15, poll_interval_minutes * 2) * 60)"


@check("source_freshness", f"SELECT max(last_successful_fetch_at) AS latest_checked_at, min(last_successful_fetch_at) AS oldest_checked_at, count(*) FILTER (WHERE {STALE}) AS stale_sources, count(*) AS total_sources FROM sources WHERE active", "sources")
def source_freshness(spark, d):
    return freshness.source_freshness(demo.sources(spark, d), demo.now())


@check("any_stale_source", f"SELECT bool_or({STALE}) AS stale FROM sources WHERE active", "sources")
def any_stale_source(spark, d):
    return freshness.any_stale(demo.sources(spark, d), demo.now())


@check("saved_stories", """SELECT v.profile_id, (row_number() OVER (PARTITION BY v.profile_id ORDER BY v.created_at DESC, i.id))::int AS place, i.id, v.created_at AS saved_at, i.title, s.name AS source_name, true AS saved
      FROM saves v JOIN items i ON i.id = v.item_id JOIN sources s ON s.id = i.source_id JOIN profiles p ON p.profile_id = v.profile_id""", "saves items sources profiles")
def saved_stories(spark, d):
    rows = feeds.saved_job(demo.profiles(spark, d), logs.save_set(demo.signals(spark, d)), demo.items(spark, d), demo.sources(spark, d))
    return rows.select("profile_id", "place", "id", "saved_at", "title", "source_name", "saved")


@check("source_directory", "SELECT id, name, poll_interval_minutes, last_successful_fetch_at FROM sources WHERE active", "sources")
def source_directory(spark, d):
    listed = feeds.sources_job(demo.profiles(spark, d), demo.sources(spark, d), demo.mutes(spark, d)).sources
    return listed.select("id", "name", "poll_interval_minutes", "last_successful_fetch_at")


@check("reader_mutes", """SELECT p.profile_id, coalesce(string_agg(m.source_id::varchar, ',' ORDER BY m.source_id), '') AS muted
      FROM profiles p LEFT JOIN (SELECT * FROM mutes WHERE source_id IN (SELECT id FROM sources WHERE active)) m USING (profile_id) GROUP BY p.profile_id""", "profiles sources mutes")
def reader_mutes(spark, d):
    muted = feeds.sources_job(demo.profiles(spark, d), demo.sources(spark, d), demo.mutes(spark, d)).muted
    return muted.select("profile_id", F.array_join("muted_ids", ",").alias("muted"))


@check("article_lookup", """SELECT g.id AS signal_id, g.item_id, i.title, length(i.content_html) AS body_length, s.name AS source_name, v.item_id IS NOT NULL AS saved
      FROM signals g JOIN items i ON i.id = g.item_id JOIN sources s ON s.id = i.source_id LEFT JOIN saves v ON v.profile_id = g.profile_id AND v.item_id = g.item_id WHERE g.type IN ('read_time', 'save')""", "signals items sources saves")
def article_lookup(spark, d):
    wanted = demo.signals(spark, d).filter("type IN ('read_time', 'save')").select(F.col("id").alias("signal_id"), "profile_id", "item_id")
    rows = feeds.reader_items(wanted, demo.items(spark, d), demo.sources(spark, d), logs.save_set(demo.signals(spark, d)))
    return rows.select("signal_id", "item_id", "title", F.length("content_html").cast("bigint").alias("body_length"), "source_name", "saved")


@check("items_by_id", "SELECT id, title, source_id FROM items WHERE id IN (SELECT item_id FROM signals WHERE type = 'save')", "items signals")
def items_by_id(spark, d):
    ids = demo.signals(spark, d).filter("type = 'save'")
    return feeds.items_by_ids(demo.items(spark, d), demo.sources(spark, d), ids).select("id", "title", "source_id")


@check("recent_items", f"SELECT i.id, s.name FROM items i JOIN sources s ON s.id = i.source_id WHERE published_at >= {NOW} - INTERVAL 72 HOUR AND list_has_any(topics, ['tech', 'ai', 'vc'])", "items sources")
def recent_items(spark, d):
    recent = filters.in_category(filters.since(filters.item_summaries(demo.items(spark, d)), "published_at", demo.now(), "72 hours"), ["tech", "ai", "vc"])
    return recent.join(demo.sources(spark, d).select(F.col("id").alias("source_id"), "name"), "source_id").select("id", "name")


TABLES["tokens"] = ("items", f"SELECT id, source_id, canonical_url, cluster_id, {TOKENS} AS a FROM items")
TABLES["title_pairs"] = (
    "tokens",
    """SELECT x.id AS a, y.id AS b, len(list_intersect(x.a, y.a)) AS shared, len(x.a) AS n, len(y.a) AS m FROM tokens x JOIN tokens y ON x.id < y.id AND x.source_id <> y.source_id
    WHERE len(x.a) > 0 AND len(y.a) > 0 AND 2 * least(len(x.a), len(y.a)) >= greatest(len(x.a), len(y.a)) AND 3 * len(list_intersect(x.a, y.a)) >= len(x.a) + len(y.a)""",
)


SIMILAR_SQL = """WITH t AS (SELECT list_sort(a) AS a, min(id) AS rep, min(source_id) AS lo, max(source_id) AS hi FROM tokens WHERE len(a) > 0 GROUP BY 1),
      p AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.a, y.a)) AS shared, len(x.a) AS n, len(y.a) AS m FROM t x JOIN t y ON x.rep < y.rep AND (x.lo <> y.hi OR x.hi <> y.lo)
        AND 2 * least(len(x.a), len(y.a)) >= greatest(len(x.a), len(y.a)))
      SELECT a, b, round(shared::double / (n + m - shared), 6) AS similarity FROM p WHERE 3 * shared >= n + m"""


@check("similar_titles", SIMILAR_SQL, "tokens")
def similar_titles(spark, d):
    return similarity.title_pairs(demo.items(spark, d)).withColumn("similarity", F.round("similarity", 6))


@check("similar_titles_crowded", SIMILAR_SQL, "tokens")
def similar_titles_crowded(spark, d):
    """The path for crowded token buckets, forced by a low bound."""
    return similarity.title_pairs(demo.items(spark, d), hot_bucket=6).withColumn("similarity", F.round("similarity", 6))


@check("title_sets", "SELECT id, source_id, min(id) OVER (PARTITION BY list_sort(a)) AS set_id FROM tokens WHERE len(a) > 0", "tokens")
def title_sets(spark, d):
    return similarity.title_sets(demo.items(spark, d)).drop("tokens")


@check("shared_addresses", """SELECT id, canonical_url, first_id, n AS items FROM (SELECT id, canonical_url, min(id) OVER w AS first_id, count(*) OVER w AS n, min(source_id) OVER w AS lo, max(source_id) OVER w AS hi
      FROM items WHERE canonical_url <> '' WINDOW w AS (PARTITION BY canonical_url)) WHERE lo <> hi""", "items")
def shared_addresses(spark, d):
    return similarity.shared_addresses(demo.items(spark, d))


BEST_SQL = """SELECT id, match_id, round(sim, 6) AS similarity FROM (
      SELECT id, match_id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, match_id DESC) AS n FROM (
        SELECT a AS id, b AS match_id, shared::double / (n + m - shared) AS sim FROM title_pairs UNION ALL SELECT b, a, shared::double / (n + m - shared) FROM title_pairs
        UNION ALL SELECT x.id, y.id, 1.0 FROM tokens x JOIN tokens y ON x.canonical_url = y.canonical_url AND x.source_id <> y.source_id)) WHERE n = 1"""


@check("best_matches", BEST_SQL, "title_pairs")
def best_matches(spark, d):
    return similarity.best_matches(demo.items(spark, d)).select("id", "match_id", F.round("similarity", 6).alias("similarity"))


@check("best_matches_crowded", BEST_SQL, "title_pairs")
def best_matches_crowded(spark, d):
    """The path for crowded token buckets, forced by a low bound."""
    return similarity.best_matches(demo.items(spark, d), hot_bucket=12).select("id", "match_id", F.round("similarity", 6).alias("similarity"))


@check("title_similarity", f"""WITH m AS ({BEST_SQL}), p AS (SELECT m.id, x.a, y.a AS b FROM m JOIN tokens x ON x.id = m.id JOIN tokens y ON y.id = m.match_id)
      SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS similarity,
        len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS merged FROM p""", "title_pairs")
def title_similarity(spark, d):
    """Every title next to its best match in the whole table."""
    items = materialize(demo.items(spark, d).drop("content_html"), "items")
    words = items.select("id", T.title_tokens(F.col("title")).alias("a"))
    pairs = similarity.best_matches(items).select("id", "match_id")
    return pairs.join(words, "id").join(words.select(F.col("id").alias("match_id"), F.col("a").alias("b")), "match_id").select(
        "id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"),
        F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"), F.size(F.array_union("a", "b")).cast("bigint").alias("merged"),
    )


def clusters_sql(items: str, own: str, tokens: str = "tokens", pairs: str = "title_pairs", prefix: str = "") -> str:
    """CTEs ending in ``grouped`` (id, group_key), by the sequential rule over ``items`` rows with cluster ids ``own``.
    A ``prefix`` of the CTEs' names lets two runs follow each other.

    Items act in id order unless an earlier one chose them; then each acting item's tree is climbed to its root.
    """
    ctes = f"""g_items AS (SELECT id, {own} AS cluster FROM {items}),
      g_best AS (SELECT id, match_id FROM (SELECT id, match_id, row_number() OVER (PARTITION BY id ORDER BY sim DESC, match_id DESC) AS n FROM (
        SELECT a AS id, b AS match_id, shared::double / (n + m - shared) AS sim FROM {pairs} UNION ALL SELECT b, a, shared::double / (n + m - shared) FROM {pairs}
        UNION ALL SELECT x.id, y.id, 1.0 FROM {tokens} x JOIN {tokens} y ON x.canonical_url = y.canonical_url AND x.source_id <> y.source_id)
        WHERE id IN (SELECT id FROM g_items) AND match_id IN (SELECT id FROM g_items)) WHERE n = 1),
      g_match AS (SELECT b.id, b.match_id, m.cluster AS match_cluster FROM g_best b JOIN g_items i ON i.id = b.id JOIN g_items m ON m.id = b.match_id WHERE i.cluster IS NULL),
      g_blocked AS (SELECT unnest(list_reduce(list_prepend([]::bigint[], (SELECT list([id, match_id] ORDER BY id) FROM g_match WHERE match_cluster IS NULL AND match_id > id)),
        lambda acc, e: CASE WHEN list_contains(acc, e[1]) THEN acc ELSE list_append(acc, e[2]) END)) AS id),
      g_act AS (SELECT * FROM g_match WHERE id NOT IN (SELECT id FROM g_blocked)),
      g_walk AS (SELECT id, match_id AS root, match_cluster AS cluster FROM g_act
        UNION ALL SELECT w.id, a.match_id, a.match_cluster FROM g_walk w JOIN g_act a ON a.id = w.root WHERE w.cluster IS NULL),
      g_ends AS (SELECT * FROM g_walk w WHERE cluster IS NOT NULL OR root NOT IN (SELECT id FROM g_act)),
      g_new AS (SELECT id, root FROM g_ends WHERE cluster IS NULL UNION SELECT root, root FROM g_ends WHERE cluster IS NULL),
      grouped AS (SELECT id, 'new-' || min(id) OVER (PARTITION BY root) AS group_key FROM g_new UNION ALL SELECT id, 'old-' || cluster FROM g_ends WHERE cluster IS NOT NULL
        UNION ALL SELECT id, 'old-' || cluster FROM g_items WHERE cluster IS NOT NULL)"""
    return re.sub(r"\b(g_[a-z]+|grouped)\b", rf"{prefix}\1", ctes) if prefix else ctes


@check("story_clusters", "WITH RECURSIVE " + clusters_sql("items", "CASE WHEN id % 16 = 0 THEN cluster_id END") + " SELECT id, group_key FROM grouped", "items title_pairs")
def story_clusters(spark, d):
    return clusters.cluster_groups(demo.items(spark, d).withColumn("cluster_id", F.when(F.col("id") % 16 == 0, F.col("cluster_id"))))


@check("verification", """WITH r AS (SELECT i.id, i.cluster_id, s.source_family AS fam, s.credibility_tier AS tier FROM items i JOIN sources s ON s.id = i.source_id)
      SELECT r.id, CASE WHEN r.cluster_id IS NOT NULL AND (SELECT count(DISTINCT g.fam) FROM r g WHERE g.cluster_id = r.cluster_id) >= 2
        AND (r.tier <> 'social' OR EXISTS (SELECT 1 FROM r g WHERE g.cluster_id = r.cluster_id AND g.fam <> r.fam AND g.tier <> 'social')) THEN 'corroborated'
        WHEN r.tier = 'social' THEN 'unconfirmed' ELSE 'reported' END AS verification_status FROM r""", "items sources")
def verification(spark, d):
    return clusters.verification(demo.items(spark, d), demo.sources(spark, d))


@check("cluster_report", "WITH RECURSIVE " + clusters_sql(f"(SELECT * FROM items WHERE published_at >= {NOW} - INTERVAL 72 HOUR)", "NULL::bigint") + """,
      r AS (SELECT i.id, g.group_key, s.source_family AS fam, s.credibility_tier AS tier FROM g_items JOIN items i USING (id) JOIN sources s ON s.id = i.source_id LEFT JOIN grouped g ON g.id = i.id)
      SELECT id, replace(group_key, 'new-', '')::bigint AS first_member, CASE WHEN group_key IS NOT NULL AND (SELECT count(DISTINCT g.fam) FROM r g WHERE g.group_key = r.group_key) >= 2
        AND (r.tier <> 'social' OR EXISTS (SELECT 1 FROM r g WHERE g.group_key = r.group_key AND g.fam <> r.fam AND g.tier <> 'social')) THEN 'corroborated'
        WHEN r.tier = 'social' THEN 'unconfirmed' ELSE 'reported' END AS verification_status FROM r""", "items title_pairs sources")
def cluster_report(spark, d):
    """Every item of the window with its status and, if it is in a cluster, the cluster's first member."""
    none = spark.createDataFrame([], "id bigint")
    job = clusters.cluster_and_verify(demo.items(spark, d).withColumn("cluster_id", F.lit(None).cast("bigint")), demo.sources(spark, d), none, demo.now())
    first = job.members.groupBy("cluster_id").agg(F.min("id").alias("first_member"))
    members = job.members.join(first, "cluster_id").select("id", "first_member")
    return job.verified.join(members, "id", "left").select("id", "first_member", "verification_status")


# The odd items are stored first; the even ones land later and get ids above them, in their order.
TABLES["landed_items"] = (
    "items sources",
    f"""SELECT CASE WHEN i.id % 2 = 1 THEN i.id ELSE (SELECT max(id) FROM items WHERE id % 2 = 1) + row_number() OVER (PARTITION BY i.id % 2 ORDER BY i.id) END AS id, i.id % 2 = 0 AS late,
      i.source_id, title, canonical_url, source_family AS fam, credibility_tier AS tier FROM items i JOIN sources s ON s.id = i.source_id WHERE true QUALIFY i.published_at >= {NOW} - INTERVAL 72 HOUR""",
)
TABLES["landed_tokens"] = ("landed_items", f"SELECT id, source_id, canonical_url, {TOKENS} AS a FROM landed_items")
TABLES["landed_pairs"] = ("landed_tokens", TABLES["title_pairs"][1].replace("FROM tokens x JOIN tokens y", "FROM landed_tokens x JOIN landed_tokens y"))


@check("cluster_changes", "WITH RECURSIVE " + clusters_sql("(SELECT * FROM landed_items WHERE NOT late)", "NULL::bigint", "landed_tokens", "landed_pairs", "first_") + ", "
       + clusters_sql("(SELECT i.id, substr(f.group_key, 5)::bigint AS cluster_id FROM landed_items i LEFT JOIN first_grouped f ON f.id = i.id)", "cluster_id", "landed_tokens", "landed_pairs") + """,
      r AS (SELECT i.id, substr(g.group_key, 5)::bigint AS first_member, fam, tier FROM landed_items i LEFT JOIN grouped g ON g.id = i.id)
      SELECT id, first_member, CASE WHEN first_member IS NOT NULL AND (SELECT count(DISTINCT g.fam) FROM r g WHERE g.first_member = r.first_member) >= 2
        AND (r.tier <> 'social' OR EXISTS (SELECT 1 FROM r g WHERE g.first_member = r.first_member AND g.fam <> r.fam AND g.tier <> 'social')) THEN 'corroborated'
        WHEN r.tier = 'social' THEN 'unconfirmed' ELSE 'reported' END AS verification_status FROM r""", "landed_pairs")
def cluster_changes(spark, d):
    """Half of the items are stored and clustered, the others land, and what changed is clustered."""
    items = materialize(demo.items(spark, d).withColumn("cluster_id", F.lit(None).cast("bigint")), "items")
    sources = materialize(demo.sources(spark, d), "sources")
    store = ItemStore.create(scratch_path(spark, "store"), items.where("id % 2 = 1"), buckets=8)
    increments.cluster_changes(store, sources, demo.now())
    store.upsert(items.where("id % 2 = 0").withColumn("ord", F.col("id")), demo.now())
    increments.cluster_changes(store, sources, demo.now())
    window = materialize(store.items(since=demo.now() - F.expr("interval 72 hours")).select("id", "cluster_id", "verification_status"), "window")
    first = window.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min("id").alias("first_member"))
    return window.join(first, "cluster_id", "left").select("id", "first_member", "verification_status")
