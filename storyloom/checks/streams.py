"""Streaming queries: file streams over the driver's tables, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import demo
from ..operators.item_store import ItemStore
from ..operators.upsert import ITEM_COLUMNS
from ..plans.reader_store import ReaderStore
from ..session import list_paths, materialize, scratch_path
from ..streaming import jobs
from .base import NOW, check
from .readers import HALF, TABLES, half_batches, half_state
from .stores import SET_SQL, raw_entries


def stories(spark, d):
    """Items as a stream of stories: several unsorted files, one for each micro-batch, so that many come late."""
    rows = demo.items(spark, d).join(demo.sources(spark, d).select(F.col("id").alias("source_id"), "source_class"), "source_id")
    rows = rows.select("id", "source_id", "guid", "topics", "source_class", "published_at", F.col("content_fingerprint").alias("fingerprint"))
    path = scratch_path(spark, "stories")
    rows.repartition(3, "id").write.parquet(path)
    return jobs.file_stream(spark, path, rows.schema, files_per_batch=1)


TABLES["story_worlds"] = (
    "items sources categories",
    """SELECT i.id, g.slug, i.published_at, s.source_class FROM items i JOIN sources s ON s.id = i.source_id JOIN categories g ON len(g.topics) = 0 OR list_has_any(i.topics, g.topics)""",
)


@check("stream_hourly_activity", """SELECT slug, date_trunc('hour', published_at) AS hour, count(*) AS stories,
      round(sum(pow(2.0, -(3600 - epoch(published_at) % 3600) / 86400.0)), 6) AS mass FROM story_worlds GROUP BY slug, date_trunc('hour', published_at)""", "story_worlds")
def stream_hourly_activity(spark, d):
    return jobs.drain_updates(jobs.hourly_activity(stories(spark, d)), ["slug", "hour"], "hourly").withColumn("mass", F.round("mass", 6))


@check("stream_bursts", """SELECT slug, w AS starts_at, w + INTERVAL 45 MINUTE AS ends_at, count(*) AS stories FROM (
        SELECT slug, published_at, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, published_at) - INTERVAL 40 MINUTE, time_bucket(INTERVAL 5 MINUTE, published_at), INTERVAL 5 MINUTE)) AS w
        FROM story_worlds WHERE source_class IN ('news', 'social')) GROUP BY ALL HAVING count(*) >= 3""", "story_worlds")
def stream_bursts(spark, d):
    return jobs.drain_updates(jobs.bursts(stories(spark, d)), ["slug", "starts_at"], "bursts")


@check("hourly_activity_read", """SELECT slug, round(tanh(sum(pow(2.0, -date_diff('second', published_at, TIMESTAMP '2024-01-31') / 86400.0)) / 40), 6) AS activity
      FROM story_worlds GROUP BY slug""", "story_worlds")
def hourly_activity_read(spark, d):
    rows = demo.items(spark, d).select("topics", "published_at")
    return jobs.activity_at(jobs.hourly_activity(rows), demo.now()).withColumn("activity", F.round("activity", 6))


@check("stream_unique_entries", "SELECT DISTINCT source_id, guid, content_fingerprint AS fingerprint FROM items", "items")
def stream_unique_entries(spark, d):
    s = stories(spark, d)
    return jobs.drain(jobs.unique_entries(s.unionByName(s)), "unique").select("source_id", "guid", "fingerprint")


@check("stream_dwell_sessions", """WITH v AS (SELECT 'p' || user_id AS profile_id, event_id // 200 % 5 AS item_id, ts, event_id % 4 > 0 AS visible FROM events),
      s AS (SELECT *, lead(ts) OVER w AS until, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS starts FROM v WINDOW w AS (PARTITION BY profile_id, item_id ORDER BY ts)),
      g AS (SELECT *, sum(starts) OVER (PARTITION BY profile_id, item_id ORDER BY ts) AS reading FROM s)
      SELECT profile_id, item_id, min(ts) AS started_at, floor(sum(CASE WHEN visible AND until < ts + INTERVAL 12 HOUR THEN (epoch_us(until) - epoch_us(ts)) / 1e6 ELSE 0 END) + 0.5)::bigint AS seconds
      FROM g GROUP BY profile_id, item_id, reading HAVING floor(sum(CASE WHEN visible AND until < ts + INTERVAL 12 HOUR THEN (epoch_us(until) - epoch_us(ts)) / 1e6 ELSE 0 END) + 0.5) >= 5""")
def stream_dwell_sessions(spark, d):
    events = jobs.file_stream(spark, d, demo.table(spark, d, "events").schema, glob="events.parquet")
    e = F.col("event_id")
    v = events.select(F.concat(F.lit("p"), "user_id").alias("profile_id"), (F.floor(e / 200) % 5).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), (e % 4 > 0).alias("visible"))
    return jobs.read_times(jobs.drain_updates(jobs.dwell_sessions(v, "12 hours"), jobs.DWELL_KEY, "dwell"))


def land_slices(slices, path: str, by: str | None = "profile_id") -> int:
    """Write slices of rows after each other and return the most files of one, to be taken as a micro-batch.

    The files of a slice are dealt by reader over all tasks; without ``by`` they stay as they were read. Files are taken
    in the order in which they were written, so that a reader's rows come in the order of the slices wherever a batch ends.
    """
    most, before = 1, 0
    for rows in slices:
        spark = rows.sparkSession
        dealt = rows.repartition(max(2, spark.sparkContext.defaultParallelism), by) if by else rows
        dealt.write.mode("append").parquet(path)
        written = len(list_paths(spark, f"{path}/part-*"))
        most, before = max(most, written - before), written
    return most


def stored_facts(spark, d):
    """What folding a signal needs of its item, derived once."""
    return materialize(demo.items(spark, d).select("id", "source_id", "author", "topics"), "facts")


@check("stream_affinities", "SELECT profile_id, dimension, key, round(weight, 6) AS weight, updated_at FROM affinities", "affinities")
def stream_affinities(spark, d):
    """Three time slices of the log as three micro-batches."""
    signals = demo.signals(spark, d)
    path, out = scratch_path(spark, "signals"), scratch_path(spark, "affinities")
    bounds = [("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01")]
    slices = [signals.filter((F.col("created_at") >= F.lit(low).cast("timestamp")) & (F.col("created_at") < F.lit(high).cast("timestamp"))) for low, high in bounds]
    stream = jobs.file_stream(spark, path, signals.schema, files_per_batch=land_slices(slices, path))
    items = stored_facts(spark, d)
    store = ReaderStore.create(spark, out, buckets=8)
    jobs.affinity_stream(stream, items, store, scratch_path(spark, "cp"))
    return store.read("affinities").withColumn("weight", F.round("weight", 6))


STREAMED = [c for c in ITEM_COLUMNS if c not in ("id", "content_html", "topics")]


@check("stream_ingest", f"""WITH sides AS (SELECT s.id, coalesce(c.source_id, s.source_id) AS source_id, coalesce(c.guid, s.guid) AS guid, c.guid IS NOT NULL AS landed, s.guid IS NOT NULL AS known,
        c, s FROM (SELECT * FROM items WHERE id % 3 <> 0) s FULL JOIN cleaned c ON c.source_id = s.source_id AND c.guid = s.guid)
      SELECT id, source_id, guid, CASE WHEN landed THEN c.author ELSE s.author END AS author, CASE WHEN landed THEN c.title ELSE s.title END AS title, CASE WHEN landed THEN c.url ELSE s.url END AS url,
        CASE WHEN landed THEN c.canonical_url ELSE s.canonical_url END AS canonical_url, CASE WHEN landed THEN c.excerpt ELSE s.excerpt END AS excerpt, NULL::varchar AS image_url,
        CASE WHEN landed THEN c.published_at ELSE s.published_at END AS published_at, CASE WHEN landed THEN c.updated_at END AS source_updated_at,
        CASE WHEN landed THEN c.content_fingerprint ELSE s.content_fingerprint END AS content_fingerprint, CASE WHEN landed THEN c.word_count ELSE s.word_count END AS word_count,
        CASE WHEN NOT landed THEN s.status WHEN known AND c.status = 'active' THEN 'updated' ELSE c.status END AS status, NULL::varchar AS correction_note,
        CASE WHEN known THEN s.fetched_at ELSE {NOW} END AS fetched_at, CASE WHEN landed THEN {NOW} ELSE s.updated_at END AS updated_at,
        CASE WHEN known THEN s.published_at ELSE {NOW} END AS first_seen_at, CASE WHEN landed THEN {NOW} ELSE s.published_at END AS last_seen_at,
        CASE WHEN known THEN s.verification_status ELSE c.verification_status END AS verification_status, CASE WHEN NOT landed THEN s.cluster_id END AS cluster_id,
        md5(CASE WHEN landed THEN c.body ELSE s.content_html END) AS body, CASE WHEN landed THEN c.topics ELSE array_to_string(s.topics, ',') END AS topics FROM sides""", "items cleaned")
def stream_ingest(spark, d):
    """Two halves of the entries land as files, each half a micro-batch whatever its size; ids are those of known items."""
    raw = raw_entries(spark, d)
    path = scratch_path(spark, "raw")
    files = land_slices([raw.filter(F.col("ord") % 2 == half) for half in (0, 1)], path, by=None)
    stored = materialize(demo.items(spark, d).filter("id % 3 <> 0"), "stored")
    store = ItemStore.create(scratch_path(spark, "store"), stored, buckets=8)
    top = store.facts["top_id"]
    stream = jobs.file_stream(spark, path, raw.schema, files_per_batch=files)
    jobs.ingest_stream(stream, materialize(demo.sources(spark, d), "sources"), store, scratch_path(spark, "cp"), demo.now(), demo.TEST_TAXONOMY)
    known = F.when(F.col("id") <= top, F.col("id")).alias("id")
    return store.items().select(known, *STREAMED, F.md5("content_html").alias("body"), F.array_join("topics", ",").alias("topics"))


def reader_requests(spark, d):
    """Batches, mute toggles and new profiles of the second half of the log, each as it landed."""
    e, at = F.col("event_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.expr("interval 30 minutes")
    late = demo.table(spark, d, "events").where(at >= F.lit(HALF).cast("timestamp"))
    columns = [F.concat(F.lit("p"), "user_id").alias("profile_id"), e.alias("batch_id"), at.alias("received_at")]
    said = F.element_at(F.array(*[F.lit(x) for x in ("false", "0", '""', "null", "true", "1", '"no"', "{}")]), (e % 8 + 1).cast("int"))
    source = F.when(e % 10 == 9, F.concat(F.lit('"'), e % 20, F.lit('"'))).otherwise((e % 20).cast("string"))
    mutes = late.where("event_type IN ('signup', 'click')").select(*columns, F.lit("mute").alias("route"), F.concat(F.lit('{"sourceId": '), source, F.lit(', "muted": '), said, F.lit("}")).alias("payload"))
    chosen = F.when(e % 4 == 0, F.lit("none")).otherwise(F.concat(F.lit('{"interests": ["nba", 7, "'), "event_type", F.lit('", "'), F.element_at(F.array(F.lit("tech"), F.lit("bogus"), F.lit("media")), (e % 3 + 1).cast("int")), F.lit('"]}')))
    begun = late.where("event_type = 'error'").select(*columns, F.lit("profile").alias("route"), chosen.alias("payload"))
    return half_batches(spark, d).withColumn("route", F.lit("signals")).unionByName(mutes).unionByName(begun)


def reader_store(spark, d) -> ReaderStore:
    """The state after the first half, and the requests of the second as two micro-batches."""
    requests, path = materialize(reader_requests(spark, d), "requests"), scratch_path(spark, "requests")
    cut = F.col("received_at") < F.lit("2024-01-22").cast("timestamp")
    files = land_slices([requests.where(part) for part in (cut, ~cut)], path)
    items = stored_facts(spark, d)
    store = ReaderStore.create(spark, scratch_path(spark, "readers"), half_state(spark, d, items), demo.profiles(spark, d), buckets=8)
    stream = jobs.file_stream(spark, path, requests.schema, files_per_batch=files)
    jobs.reader_stream(stream, items, store, scratch_path(spark, "cp"))
    return store


LATE_SQL = f"(SELECT *, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS landed FROM events WHERE date_trunc('hour', ts) + INTERVAL 30 MINUTE >= TIMESTAMP '{HALF}')"


@check("stream_reader_affinities", "SELECT profile_id, dimension, key, round(weight, 6) AS weight, updated_at FROM batched_affinities", "batched_affinities")
def stream_reader_affinities(spark, d):
    return reader_store(spark, d).read("affinities").withColumn("weight", F.round("weight", 6))


@check("stream_reader_saves", "SELECT * FROM batched_saves", "batched_saves")
def stream_reader_saves(spark, d):
    return reader_store(spark, d).read("saves")


@check("stream_reader_mutes", SET_SQL.format(add="muted", keys="profile_id, source_id", log=f"""(
      SELECT g.id, profile_id, source_id, true AS muted, created_at FROM batched_signals g JOIN docs i ON i.id = g.item_id WHERE type = 'hide_source'
      UNION ALL SELECT event_id, 'p' || user_id, event_id % 20, event_id % 8 > 3, landed FROM {LATE_SQL} WHERE event_type IN ('signup', 'click') AND event_id % 10 <> 9)"""), "batched_signals docs")
def stream_reader_mutes(spark, d):
    """Hidden sources with explicit mutes and unmutes."""
    return reader_store(spark, d).read("mutes")


@check("stream_reader_profiles", f"""WITH asked AS (SELECT 'p' || user_id AS profile_id, arg_max(CASE WHEN event_id % 4 = 0 THEN '' ELSE 'nba' || ['', '', ',tech', ',media'][CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END] END, (landed, event_id)) AS chosen
        FROM {LATE_SQL} WHERE event_type = 'error' GROUP BY 1),
      seen AS (SELECT profile_id, max(created_at) AS last_seen_at FROM batched_signals WHERE created_at >= TIMESTAMP '{HALF}' GROUP BY 1)
      SELECT profile_id, coalesce(chosen, array_to_string(interests, ',')) AS interests, last_seen_at FROM profiles LEFT JOIN asked USING (profile_id) LEFT JOIN seen USING (profile_id)""", "profiles batched_signals")
def stream_reader_profiles(spark, d):
    return reader_store(spark, d).read("profiles").withColumn("interests", F.array_join("interests", ","))


@check("stream_reader_log", f"SELECT profile_id, item_id, type, value, created_at FROM batched_signals WHERE created_at >= TIMESTAMP '{HALF}' AND item_id IN (SELECT doc_id FROM documents)", "batched_signals")
def stream_reader_log(spark, d):
    return reader_store(spark, d).read("log").drop("id")
