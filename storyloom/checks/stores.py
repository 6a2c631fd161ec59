"""Ingest, upsert, ledger, reader-log and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import demo
from ..functions import story as S
from ..functions import text as T
from ..functions.story import minutes
from ..operators import filters as L
from ..operators import logs, repair, upsert
from ..operators.item_store import ItemStore
from ..plans import ingest
from ..session import materialize, scratch_path
from .base import NOW, TABLES, check, classify_sql, quote, sql_list
from .landed import _escape_sql
from .texts import excerpt_sql, squeeze_sql


def raw_entries(spark, d):
    i = F.col("doc_id")
    src = F.substring("source", 4, 10).cast("bigint")
    url = F.concat(F.lit("https://Src"), src, F.lit(".example.com/story/"), i, F.lit("/?utm_source=a&id="), i)
    return demo.table(spark, d, "documents").select(
        src.alias("source_id"), F.concat(F.lit("doc-"), i).alias("guid"), i.alias("ord"),
        F.concat(F.lit(" "), demo.first_sentence(F.col("text"))).alias("title"), url.alias("url"),
        F.when(i % 9 == 0, F.concat(F.lit("https://wire.example.com/"), i, F.lit("#x"))).alias("canonical_url"),
        F.when(i % 5 != 0, F.concat(F.lit(" Author "), i % 17)).alias("author"),
        F.when(i % 2 == 0, "null").alias("excerpt"),
        F.concat(F.lit("<p>"), T.escape_html(F.replace(F.replace("text", F.lit("<"), F.lit("(")), F.lit("&"), F.lit("+"))), F.lit("</p>")).alias("content_html"),
        F.lit(None).cast("string").alias("image_url"),
        (demo.now() - minutes((i * 37 % 100000).cast("int") - F.when(i % 23 == 0, 100000).otherwise(600).cast("int"))).alias("published_at"),
        F.when(i % 4 == 0, demo.now()).alias("updated_at"),
        F.when(i % 50 == 0, "retracted").alias("status_hint"), F.lit(None).cast("string").alias("correction_note"),
    )


TABLES["raw_entries"] = (
    "source_tier",
    f"""SELECT substr(source, 4)::bigint AS source_id, 'doc-' || doc_id AS guid, doc_id AS ord, ' ' || regexp_extract(text, '^[^.\n]*') AS raw_title,
    'https://src' || substr(source, 4) || '.example.com/story/' || doc_id || '/?id=' || doc_id AS clean_url, doc_id,
    CASE WHEN doc_id % 9 = 0 THEN 'https://wire.example.com/' || doc_id END AS wire, CASE WHEN doc_id % 5 <> 0 THEN 'Author ' || (doc_id % 17) END AS author,
    replace(replace(text, '<', '('), '&', '+') AS plain,
    {NOW} - to_minutes(doc_id * 37 % 100000 - CASE WHEN doc_id % 23 = 0 THEN 100000 ELSE 600 END) AS published_at,
    CASE WHEN doc_id % 4 = 0 THEN {NOW} END AS updated_at, CASE WHEN doc_id % 50 = 0 THEN 'retracted' ELSE 'active' END AS status FROM documents""",
)
TABLES["clean_rows"] = (
    "raw_entries source_tier",
    f"""SELECT r.*, s.cls, s.tier, least(published_at, {NOW}) AS shown_at FROM raw_entries r JOIN source_tier s ON s.id = r.source_id
    WHERE NOT ((cls = 'longform' OR (cls = 'social' AND tier = 'social')) AND author IS NULL)
    AND published_at >= {NOW} - to_hours(CASE cls WHEN 'social' THEN 48 WHEN 'longform' THEN 1440 ELSE 168 END)
    AND published_at <= {NOW} + to_hours(26)""",
)
# Titles and bodies hold no markup here except "<", which the builder of the bodies replaced.
TITLE_TEXT = squeeze_sql("regexp_replace(regexp_replace(raw_title, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g')")


TABLES["cleaned"] = (
    "clean_rows",
    f"""WITH t AS (SELECT *, {squeeze_sql('plain')} AS s, {TITLE_TEXT} AS title FROM clean_rows),
      e AS (SELECT *, {excerpt_sql('s')} AS excerpt, '<p>' || replace(plain, '>', '&gt;') || '</p>' AS body FROM t)
      SELECT source_id, guid, author, title, 'https://Src' || source_id || '.example.com/story/' || doc_id || '/?utm_source=a&id=' || doc_id AS url, coalesce(wire, clean_url) AS canonical_url, excerpt, shown_at AS published_at, updated_at, status, body,
      CASE WHEN s = '' THEN 0 ELSE len(str_split(s, ' ')) END AS word_count,
      CASE WHEN tier = 'social' THEN 'unconfirmed' ELSE 'reported' END AS verification_status,
      array_to_string({classify_sql("raw_title", "coalesce(excerpt, '')", f"[{sql_list(K.KNOWN_TOPICS)}[source_id % 10 + 1]]", demo.TEST_TAXONOMY)}, ',') AS topics,
      sha256(array_to_string(list_filter([title, excerpt, body, coalesce(wire, clean_url), status, CASE WHEN updated_at IS NOT NULL THEN '2024-01-31T00:00:00.000Z' END], lambda p: p IS NOT NULL), '␟')) AS content_fingerprint FROM e""",
)


@check("clean_entries", "SELECT source_id, guid, author, title, canonical_url, excerpt, published_at, status, word_count, verification_status, topics, content_fingerprint FROM cleaned", "cleaned")
def clean_entries(spark, d):
    rows = ingest.clean_entries(raw_entries(spark, d), demo.sources(spark, d), demo.now(), demo.TEST_TAXONOMY)
    return rows.select("source_id", "guid", "author", "title", "canonical_url", "excerpt", "published_at", "status", "word_count",
                       "verification_status", F.array_join("topics", ",").alias("topics"), "content_fingerprint")


@check("ingest_counts", """SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE kept AND fresh) AS inserted, count(*) FILTER (WHERE kept AND NOT fresh) AS updated
      FROM (SELECT r.source_id, r.doc_id % 3 = 0 AS fresh, c.guid IS NOT NULL AS kept FROM raw_entries r LEFT JOIN clean_rows c USING (guid)) GROUP BY source_id""", "clean_rows")
def ingest_counts(spark, d):
    stored = demo.items(spark, d).filter(F.col("id") % 3 != 0)
    return ingest.ingest_entries(raw_entries(spark, d), demo.sources(spark, d), stored, demo.now(), demo.TEST_TAXONOMY).stats


NEW_FEED = "https://new.example.com/feed"


def run_inputs(spark, d):
    """Registry, sources, entries and fetches: some are not due, some fail, some are unmodified, and the registry brings one more."""
    c = F.col
    stored_sources = demo.sources(spark, d)
    policy = [n for n in stored_sources.columns if n not in ("id", "active", "last_successful_fetch_at", "next_fetch_at", "last_status")]
    registry = stored_sources.filter("id % 3 = 0").select(*policy)
    registry = registry.unionByName(registry.orderBy("feed_url").limit(1).withColumns({"feed_url": F.lit(NEW_FEED), "name": F.lit("New")}))
    tries = stored_sources.select(
        c("id").alias("source_id"), demo.now().alias("at"), F.when(c("id") % 6 == 1, "HTTP 500").alias("error"), (c("id") % 6 == 2).alias("not_modified"))
    return registry, stored_sources, raw_entries(spark, d).filter("NOT source_id % 6 IN (1, 2)"), tries


def whole_run(spark, d) -> ingest.IngestRun:
    stored = demo.items(spark, d).filter(F.col("id") % 3 != 0)
    none = spark.createDataFrame([], "id bigint")
    registry, stored_sources, landed, tries = run_inputs(spark, d)
    return ingest.ingest_run(registry, stored_sources, landed, tries, stored, none, demo.now(), demo.TEST_TAXONOMY)


TABLES["run_sources"] = ("sources", f"SELECT *, active AND (next_fetch_at IS NULL OR next_fetch_at <= {NOW}) AS due FROM sources")
TABLES["run_rows"] = ("clean_rows run_sources", "SELECT c.source_id, c.guid, CASE WHEN c.doc_id % 3 = 0 THEN 'insert' ELSE 'update' END AS action FROM clean_rows c JOIN run_sources s ON s.id = c.source_id WHERE s.due AND NOT s.id % 6 IN (1, 2)")
TABLES["run_counts"] = (
    "raw_entries run_rows",
    """SELECT s.id, s.name, CASE WHEN id % 6 = 1 THEN 'HTTP 500' END AS error, coalesce(f.n, 0) AS fetched, coalesce(k.i, 0) AS inserted, coalesce(k.u, 0) AS updated FROM run_sources s
      LEFT JOIN (SELECT source_id, count(*) AS n FROM raw_entries WHERE NOT source_id % 6 IN (1, 2) GROUP BY 1) f ON f.source_id = s.id
      LEFT JOIN (SELECT source_id, count(*) FILTER (WHERE action = 'insert') AS i, count(*) FILTER (WHERE action = 'update') AS u FROM run_rows GROUP BY 1) k ON k.source_id = s.id WHERE due""",
)


@check("ingest_run_items", "SELECT * FROM run_rows", "run_rows")
def ingest_run_items(spark, d):
    run = whole_run(spark, d)
    if run.clustered is None:
        raise ValueError("items changed, so they must have been clustered")
    return run.rows.select("source_id", "guid", "action")


@check("store_run_items", f"""SELECT c.source_id, c.guid, c.title, c.content_fingerprint, c.topics, md5(c.body) AS body, CASE WHEN r.action = 'update' AND c.status = 'active' THEN 'updated' ELSE c.status END AS status, r.action
      FROM run_rows r JOIN cleaned c ON c.source_id = r.source_id AND c.guid = r.guid
      UNION ALL SELECT source_id, guid, title, content_fingerprint, array_to_string(topics, ','), md5(content_html), status, NULL FROM items WHERE id % 3 <> 0 AND guid NOT IN (SELECT guid FROM run_rows)""", "run_rows cleaned items")
def store_run_items(spark, d):
    """The run into a store: its whole content, and what the run did to each item."""
    stored = materialize(demo.items(spark, d).filter("id % 3 <> 0"), "stored")
    store = ItemStore.create(scratch_path(spark, "store"), stored, buckets=8)
    registry, stored_sources, landed, tries = run_inputs(spark, d)
    run = ingest.ingest_run_into(store, registry, stored_sources, landed, tries, demo.now(), demo.TEST_TAXONOMY, number=0)
    actions = run.rows.select("source_id", "guid", "action")
    rows = store.items().select("source_id", "guid", "title", "content_fingerprint", F.array_join("topics", ",").alias("topics"), F.md5("content_html").alias("body"), "status")
    return rows.join(actions, upsert.KEY, "left")


@check("ingest_run_ledger", f"""SELECT s.id, s.feed_url, CASE WHEN c.id IS NULL THEN next_fetch_at ELSE {NOW} + to_minutes(CASE WHEN error IS NULL THEN poll_interval_minutes ELSE least(5, poll_interval_minutes) END) END AS next_fetch_at,
      CASE WHEN c.id IS NOT NULL THEN CASE WHEN error IS NOT NULL THEN 'error: HTTP 500' WHEN s.id % 6 = 2 THEN 'not-modified' ELSE 'ok:' || inserted || '+' || updated || 'u' END END AS last_status
      FROM run_sources s LEFT JOIN run_counts c ON c.id = s.id UNION ALL SELECT max(id) + 1, '{NEW_FEED}', NULL, NULL FROM sources""", "run_counts")
def ingest_run_ledger(spark, d):
    return whole_run(spark, d).sources.select("id", "feed_url", "next_fetch_at", "last_status")


@check("ingest_run_stats", "SELECT name AS source, sum(fetched)::bigint AS fetched, sum(inserted)::bigint AS inserted, sum(updated)::bigint AS updated, count(error) AS errors FROM run_counts GROUP BY ROLLUP (name)", "run_counts")
def ingest_run_stats(spark, d):
    return whole_run(spark, d).stats


@check("ingest_run_errors", "SELECT name AS source, name || ': error: ' || error AS message FROM run_counts WHERE error IS NOT NULL", "run_counts")
def ingest_run_errors(spark, d):
    return whole_run(spark, d).errors


def upsert_inputs(spark, d):
    """Stored: two thirds of the items. Batch: half of the items, some twice, some unchanged."""
    items = demo.items(spark, d)
    stored = items.filter(F.col("id") % 3 != 0).withColumn(
        "content_fingerprint", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("content_fingerprint")))
    copy = F.explode(F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    batch = items.filter(F.col("id") % 2 == 0).withColumn("copy", copy)
    batch = batch.withColumns({
        "title": F.concat("title", F.lit(" v"), "copy"),
        "content_fingerprint": F.when((F.col("id") % 4 == 0) & (F.col("copy") != 1), F.col("content_fingerprint")).otherwise(
            F.concat(F.lit("fp"), F.col("id"), F.lit("-"), F.col("copy"))),
        "ord": F.col("id") * 3 + F.col("copy"),
    })
    return stored, batch


TABLES["stored"] = ("items", "SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN '' ELSE content_fingerprint END AS content_fingerprint) FROM items WHERE id % 3 <> 0")
TABLES["batch"] = (
    "items",
    """SELECT * REPLACE (title || ' v' || k AS title, CASE WHEN id % 4 = 0 AND k <> 1 THEN content_fingerprint ELSE 'fp' || id || '-' || k END AS content_fingerprint), k, id * 3 + k AS ord
    FROM (SELECT items.*, unnest(CASE WHEN id % 10 = 0 THEN [0, 1, 2] ELSE [0] END) AS k FROM items WHERE id % 2 = 0)""",
)
TABLES["changes"] = (
    "stored batch",
    """SELECT b.source_id, b.guid, b.title, b.status, b.ord, b.content_fingerprint, s.content_fingerprint AS old_fp, s.status AS old_status, s.id, s.title AS old_title, s.excerpt AS old_excerpt
    FROM batch b JOIN stored s USING (source_id, guid) WHERE b.content_fingerprint <> s.content_fingerprint""",
)


@check("item_upsert", f"""WITH last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY source_id, guid ORDER BY ord DESC) = 1),
      n AS (SELECT source_id, guid, count(*) AS n_changed FROM changes GROUP BY ALL),
      first AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY source_id, guid ORDER BY ord) = 1)
      SELECT f.source_id, f.guid, CASE WHEN s.id IS NULL THEN 'insert' WHEN l.guid IS NOT NULL THEN 'update' ELSE 'seen' END AS action,
      CASE WHEN s.id IS NULL THEN f.title WHEN l.guid IS NOT NULL THEN l.title ELSE s.title END AS title,
      CASE WHEN s.id IS NULL THEN f.status WHEN l.guid IS NOT NULL THEN CASE WHEN l.old_fp <> '' AND l.status = 'active' THEN 'updated' ELSE l.status END ELSE s.status END AS status,
      CASE WHEN s.id IS NULL OR l.guid IS NOT NULL THEN {NOW} ELSE s.updated_at END AS updated_at,
      CASE WHEN s.id IS NULL THEN {NOW} ELSE s.published_at END AS first_seen_at,
      CASE WHEN s.id IS NOT NULL AND l.guid IS NULL THEN s.cluster_id END AS cluster_id, coalesce(n_changed, 0)::bigint AS n_changed
      FROM first f LEFT JOIN stored s USING (source_id, guid) LEFT JOIN last l USING (source_id, guid) LEFT JOIN n USING (source_id, guid)""", "changes")
def item_upsert(spark, d):
    plan = upsert.plan_upsert(*upsert_inputs(spark, d), demo.now())
    return plan.rows.select("source_id", "guid", "action", "title", "status", "updated_at", "first_seen_at", "cluster_id", "n_changed")


@check("item_versions", f"""SELECT id AS item_id, old_title AS title, old_excerpt AS excerpt, old_fp AS content_fingerprint, old_status AS status, {NOW} AS captured_at
      FROM changes WHERE old_fp <> ''""", "changes")
def item_versions(spark, d):
    return upsert.plan_upsert(*upsert_inputs(spark, d), demo.now()).versions


@check("items_after_upsert", "SELECT guid, status, title FROM stored WHERE guid NOT IN (SELECT guid FROM batch) UNION ALL "
       "SELECT b.guid, CASE WHEN l.guid IS NULL THEN b.status WHEN l.old_fp <> '' AND l.status = 'active' THEN 'updated' ELSE l.status END, CASE WHEN l.guid IS NOT NULL THEN l.title ELSE coalesce(s.title, b.title) END "
       "FROM (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY guid ORDER BY ord) = 1) b LEFT JOIN stored s USING (guid) "
       "LEFT JOIN (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY guid ORDER BY ord DESC) = 1) l ON l.guid = b.guid", "changes")
def items_after_upsert(spark, d):
    stored, batch = upsert_inputs(spark, d)
    plan = upsert.plan_upsert(stored, batch, demo.now(), cut=lambda df: materialize(df, "upsert"))
    return upsert.apply_upsert(stored, upsert.assign_ids(plan.rows, stored)).select("guid", "status", "title")


@check("new_and_known_keys", "SELECT guid IN (SELECT guid FROM stored) AS known, count(DISTINCT guid) AS n FROM batch GROUP BY known", "changes")
def new_and_known_keys(spark, d):
    stored, batch = upsert_inputs(spark, d)
    keys = batch.select("source_id", "guid").distinct()
    new = keys.join(stored, upsert.KEY, "left_anti").agg(F.count("*").alias("n")).select(F.lit(False).alias("known"), "n")
    return new.unionByName(keys.join(stored, upsert.KEY, "left_semi").agg(F.count("*").alias("n")).select(F.lit(True).alias("known"), "n"))


@check("registry_sync", """SELECT coalesce(o.feed_url, n.feed_url) AS feed_url, CASE WHEN n.id IS NULL THEN o.name ELSE n.name || ' new' END AS name,
      CASE WHEN n.id IS NULL THEN o.quality_prior ELSE 0.9::double END AS quality_prior, o.next_fetch_at, coalesce(o.active, true) AS active
      FROM (SELECT * FROM sources WHERE id % 2 = 0) o FULL JOIN (SELECT * FROM sources WHERE id % 3 = 0) n ON o.feed_url = n.feed_url""", "sources")
def registry_sync(spark, d):
    s = demo.sources(spark, d).select("id", "feed_url", "name", "quality_prior", "next_fetch_at", "active")
    fresh = s.filter("id % 3 = 0").select("feed_url", F.concat("name", F.lit(" new")).alias("name"), F.lit(0.9).alias("quality_prior"))
    return upsert.sync_registry(s.filter("id % 2 = 0").drop("id"), fresh).select("feed_url", "name", "quality_prior", "next_fetch_at", "active")


def attempts(spark, d):
    e = F.col("event_id")
    return demo.table(spark, d, "events").select(
        (F.col("user_id") % 15).alias("source_id"), F.concat(F.lit("Source "), F.col("user_id") % 15).alias("source"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "error", F.repeat(F.concat(F.lit("HTTP "), F.col("event_id")), 40)).alias("error"),
        (F.col("event_type") == "signup").alias("not_modified"), (e % 9).alias("fetched"), (e % 4).alias("inserted"), (e % 3).alias("updated"))


TABLES["attempts"] = ("", """SELECT user_id % 15 AS source_id, 'Source ' || (user_id % 15) AS source, ts AS "at", CASE WHEN event_type = 'error' THEN repeat('HTTP ' || event_id, 40) END AS error,
    event_type = 'signup' AS not_modified, event_id % 9 AS fetched, event_id % 4 AS inserted, event_id % 3 AS updated FROM events""")


@check("fetch_ledger", """WITH a AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY attempts.at DESC) = 1)
      SELECT s.id, a.at AS last_fetched_at, CASE WHEN a.at IS NOT NULL AND error IS NULL THEN a.at ELSE last_successful_fetch_at END AS last_successful_fetch_at,
      CASE WHEN a.at IS NULL THEN next_fetch_at ELSE a.at + to_minutes(CASE WHEN error IS NULL THEN poll_interval_minutes ELSE least(5, poll_interval_minutes) END) END AS next_fetch_at,
      CASE WHEN a.at IS NOT NULL THEN CASE WHEN error IS NOT NULL THEN 'error: ' || substr(error, 1, 200) WHEN not_modified THEN 'not-modified' ELSE 'ok:' || inserted || '+' || updated || 'u' END END AS last_status
      FROM sources s LEFT JOIN a ON a.source_id = s.id""", "sources attempts")
def fetch_ledger(spark, d):
    return upsert.fetch_ledger(demo.sources(spark, d), attempts(spark, d)).select("id", "last_fetched_at", "last_successful_fetch_at", "next_fetch_at", "last_status")


@check("ingest_stats", "SELECT source, sum(fetched)::bigint AS fetched, sum(inserted)::bigint AS inserted, sum(updated)::bigint AS updated, count(error) AS errors FROM attempts GROUP BY ROLLUP (source)", "attempts")
def ingest_stats(spark, d):
    return upsert.ingest_stats(attempts(spark, d))


@check("ingest_errors", "SELECT source, source || ': error: ' || error AS message FROM attempts WHERE error IS NOT NULL", "attempts")
def ingest_errors(spark, d):
    return upsert.ingest_errors(attempts(spark, d))


@check("due_sources", f"SELECT id FROM sources WHERE active AND (next_fetch_at IS NULL OR next_fetch_at <= {NOW})", "sources")
def due_sources(spark, d):
    return L.due_sources(L.active_sources(demo.sources(spark, d)), demo.now()).select("id")


@check("age_policy", f"SELECT r.doc_id, (r.author IS NOT NULL OR NOT (cls = 'longform' OR (cls = 'social' AND tier = 'social'))) AS named, r.published_at >= {NOW} - to_hours(CASE cls WHEN 'social' THEN 48 WHEN 'longform' THEN 1440 ELSE 168 END) AS young, "
       f"r.published_at <= {NOW} + to_hours(26) AS near, least(r.published_at, {NOW}) AS shown_at FROM raw_entries r JOIN source_tier s ON s.id = r.source_id", "raw_entries source_tier")
def age_policy(spark, d):
    c = F.col
    s = demo.sources(spark, d).select(c("id").alias("source_id"), "source_class", "named_author_required")
    return raw_entries(spark, d).join(s, "source_id").select(
        c("ord").alias("doc_id"), L.has_named_author(c("named_author_required"), c("author")).alias("named"),
        L.is_young_enough(c("published_at"), c("source_class"), demo.now()).alias("young"),
        L.not_far_future(c("published_at"), demo.now()).alias("near"), L.clamp_to_now(c("published_at"), demo.now()).alias("shown_at"))


@check("signal_batches", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id % 15, event_id // 2500 ORDER BY event_id) AS n FROM events)
      SELECT 'p' || (user_id % 15) AS profile_id, event_id AS item_id, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'read_time' ELSE 'save' END AS type,
      CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN greatest(0, least(3600, (event_id % 9000) - 100))::double ELSE 1.0 END AS value
      , n <= 100 AS in_request FROM b WHERE event_type <> 'error' AND event_id % 8 <> 0""")
def signal_batches(spark, d):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "read_time").when(F.col("event_type") == "error", "bogus").otherwise("save")
    entry = F.concat(
        F.lit('{"itemId": '), F.when(e % 16 == 0, F.concat(F.lit('"'), e, F.lit('"'))).when(e % 16 == 8, F.concat(e, F.lit(".5"))).otherwise(e.cast("string")),
        F.lit(', "type": "'), kind, F.lit('"'),
        F.when(e % 3 == 0, "").when(e % 3 == 1, F.concat(F.lit(', "value": '), e % 9000 - 100)).otherwise(', "value": "7"'), F.lit("}"))
    batches = demo.table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 15).alias("profile_id"), F.floor(e / 2500).alias("batch_id"), e, entry.alias("entry")).groupBy("profile_id", "batch_id").agg(
        F.concat(F.lit('{"signals": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "entry"))), lambda s: s["entry"]), ","), F.lit("]}")).alias("payload"))
    cut = L.parse_signal_batches(batches, K.SIGNAL_BATCH_LIMIT).select("profile_id", "item_id", F.lit(True).alias("cut"))
    rows = L.parse_signal_batches(batches).join(cut, ["profile_id", "item_id"], "left")
    return rows.select("profile_id", "item_id", "type", "value", F.coalesce("cut", F.lit(False)).alias("in_request"))


@check("signals_on_known_items", "SELECT id, item_id FROM signals WHERE item_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')", "signals")
def signals_on_known_items(spark, d):
    known = demo.table(spark, d, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("id"))
    return L.known_items(demo.signals(spark, d), known).select("id", "item_id")


@check("valid_interests", f"""SELECT event_id, array_to_string(list_filter([event_type, {quote('nba')}, ['tech', 'bogus', 'media'][event_id % 3 + 1], 'ai', 'ai'], lambda t: list_contains({sql_list(K.KNOWN_TOPICS)}, t)), ',') AS interests,
      array_to_string(CASE WHEN event_id % 2 = 0 THEN {sql_list(K.DEFAULT_INTERESTS)} ELSE ['ai'] END, ',') AS chosen FROM events""")
def valid_interests(spark, d):
    e = F.col("event_id")
    asked = F.array(F.col("event_type"), F.lit("nba"), F.element_at(F.array(F.lit("tech"), F.lit("bogus"), F.lit("media")), (e % 3 + 1).cast("int")), F.lit("ai"), F.lit("ai"))
    return demo.table(spark, d, "events").select(
        "event_id", F.array_join(L.valid_interests(asked), ",").alias("interests"),
        F.array_join(L.interests_or_default(F.when(e % 2 == 1, F.array(F.lit("ai")))), ",").alias("chosen"))


SET_SQL = """WITH l AS (SELECT *, max(CASE WHEN NOT {add} THEN (created_at, id) END) OVER (PARTITION BY {keys}) AS removed FROM {log})
      SELECT {keys}, min(created_at) AS created_at FROM l WHERE {add} AND (removed IS NULL OR (created_at, id) > removed) GROUP BY ALL"""


@check("saved_items", SET_SQL.format(add="type = 'save'", keys="profile_id, item_id", log="(SELECT * FROM signals WHERE type IN ('save', 'unsave'))"), "signals")
def saved_items(spark, d):
    return logs.save_set(demo.signals(spark, d))


@check("muted_sources", SET_SQL.format(add="muted", keys="profile_id, source_id", log="""(
      SELECT g.id, profile_id, source_id, true AS muted, created_at FROM signals g JOIN docs i ON i.id = g.item_id WHERE type = 'hide_source'
      UNION ALL SELECT event_id, 'p' || user_id, event_id % 20, event_id % 3 > 0, ts FROM events WHERE event_type = 'signup')"""), "signals docs")
def muted_sources(spark, d):
    e = F.col("event_id")
    toggles = demo.table(spark, d, "events").filter("event_type = 'signup'").select(
        e.alias("id"), F.concat(F.lit("p"), "user_id").alias("profile_id"), (e % 20).alias("source_id"), (e % 3 > 0).alias("muted"), F.col("ts").cast("timestamp").alias("created_at"))
    return logs.mute_set(demo.signals(spark, d), toggles, demo.item_keys(spark, d))


def opens(spark, d):
    return demo.signals(spark, d).filter("type = 'open'").select("id", "profile_id", F.col("created_at").alias("opened_at"))


@check("profile_touches", "SELECT p.profile_id, greatest(last_feed_opened_at, max(created_at)) AS last_feed_opened_at FROM profiles p LEFT JOIN (SELECT * FROM signals WHERE type = 'open') s USING (profile_id) GROUP BY p.profile_id, last_feed_opened_at", "profiles signals")
def profile_touches(spark, d):
    return logs.touch_profiles(demo.profiles(spark, d), opens(spark, d)).select("profile_id", "last_feed_opened_at")


@check("new_since_marks", "SELECT id, lag(created_at) OVER (PARTITION BY profile_id ORDER BY created_at, id) AS new_since FROM signals WHERE type = 'open'", "signals")
def new_since_marks(spark, d):
    return logs.new_since(opens(spark, d)).select("id", "new_since")


@check("read_items", f"SELECT DISTINCT profile_id, item_id FROM signals WHERE type = 'open' AND created_at >= {NOW} - INTERVAL 14 DAY", "signals")
def read_items(spark, d):
    return logs.read_items(demo.signals(spark, d), demo.now())


VISIBILITY = "SELECT 'p' || user_id AS profile_id, event_id // 200 % 5 AS item_id, ts, event_id % 4 > 0 AS visible FROM events"


@check("dwell_times", f"""WITH v AS ({VISIBILITY}), s AS (SELECT *, lead(ts) OVER w AS until, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS starts FROM v WINDOW w AS (PARTITION BY profile_id, item_id ORDER BY ts)),
      g AS (SELECT *, sum(starts) OVER (PARTITION BY profile_id, item_id ORDER BY ts) AS reading FROM s)
      SELECT profile_id, item_id, min(ts) AS started_at, floor(sum(CASE WHEN visible AND until < ts + INTERVAL 12 HOUR THEN (epoch_us(until) - epoch_us(ts)) / 1e6 ELSE 0 END) + 0.5)::bigint AS seconds
      FROM g GROUP BY profile_id, item_id, reading HAVING floor(sum(CASE WHEN visible AND until < ts + INTERVAL 12 HOUR THEN (epoch_us(until) - epoch_us(ts)) / 1e6 ELSE 0 END) + 0.5) >= 5""")
def dwell_times(spark, d):
    e = F.col("event_id")
    v = demo.table(spark, d, "events").select(F.concat(F.lit("p"), "user_id").alias("profile_id"), (F.floor(e / 200) % 5).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), (e % 4 > 0).alias("visible"))
    return logs.dwell_times(v, "12 hours")


def duplicated(spark, d):
    items = demo.item_keys(spark, d).withColumn("guid", F.concat(F.lit("g"), F.floor(F.col("id") / 60)))
    saves = logs.save_set(demo.signals(spark, d))
    return items, demo.signals(spark, d).select("id", "profile_id", "item_id"), saves


TABLES["dups"] = ("docs", "SELECT id, source_id, 'g' || (id // 60) AS guid, max(id) OVER (PARTITION BY source_id, 'g' || (id // 60)) AS keeper_id FROM docs")


@check("duplicate_keepers", "SELECT id, keeper_id FROM dups WHERE id <> keeper_id", "dups")
def duplicate_keepers(spark, d):
    return repair.keepers(duplicated(spark, d)[0])


@check("repaired_items", "SELECT id, source_id, guid FROM dups WHERE id = keeper_id", "dups")
def repaired_items(spark, d):
    return repair.repair_duplicates(*duplicated(spark, d)).items.select("id", "source_id", "guid")


@check("repaired_signals", "SELECT s.id, coalesce(d.keeper_id, s.item_id) AS item_id FROM signals s LEFT JOIN dups d ON d.id = s.item_id", "signals dups")
def repaired_signals(spark, d):
    return repair.repair_duplicates(*duplicated(spark, d)).signals.select("id", "item_id")


@check("repaired_saves", "WITH sv AS (" + SET_SQL.format(add="type = 'save'", keys="profile_id, item_id", log="(SELECT * FROM signals WHERE type IN ('save', 'unsave'))").replace("WITH l AS", "WITH lg AS").replace("FROM l ", "FROM lg ") + """),
      m AS (SELECT profile_id, d.keeper_id AS item_id, min(created_at) AS created_at FROM sv JOIN dups d ON d.id = sv.item_id WHERE d.id <> d.keeper_id GROUP BY ALL),
      k AS (SELECT sv.* FROM sv LEFT JOIN dups d ON d.id = sv.item_id WHERE d.id IS NULL OR d.id = d.keeper_id)
      SELECT * FROM k UNION ALL SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.profile_id = m.profile_id AND k.item_id = m.item_id)""", "signals dups")
def repaired_saves(spark, d):
    return repair.repair_duplicates(*duplicated(spark, d)).saves


@check("word_count_backfill", "SELECT page_id, CASE WHEN length(html) > 500 THEN greatest(1, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) // 6) ELSE 0 END::int AS word_count FROM pages")
def word_count_backfill(spark, d):
    p = demo.table(spark, d, "pages").select("page_id", F.col("html").alias("content_html"), F.lit(0).alias("word_count"))
    return repair.backfill_word_count(p).select("page_id", "word_count")


@check("fetch_time_backfill", f"SELECT id, next_fetch_at AS last_fetched_at, CASE WHEN next_fetch_at IS NOT NULL THEN next_fetch_at ELSE last_successful_fetch_at END AS last_successful_fetch_at, CASE WHEN next_fetch_at IS NOT NULL THEN {NOW} END AS next_fetch_at FROM sources", "sources")
def fetch_time_backfill(spark, d):
    s = demo.sources(spark, d).withColumn("last_fetched_at", F.col("next_fetch_at"))
    return repair.backfill_fetch_times(s, demo.now()).select("id", "last_fetched_at", "last_successful_fetch_at", "next_fetch_at")
