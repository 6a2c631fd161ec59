"""The reader store against whole-table jobs: pruned buckets, replays, restarts, mutes, profiles, large requests."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import affinity
from storyloom.plans import signals as S
from storyloom.plans.reader_store import ReaderStore
from storyloom.streaming import jobs

START = datetime.datetime(2026, 5, 1)
REQUESTS = "profile_id string, batch_id bigint, received_at timestamp, route string, payload string"
ITEMS = "id bigint, source_id bigint, author string, topics array<string>"


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Many small plans over few rows: compiling each of them takes longer than running it."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, i % 4, f"A{i % 2}", ["tech", "ai"][: i % 3]) for i in range(12)], ITEMS)


def landed(seed, n):
    """Requests of all routes, some of them void."""
    rng, rows = random.Random(seed), []
    for b in range(n):
        p, at = rng.choice(["p0", "p1", "p2", "p3", "p4", None]), START + datetime.timedelta(hours=b // 2)
        route = rng.choice(["signals", "signals", "mute", "mute", "profile", "other"])
        entries = [{"itemId": rng.randint(0, 13), "type": rng.choice(["save", "unsave", "open", "hide_source", "bogus"])} for _ in range(rng.randint(0, 5))]
        body = {
            "signals": {"signals": entries}, "other": {},
            "mute": {"sourceId": rng.choice([0, 1, 2, 3, 2.5, "1"]), "muted": rng.choice([True, False, 0, 1, "", "x", None, [], {}])},
            "profile": {"interests": rng.choice([["nba", "x", 3, None, "ai"], "nba", [], None])},
        }[route]
        rows.append((p, b, at, route, json.dumps(body) if rng.random() < 0.95 else "{broken"))
    return rows


def plain(rows, items):
    """Saves, mutes and profiles by going through the requests in order."""
    source = {i.id: i.source_id for i in items.collect()}
    saves, mutes, profiles = {}, {}, {}
    for p, _, at, route, payload in rows:
        if p is None:
            continue
        body = json.loads(payload) if payload[:2] != "{b" else {}
        if route == "profile":
            asked = body.get("interests")
            profiles.setdefault(p, [None, None])[0] = [t for t in asked if t in ("nba", "ai")] if isinstance(asked, list) else []
        elif route == "mute" and isinstance(body.get("sourceId"), int):
            yes = body["muted"] not in (False, 0, "", None) or isinstance(body["muted"], (list, dict))
            mutes.setdefault((p, body["sourceId"]), at) if yes else mutes.pop((p, body["sourceId"]), None)
        elif route == "signals":
            for s in body.get("signals", []):
                if s["type"] == "bogus":
                    continue
                seen = profiles.setdefault(p, [None, None])
                seen[1] = at
                if s["itemId"] not in source:
                    continue
                if s["type"] == "save":
                    saves.setdefault((p, s["itemId"]), at)
                elif s["type"] == "unsave":
                    saves.pop((p, s["itemId"]), None)
                elif s["type"] == "hide_source":
                    mutes.setdefault((p, source[s["itemId"]]), at)
    return saves, mutes, {p: tuple(v) for p, v in profiles.items()}


def held(store):
    read = lambda name: store.read(name).collect()
    return (
        {(r.profile_id, r.item_id): r.created_at for r in read("saves")}, {(r.profile_id, r.source_id): r.created_at for r in read("mutes")},
        {r.profile_id: (r.interests, r.last_seen_at) for r in read("profiles")},
    )


def test_stream_with_restart_equals_plain_state(spark, items, tmp_path):
    """Two runs of one stream, merges in between; the state is that of the requests in order, and old folders go."""
    rows = landed(3, 120)
    store = ReaderStore.create(spark, str(tmp_path / "s"), buckets=3)
    for low in (0, 60):
        spark.createDataFrame(rows[low : low + 60], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], REQUESTS).schema, files_per_batch=1)
        jobs.reader_stream(stream, lambda: items, ReaderStore.create(spark, str(tmp_path / "s")), str(tmp_path / "cp"), merge_every=1)
        assert held(store) == plain(rows[: low + 60], items)
    log = store.read("log")
    whole = affinity.fold_affinities(log, items)
    rounded = lambda df: sorted((r.profile_id, r.dimension, r.key, round(r.weight, 9), r.updated_at) for r in df.collect())
    assert rounded(store.read("affinities")) == rounded(whole) and log.count() > 50
    assert store.tables.manifest().facts["batch"] == 1
    assert len(list((tmp_path / "s" / "saves").glob("*/version=*"))) <= 3 * 3


def test_a_batch_opens_the_buckets_of_its_profiles_only(spark, items, tmp_path):
    n = 8
    stored = spark.createDataFrame([(f"p{i}", "topic", "tech", 1.0, START) for i in range(200)], "profile_id string, dimension string, key string, weight double, updated_at timestamp")
    none = lambda key: spark.createDataFrame([], f"profile_id string, {key} bigint, created_at timestamp")
    store = ReaderStore.create(spark, str(tmp_path / "s"), S.ReaderState(stored, none("item_id"), none("source_id")), buckets=n)
    batch = spark.createDataFrame([("p7", 1, START, "signals", '{"signals": [{"itemId": 1, "type": "save"}]}')], REQUESTS)
    read = store._of(batch, store.tables.manifest())["affinities"]
    opened = {f.split("/bucket=")[1].split("/")[0] for f in read.inputFiles() if "/affinities/" in f}
    own = batch.select(store.bucket(n).alias("b")).first().b
    assert opened == {str(own)}
    store.apply(batch, items, 0)
    live = store.tables.manifest().live
    assert [b for b, v in live["affinities"].items() if len(v) > 1] == [str(own)] and list(live["saves"]) == [str(own)]
    assert store.has_done(0) and not store.has_done(1)
    assert store.read("affinities").where("profile_id <> 'p7'").count() == 199


def test_a_request_holds_any_number_of_entries(spark, items):
    """Entries count in their order even where a request holds more than a million."""
    n = (1 << 20) + 3
    payload = F.concat(F.lit('{"signals": ['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == n, '{"itemId":1,"type":"save"}').otherwise('{"itemId":1,"type":"x"}')), ","), F.lit("]}"))
    first = spark.range(1).select(F.lit("p").alias("profile_id"), F.lit(1).alias("batch_id"), F.lit(START).alias("received_at"), payload.alias("payload"))
    second = spark.range(1).select(F.lit("p").alias("profile_id"), F.lit(2).alias("batch_id"), F.lit(START).alias("received_at"), F.lit('{"signals":[{"itemId":1,"type":"unsave"}]}').alias("payload"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    stored = S.ReaderState(none("profile_id string, dimension string, key string, weight double, updated_at timestamp"), none("profile_id string, item_id bigint, created_at timestamp"), none("profile_id string, source_id bigint, created_at timestamp"))
    run = S.signals_job(first.unionByName(second), items, stored)
    assert run.log.count() == 2 and run.state.saves.count() == 0


def test_long_histories_with_ordered_ids(spark, items):
    """The chunked fold takes the same ids."""
    rows = [(f"p{i % 2}", i, START + datetime.timedelta(hours=i // 7), '{"signals":[{"itemId":%d,"type":"%s"},{"itemId":2,"type":"open"}]}' % (i % 12, ["save", "less_like"][i % 2])) for i in range(60)]
    batches = spark.createDataFrame(rows, "profile_id string, batch_id bigint, received_at timestamp, payload string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    stored = S.ReaderState(none("profile_id string, dimension string, key string, weight double, updated_at timestamp"), none("profile_id string, item_id bigint, created_at timestamp"), none("profile_id string, source_id bigint, created_at timestamp"))
    log = S.signals_job(batches, items, stored).log
    rounded = lambda df: sorted((r.profile_id, r.dimension, r.key, round(r.weight, 9)) for r in df.collect())
    assert rounded(affinity.fold_affinities(log, items, heavy_profile=10)) == rounded(affinity.fold_affinities(log, items))
