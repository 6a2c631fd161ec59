"""Streams against the batch form: late files, a stop and a restart, compacted logs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import affinity
from storyloom.plans.reader_store import ReaderStore
from storyloom.streaming import jobs

START = datetime.datetime(2026, 5, 1)


@pytest.fixture
def small_bases(monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT_EVERY", 2)


def write_files(spark, rows, schema, path, n):
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.mode("append").parquet(path)


def test_open_windows_and_late_stories(spark, tmp_path, small_bases):
    """Stories of many weeks land in random order, in two runs of one stream; every hour and burst comes out."""
    rng = random.Random(4)
    schema = "id bigint, topics array<string>, source_class string, published_at timestamp"
    rows = [(i, rng.choice([["tech"], ["nba", "world"], []]), rng.choice(["news", "social", "longform"]), START + datetime.timedelta(minutes=rng.choice([rng.randint(0, 50_000), rng.randint(0, 120)]))) for i in range(240)]
    path = str(tmp_path / "in")
    parts = {"hours": (jobs.hourly_activity, ["slug", "hour"]), "bursts": (jobs.bursts, ["slug", "starts_at"])}
    for half in (rows[:120], rows[120:]):
        write_files(spark, half, schema, path, 3)
        for name, (job, keys) in parts.items():
            stream = jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)
            found = jobs.drain_updates(job(stream), keys, name, str(tmp_path / name), str(tmp_path / f"{name}-cp"))
    whole = spark.createDataFrame(rows, schema)
    for name, (job, keys) in parts.items():
        stream = jobs.latest(spark, str(tmp_path / name), job(whole).schema, keys)
        rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert rounded(stream) == rounded(job(whole)) and stream.count() > 0
    assert found.count() == stream.count()
    now = F.lit(START + datetime.timedelta(days=40))
    hours = jobs.latest(spark, str(tmp_path / "hours"), jobs.hourly_activity(whole).schema, ["slug", "hour"])
    got = {r.slug: r.activity for r in jobs.activity_at(hours, now).collect()}
    mass = sum(0.5 ** ((datetime.timedelta(days=40) - (r[3] - START)).total_seconds() / 86_400) for r in rows)
    import math

    assert got["today"] == pytest.approx(math.tanh(mass / 40))


def test_affinities_after_a_restart(spark, tmp_path):
    """Micro-batches with a stop in between fold to what one fold of the whole log gives."""
    items = spark.createDataFrame([(i, i % 3, f"A{i % 2}", ["tech"]) for i in range(6)], "id bigint, source_id bigint, author string, topics array<string>")
    schema = "id bigint, profile_id string, item_id bigint, type string, value double, created_at timestamp"
    rng = random.Random(9)
    log = [(i, f"p{rng.randint(0, 3)}", rng.randint(0, 5), rng.choice(["open", "save", "less_like", "read_time"]), 30.0, START + datetime.timedelta(hours=i)) for i in range(60)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (log[:24], log[24:]):
        for k in range(0, len(part), 12):
            spark.createDataFrame(part[k : k + 12], schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)
        store = ReaderStore.create(spark, out, buckets=4)
        jobs.affinity_stream(stream, items, store, str(tmp_path / "cp"), merge_every=2)
    rounded = lambda df: sorted((r.profile_id, r.dimension, r.key, round(r.weight, 9), r.updated_at) for r in df.collect())
    assert rounded(store.read("affinities")) == rounded(affinity.fold_affinities(spark.createDataFrame(log, schema), items))
    # Versions: 1 the start, 2 and 3 batches, 4 their merge, 5 and 6 batches, 7 their merge, which keeps the state before it, 8 a batch.
    left = {int(p.name.split("=")[1]) for p in (tmp_path / "out" / "affinities").glob("*/version=*")}
    assert {7, 8} <= left <= {4, 5, 6, 7, 8}


def test_unique_entries_of_any_admitted_age(spark, tmp_path):
    schema = "source_id bigint, guid string, fingerprint string, published_at timestamp"
    rows = [(1, f"g{i % 20}", f"f{i % 40}", START + datetime.timedelta(hours=(i % 40) * 30)) for i in range(120)]
    random.Random(2).shuffle(rows)
    write_files(spark, rows, schema, str(tmp_path / "in"), 4)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1)
    got = jobs.drain(jobs.unique_entries(stream), "unique")
    assert sorted(map(tuple, got.select("guid", "fingerprint").collect())) == sorted({(r[1], r[2]) for r in rows})


def plain_sessions(events, gap):
    """(profile, item, start, seconds) by going through each reader's events in order."""
    found, by = [], {}
    for p, i, ts, visible in sorted(events):
        by.setdefault((p, i), []).append((ts, visible))
    for key, rows in by.items():
        session = None
        for ts, visible in rows:
            if session is None or ts - session["last"] >= gap:
                session = {"start": ts, "last": ts, "since": None, "sum": datetime.timedelta()}
                found.append((key, session))
            elif session["since"] is not None:
                session["sum"] += ts - session["since"]
            session["last"], session["since"] = ts, ts if visible else None
    return sorted((*k, s["start"], int(s["sum"].total_seconds() + 0.5)) for k, s in found if s["sum"].total_seconds() >= 4.5)


def test_dwell_sessions_open_late_and_restarted(spark, tmp_path):
    """Events in files that overlap by less than the delay, a stop between; open sessions are there after each run."""
    rng = random.Random(6)
    gap = datetime.timedelta(minutes=30)
    events = sorted(
        ((f"p{rng.randint(0, 2)}", rng.randint(0, 1), START + datetime.timedelta(seconds=rng.randint(0, 60_000), microseconds=rng.choice([0, 400_000])), rng.random() < 0.7) for _ in range(260)),
        key=lambda e: e[2],
    )
    events += [("p9", 1, START, True), ("p9", 1, START, False), ("p9", 1, START + datetime.timedelta(minutes=5), True), ("p9", 1, START + datetime.timedelta(minutes=35), True)]
    events.sort(key=lambda e: e[2])
    # Each event may land one file late, by less than the delay.
    files = [[] for _ in range(8)]
    for n, e in enumerate(events):
        at = min(7, n * 8 // len(events))
        late = at < 7 and (n * 8 / len(events)) % 1 > 0.85 and rng.random() < 0.5
        files[at + late].append(e)
    schema, path = "profile_id string, item_id bigint, ts timestamp, visible boolean", str(tmp_path / "in")
    out, cp, landed = str(tmp_path / "out"), str(tmp_path / "cp"), []
    for part in (files[:3], files[3:7], files[7:]):
        for rows in part:
            landed += rows
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)
        got = jobs.read_times(jobs.drain_updates(jobs.dwell_sessions(stream, "30 minutes", "40 minutes"), jobs.DWELL_KEY, "dwell", out, cp))
        assert sorted(tuple(r) for r in got.select("profile_id", "item_id", "started_at", "seconds").collect()) == plain_sessions(landed, gap)
    assert len(plain_sessions(landed, gap)) > 20


def test_sessions_of_many_readers_in_one_job(spark, tmp_path):
    """All keys of a batch are folded by Spark's windows, not one call of Python each; only open sessions stay stored."""
    at = lambda m: START + datetime.timedelta(minutes=m)
    schema = "profile_id string, item_id bigint, ts timestamp, visible boolean"
    first = [(f"p{n}", 1, at(n % 3), True) for n in range(50)] + [("late", 1, at(50), True), ("open", 2, at(58), True), ("open", 2, at(60), None), ("open", 2, None, True)]
    second = [("late", 1, at(49), True), ("late", 1, at(20), True), ("open", 2, at(61), True), ("p1", 1, at(61), True)]
    fold, path = jobs.dwell_sessions(spark.createDataFrame([], schema), "30 minutes", "20 minutes"), str(tmp_path / "s")
    took = []
    for n, rows in enumerate([first, second, second]):
        out = fold.step(spark.createDataFrame(rows, schema), min(n, 1), path)
        assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()
        assert out.schema == fold.schema or out.schema.simpleString() == fold.schema.simpleString()
        took.append(sorted(tuple(r) for r in out.collect()))
    assert len(took[0]) == 52 and took[1] == took[2]
    assert took[1] == [("late", 1, at(49), 60), ("late", 1, at(50), jobs.WITHDRAWN), ("open", 2, at(58), 120), ("p1", 1, at(61), 0)]
    stored = spark.read.parquet(f"{path}/batch_id=0/open")
    assert {r.profile_id for r in stored.collect()} == {"late", "open"}


def test_sessions_of_a_hot_reader():
    """A session's sum does not depend on where its events were settled."""
    import numpy as np

    rng = np.random.default_rng(1)
    ts = np.cumsum(rng.integers(0, 40, 5000))
    visible = rng.random(5000) < 0.5
    _, starts, sums = jobs.read_sessions(ts, visible, 38)
    for cut in (1, 17, 2500, 4999):
        first, opened, summed = jobs.read_sessions(ts[:cut], visible[:cut], 38)
        _, rest, more = jobs.read_sessions(ts[cut - 1 :], visible[cut - 1 :], 38, opened[-1], summed[-1])
        assert [*opened[:-1], *rest] == starts.tolist() and [*summed[:-1], *more] == sums.tolist()
