"""Continuous forms of the jobs on Structured Streaming.

Micro-batch outputs go to ``<path>/batch_id=N``, each written by overwrite, so a replayed batch replaces its
own earlier try and nothing else. The current state of a key is its row in the latest batch. Every
``COMPACT_EVERY`` batches the state is written to ``<path>_base`` as a whole, and a batch reads the last such
base and the few batches after it, not the whole history.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators import feed
from ..operators.increments import cluster_changes
from ..operators.item_store import ItemStore
from ..operators.upsert import KEY
from ..plans.ingest import clean_entries
from ..plans.reader_store import ReaderStore
from ..session import delete_path, list_paths, materialize, release_scratch, scratch_count, scratch_path


COMPACT_EVERY = 20
#: Stories may be as old as the age policy admits and dated as far ahead as it tolerates.
STORY_DELAY = f"{max(K.MAX_AGE_HOURS.values()) + K.FUTURE_TOLERANCE_HOURS} hours"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over everything available into a table in the shared folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, each, checkpoint: str, mode: str = "append", every: str | None = None):
    """Apply ``each(batch_df, batch_id)`` to everything available and return; with ``every`` (such as
    ``"1 minute"``) keep running and return the query. A run with the same checkpoint goes on where one ended."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if not every:
        query.awaitTermination()
    return query


def start_log(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empty first entries make a log and its base readable before anything arrives; a log that exists stays."""
    for folder in (path, f"{path}_base"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch_id=-1")


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest row per key of a batch log, optionally as it stood before a batch."""
    full = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    log, bases = (spark.read.schema(full).option("basePath", p).parquet(p) for p in (path, f"{path}_base"))
    if before is not None:
        log = log.filter(F.col("batch_id") < before)
    written = [int(f.split("/batch_id=")[1].split("/")[0]) for f in bases.inputFiles()]
    base = max((b for b in written if before is None or b < before), default=-1)
    log = log.filter(F.col("batch_id") > base).unionByName(bases.filter(F.col("batch_id") == base))
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("row"))
    return newest.select(*keys, "row.*").select(*[f.name for f in schema.fields])


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], batch_id: int) -> None:
    """Write the state after every ``COMPACT_EVERY``-th batch as a base."""
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        latest(spark, path, schema, keys, before=batch_id + 1).write.mode("overwrite").parquet(f"{path}_base/batch_id={batch_id}")


class Folded(NamedTuple):
    """A stream whose batches are folded with a stored state. ``step(batch, batch_id, path)`` gives what comes out of a
    batch, goes on from the newest state of an earlier batch under ``path`` and leaves its own there, so that a batch
    that is replayed gives the same again."""

    stream: DataFrame
    schema: T.StructType
    step: Callable[[DataFrame, int, str], DataFrame]


def drain_updates(stream: DataFrame | Folded, keys: list[str], name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregation in update mode over everything available: the current row of every key, open windows included."""
    fold, schema = (stream.step, stream.schema) if isinstance(stream, Folded) else (None, stream.schema)
    source = stream.stream if fold else stream
    spark = source.sparkSession
    out, checkpoint = out or scratch_path(spark, name), checkpoint or scratch_path(spark, f"{name}-cp")
    start_log(spark, out, schema)

    def each(batch: DataFrame, batch_id: int) -> None:
        begun = scratch_count()
        rows = fold(batch, batch_id, f"{out}_state") if fold else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        release_scratch(spark, begun)
        compact(spark, out, schema, keys, batch_id)

    run_batches(source, each, checkpoint, "update")
    return latest(spark, out, schema, keys)


def unique_entries(stream: DataFrame, delay: str = STORY_DELAY) -> DataFrame:
    """Each (source, guid, fingerprint) once, with state bounded by the age policy."""
    return stream.withWatermark("published_at", delay).dropDuplicatesWithinWatermark([*KEY, "fingerprint"])


def ingest_stream(
    raw: DataFrame, sources: DataFrame, store: ItemStore, checkpoint: str, now: Column | Callable[[], Column], taxonomy=None,
    once_within: str | None = None, every: str | None = None, clusters: bool = False, merge_every: int = COMPACT_EVERY,
):
    """Continuous upsert into an item store: a micro-batch looks up and rewrites what it touches.

    A batch is one commit, marked with its number, so that a batch that is replayed after a stop changes nothing.
    ``now`` may be a function, called for every batch. With ``once_within`` (a delay such as ``STORY_DELAY``) an
    entry that lands again unchanged within it is dropped on the way; it then is not seen again either. With
    ``clusters`` the titles that changed are clustered after each batch. Every ``merge_every`` batches the store is
    merged and what no reader of the last two states needs is deleted.
    """
    if once_within:
        content = F.sha2(F.to_json(F.struct(*[c for c in raw.columns if c != "ord"])), 256)
        raw = unique_entries(raw.withColumn("fingerprint", content), once_within).drop("fingerprint")

    def each(batch: DataFrame, batch_id: int) -> None:
        begun = scratch_count()
        at = now() if callable(now) and not isinstance(now, Column) else now
        if not store.has_done(batch_id):
            store.upsert(clean_entries(batch, sources, at, taxonomy), at, batch_id)
        if clusters:
            cluster_changes(store, sources, at)
        if batch_id % merge_every == merge_every - 1:
            store.merge(most=1)
            store.vacuum()
        release_scratch(store.spark, begun)

    return run_batches(raw, each, checkpoint, every=every)


def _on_store(stream: DataFrame, store: ReaderStore, fold, items, checkpoint: str, every: str | None, merge_every: int):
    def each(batch: DataFrame, batch_id: int) -> None:
        begun = scratch_count()
        if not store.has_done(batch_id):
            fold(batch, items() if callable(items) else items, batch_id)
        if batch_id % merge_every == merge_every - 1:
            store.merge(most=1)
            store.vacuum()
        release_scratch(store.spark, begun)

    return run_batches(stream, each, checkpoint, every=every)


def reader_stream(requests: DataFrame, items: DataFrame | Callable[[], DataFrame], store: ReaderStore, checkpoint: str, every: str | None = None, merge_every: int = COMPACT_EVERY):
    """Landed requests of readers (see ``ReaderStore.apply``) folded as they come: log, affinities, saves, mutes, profiles.

    ``items`` may be a function, called for every batch. A batch is one commit marked with its number, so that one
    that is replayed changes nothing. Every ``merge_every`` batches the store is merged and old folders are deleted.
    """
    return _on_store(requests, store, store.apply, items, checkpoint, every, merge_every)


def affinity_stream(signals: DataFrame, items: DataFrame | Callable[[], DataFrame], store: ReaderStore, checkpoint: str, every: str | None = None, merge_every: int = COMPACT_EVERY):
    """Continuous affinity fold of parsed signals: a batch goes on from the weights in the buckets of its profiles."""
    return _on_store(signals, store, store.fold, items, checkpoint, every, merge_every)


def bursts(stories: DataFrame, delay: str = STORY_DELAY) -> DataFrame:
    """Worlds with three or more news or social stories inside a sliding 45 minutes; to be run in update mode."""
    fast = stories.filter(F.col("source_class").isin("news", "social")).withWatermark("published_at", delay)
    w = F.window("published_at", f"{K.BREAKING_BURST_MINUTES} minutes", "5 minutes")
    rows = fast.select("published_at", F.explode(feed.slugs_of(F.col("topics"))).alias("slug"))
    return rows.groupBy(w.alias("w"), "slug").agg(F.count("*").alias("stories")).filter(
        F.col("stories") >= K.BREAKING_BURST_COUNT
    ).select("slug", F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "stories")


def _halved(micros: Column) -> Column:
    return F.pow(F.lit(2.0), -micros / F.lit(3.6e9 * K.ACTIVITY_HALF_LIFE_HOURS))


def hourly_activity(stories: DataFrame, delay: str = STORY_DELAY) -> DataFrame:
    """Stories per world and hour, and their mass decayed to the hour's end; to be run in update mode."""
    rows = stories.withWatermark("published_at", delay).select("published_at", F.explode(feed.slugs_of(F.col("topics"))).alias("slug"))
    into = F.unix_micros("published_at") % F.lit(3_600_000_000)
    return rows.groupBy(F.window("published_at", "1 hour").alias("w"), "slug").agg(
        F.count("*").alias("stories"), F.sum(_halved(F.lit(3_600_000_000) - into)).alias("mass")
    ).select("slug", F.col("w.start").alias("hour"), "stories", "mass")


def activity_at(hours: DataFrame, now: Column) -> DataFrame:
    """Activity per world from hourly masses; exact where no story is dated after ``now``, as after ingest."""
    left = F.unix_micros(now) - F.unix_micros("hour") - F.lit(3_600_000_000)
    return hours.groupBy("slug").agg(F.tanh(F.sum(F.col("mass") * _halved(left)) / K.ACTIVITY_SCALE).alias("activity"))


DWELL_KEY = ["profile_id", "item_id", "started_at"]
WITHDRAWN = -1
def read_sessions(ts: np.ndarray, visible: np.ndarray, gap: int, started: int | None = None, visible_for: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, start and visible microseconds of each session of events in order of time: the rule of
    ``dwell_sessions`` over arrays.

    ``started`` and ``visible_for`` continue a session whose latest event is the first one given.
    """
    steps = np.diff(ts)
    first = np.concatenate([[0], np.flatnonzero(steps >= gap) + 1])
    seen = np.append(np.where(visible[:-1] & (steps < gap), steps, 0), 0)
    starts, sums = ts[first], np.add.reduceat(seen, first)
    if started is not None:
        starts[0], sums[0] = started, sums[0] + visible_for
    return first, starts, sums


_OPEN = ["profile_id", "item_id", "ts", "visible", "started", "visible_for", "shown"]


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}")).alias("us")).first().us


def _in_sessions(rows: DataFrame, gap: int) -> DataFrame:
    """``_OPEN`` rows with the ``start`` of their session, the visible microseconds ``seen`` in it so far and the ``next`` event."""
    c = F.col
    key = Window.partitionBy("profile_id", "item_id").orderBy("ts", "visible")
    upto = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"before": F.lag("ts").over(key), "was_visible": F.lag("visible").over(key), "next": F.lead("ts").over(key)})
    first = c("before").isNull() | (c("ts") - c("before") >= gap)
    # The first event of a session adds nothing, unless it goes on from a settled one.
    rows = rows.withColumns({"first": first, "adds": F.when(first, F.coalesce("visible_for", F.lit(0))).when(c("was_visible"), c("ts") - c("before")).otherwise(0)})
    rows = rows.withColumn("sum", F.sum("adds").over(upto))
    begun = F.when(c("first"), F.struct(F.coalesce("started", "ts").alias("start"), (c("sum") - c("adds")).alias("base")))
    rows = rows.withColumn("begun", F.last(begun, ignorenulls=True).over(upto))
    return rows.withColumns({"start": c("begun.start"), "seen": c("sum") - c("begun.base")})


def dwell_sessions(visibility: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> Folded:
    """Visible seconds per reading session so far; to be run in update mode with the keys ``DWELL_KEY``.

    The state is a table: of each open session of a (profile, item) its running sum with its last settled event, and
    the events of the last ``delay``, which may still come out of order. It is laid under the events of a batch and
    all keys are folded by windows in one job; sessions that can no longer grow leave it. A session comes out with
    each batch that touches it, so open ones are there at the end of a run. When a late event moves the start of a
    session, its row under the old start comes out with ``WITHDRAWN`` seconds. Events later than ``delay`` are dropped.
    """
    spark, c = visibility.sparkSession, F.col
    span, wait = _micros(spark, gap), _micros(spark, delay)
    kinds = {f.name: f.dataType.simpleString() for f in visibility.schema}
    keys = f"profile_id {kinds['profile_id']}, item_id {kinds['item_id']}"
    state = f"{keys}, ts bigint, visible boolean, started bigint, visible_for bigint, shown boolean"
    events = visibility.select("profile_id", "item_id", "ts", "visible")

    def step(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
        spark = batch.sparkSession
        known = sorted(int(f.rsplit("=", 1)[1]) for f in list_paths(spark, f"{path}/batch_id=*"))
        earlier = max((n for n in known if n < batch_id), default=None)
        stored, water = spark.createDataFrame([], state), None
        if earlier is not None:
            stored = spark.read.schema(state).parquet(f"{path}/batch_id={earlier}/open")
            water = spark.read.schema("water bigint").parquet(f"{path}/batch_id={earlier}/water").first().water
        fresh = batch.select("profile_id", "item_id", F.unix_micros("ts").alias("ts"), F.coalesce("visible", F.lit(False)).alias("visible"), F.lit(True).alias("fresh")).where("ts IS NOT NULL")
        if water is not None:
            fresh = fresh.where(c("ts") > water)
        newest = fresh.agg(F.max("ts").alias("ts")).first().ts
        settled = max(((newest // 1000 * 1000 - wait,) if newest is not None else ()) + ((water,) if water is not None else ()), default=None)
        rows = materialize(_in_sessions(fresh.unionByName(stored, allowMissingColumns=True), span), "sessions")
        # Up to the new watermark only the last event of a session that may grow is kept, with what came before it.
        late = c("ts") > F.lit(settled).cast("bigint")
        tip = (c("next").isNull() | (c("next") > settled)) & (c("ts") + span > settled)
        left = rows.where(late | tip).select(
            "profile_id", "item_id", "ts", "visible", F.when(~late, c("start")).alias("started"), F.when(~late, c("seen")).alias("visible_for"), (c("ts") == c("start")).alias("shown"),
        )
        left.select(*_OPEN).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/open")
        spark.range(1).select(F.lit(settled).cast("bigint").alias("water")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/water")
        for n in known:
            if earlier is not None and n < earlier:
                delete_path(spark, f"{path}/batch_id={n}")
        moved = F.when(c("shown") & c("started").isNull() & (c("ts") != c("start")), F.struct(c("ts").alias("start"), F.lit(None).cast("bigint").alias("seen"), F.lit(True).alias("fresh")))
        out = rows.select("profile_id", "item_id", F.inline(F.array_compact(F.array(F.struct("start", "seen", F.coalesce("fresh", F.lit(False)).alias("fresh")), moved))))
        out = out.groupBy("profile_id", "item_id", "start").agg(F.max("seen").alias("seen"), F.bool_or("fresh").alias("fresh")).where("fresh")
        seconds = F.coalesce(F.floor(c("seen") / 1e6 + 0.5).cast("bigint"), F.lit(WITHDRAWN).cast("bigint"))
        return out.select("profile_id", "item_id", F.timestamp_micros("start").alias("started_at"), seconds.alias("seconds"))

    return Folded(events, T._parse_datatype_string(f"{keys}, started_at timestamp, seconds bigint"), step)


def read_times(sessions: DataFrame) -> DataFrame:
    """The sessions that count: those with a start that still holds and enough visible time."""
    return sessions.filter(F.col("seconds") >= K.MIN_DWELL_SECONDS)
