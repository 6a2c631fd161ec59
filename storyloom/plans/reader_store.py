"""Stored reader state: affinities, saves, mutes and profiles by hash bucket of the profile, and the dated signal log.

A batch of requests opens the buckets of its own profiles and commits the rows of the keys it touches, all tables in
one step (see ``operators.versioned``), so its cost follows the batch and not the number of readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import affinity
from ..operators.versioned import VERSION, Layout, Manifest, VersionedTables
from ..session import broadcast_if_small, materialize
from .signals import MUTE_KEY, SAVE_KEY, ReaderState, parse_interests, parse_mutes, reader_changes

#: Hash buckets of a table; about one for every million of its rows.
BUCKETS = 64
#: Versions of a part that are read side by side before a merge.
MOST_VERSIONS = 8
BUCKET, DAY = "bucket", "day"

#: Table -> its columns and the key whose newest row counts.
_TABLES = {
    "affinities": ("profile_id string, dimension string, key string, weight double, updated_at timestamp", affinity.KEY),
    "saves": ("profile_id string, item_id bigint, created_at timestamp", SAVE_KEY),
    "mutes": ("profile_id string, source_id bigint, created_at timestamp", MUTE_KEY),
    "profiles": ("profile_id string, interests array<string>, last_seen_at timestamp", ["profile_id"]),
}
_LOG = "id struct<batch:bigint,place:int>, profile_id string, item_id bigint, type string, value double, created_at timestamp"


class ReaderStore:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        of = lambda ddl: T._parse_datatype_string(ddl)
        self.spark = spark
        layouts = {name: Layout(of(ddl), tuple(key), BUCKET, T.IntegerType()) for name, (ddl, key) in _TABLES.items()}
        self.tables = VersionedTables(spark, path, layouts | {"log": Layout(of(_LOG), (), DAY)})

    @classmethod
    def create(cls, spark: SparkSession, path: str, state: ReaderState | None = None, profiles: DataFrame | None = None, buckets: int = BUCKETS) -> ReaderStore:
        """A store that begins with a state (and profiles: ``profile_id``, ``interests``); a store that exists is opened as it is."""
        store = cls(spark, path)
        if store.tables.manifest().version:
            return store
        first = dict(state._asdict()) if state else {}
        if profiles is not None:
            first["profiles"] = profiles.select("profile_id", "interests", F.lit(None).cast("timestamp").alias("last_seen_at"))
        store.tables.commit({name: rows.withColumn(BUCKET, store.bucket(buckets)) for name, rows in first.items()}, {"buckets": buckets, "batch": -1})
        return store

    @staticmethod
    def bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("profile_id"), F.lit(buckets)).cast("int")

    def read(self, name: str) -> DataFrame:
        """The current rows of a table."""
        return self.tables.read(name).select(*self.tables.layouts[name].schema.fieldNames())

    def state(self) -> ReaderState:
        return ReaderState(*[self.read(name) for name in ReaderState._fields])

    def has_done(self, number: int) -> bool:
        """Whether a numbered batch is in the store already, so that a replay of it changes nothing."""
        return number <= self.tables.manifest().facts["batch"]

    def _of(self, rows: DataFrame, at: Manifest) -> dict[str, DataFrame]:
        """The stored rows of the profiles of ``rows``, from the buckets of these profiles alone."""
        asked = materialize(rows.select("profile_id").where("profile_id IS NOT NULL").distinct().withColumn(BUCKET, self.bucket(at.facts["buckets"])), "asked")
        buckets = [r[BUCKET] for r in asked.select(BUCKET).distinct().collect()]
        asked = broadcast_if_small(asked)
        return {name: self.tables.read(name, buckets, at).drop(VERSION).join(asked, ["profile_id", BUCKET], "left_semi") for name in _TABLES}

    def _commit(self, changes: dict[str, DataFrame], at: Manifest, number: int | None) -> None:
        placed = {}
        for name, rows in changes.items():
            part = F.to_date("created_at").alias(DAY) if name == "log" else self.bucket(at.facts["buckets"]).alias(BUCKET)
            placed[name] = materialize(rows.select("*", part), name)
        self.tables.commit(placed, {} if number is None else {"batch": number}, base=at)

    def apply(self, requests: DataFrame, items: DataFrame, number: int | None = None) -> None:
        """Fold requests (profile_id, batch_id, received_at, route, payload) into the store.

        Routes are ``signals``, ``mute`` (explicit mutes and unmutes) and ``profile`` (a new profile's interests);
        others, and requests without a profile, are left out. ``number`` marks the batch as done.
        """
        at = self.tables.manifest()
        requests = materialize(requests, "requests")
        stored = self._of(requests, at)
        of = lambda route: requests.where(F.col("route") == route)
        new = reader_changes(of("signals"), items, ReaderState(*[stored[n] for n in ReaderState._fields]), parse_mutes(of("mute")))
        asked = parse_interests(of("profile")).join(new.seen, "profile_id", "full")
        before = stored["profiles"].select("profile_id", F.col("interests").alias("had"), F.col("last_seen_at").alias("was_seen"))
        profiles = asked.join(before, "profile_id", "left").select(
            "profile_id", F.coalesce("interests", "had").alias("interests"), F.greatest("last_seen_at", "was_seen").alias("last_seen_at")
        )
        self._commit({"log": new.log, "affinities": new.affinities, "saves": new.saves, "mutes": new.mutes, "profiles": profiles}, at, number)

    def fold(self, signals: DataFrame, items: DataFrame, number: int | None = None) -> None:
        """Fold parsed signals into the affinities alone."""
        at = self.tables.manifest()
        signals = materialize(signals, "signals")
        stored = self._of(signals, at)
        self._commit({"affinities": affinity.fold_affinities(signals, items, stored=stored["affinities"])}, at, number)

    def merge(self, most: int = MOST_VERSIONS) -> None:
        """Fold every part of more than ``most`` folders into one."""
        for name in self.tables.layouts:
            parts = self.tables.long_parts(name, most)
            if parts:
                self.tables.merge(name, parts)

    def vacuum(self, keep: int = 2) -> int:
        return self.tables.vacuum(keep)
