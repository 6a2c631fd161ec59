"""Landed reader requests to the log, affinities, saves, mutes and profiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import affinity, logs
from ..operators.filters import known_items, parse_signal_batches, valid_interests
from ..session import broadcast_if_small, materialize

SAVE_KEY = ["profile_id", "item_id"]
MUTE_KEY = ["profile_id", "source_id"]


class ReaderState(NamedTuple):
    affinities: DataFrame  # profile_id, dimension, key, weight, updated_at
    saves: DataFrame  # profile_id, item_id, created_at
    mutes: DataFrame  # profile_id, source_id, created_at


class SignalRun(NamedTuple):
    log: DataFrame  # rows to append: id, profile_id, item_id, type, value, created_at
    state: ReaderState
    seen: DataFrame  # profile_id, last_seen_at of the profiles that sent anything valid


class ReaderChanges(NamedTuple):
    """What requests change: the new row of each touched key, with ``gone`` for members that left."""

    log: DataFrame
    affinities: DataFrame
    saves: DataFrame
    mutes: DataFrame
    seen: DataFrame


def request_order(place: Column) -> Column:
    """The id of an entry: its request, then its place in it, so that a request may hold any number of entries."""
    return F.struct(F.col("batch_id").cast("bigint").alias("batch"), place.cast("int").alias("place"))


def parse_mutes(requests: DataFrame) -> DataFrame:
    """(profile_id, batch_id, received_at, payload) to mute toggles; without an integer ``sourceId`` a request is void.

    ``muted`` counts as JSON clients mean it: null, false, zero and the empty text are no.
    """
    v = F.try_parse_json("payload")

    def of(name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    number = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    source, shape = of("sourceId", "double"), F.coalesce(F.schema_of_variant(of("muted", "variant")), F.lit("VOID"))
    muted = (
        F.when(shape == "VOID", False).when(shape == "BOOLEAN", of("muted", "boolean")).when(shape == "STRING", of("muted", "string") != "")
        .when(shape.rlike(number), of("muted", "double") != 0).otherwise(True)
    )
    valid = F.schema_of_variant(of("sourceId", "variant")).rlike(number) & (source == F.floor(source))
    return requests.filter(valid & F.col("profile_id").isNotNull()).select(
        request_order(F.lit(-1)).alias("id"), "profile_id", source.cast("bigint").alias("source_id"), muted.alias("muted"), F.col("received_at").alias("created_at")
    )


def parse_interests(requests: DataFrame) -> DataFrame:
    """The interests of each profile that was set up, from its latest request; what is no list of known topics is empty."""
    asked = valid_interests(F.try_variant_get(F.try_parse_json("payload"), "$.interests", "array<string>"))
    chosen = F.coalesce(asked, F.array().cast("array<string>"))
    rows = requests.filter("profile_id IS NOT NULL").select("profile_id", F.struct("received_at", "batch_id").alias("at"), chosen.alias("interests"))
    return rows.groupBy("profile_id").agg(F.max_by("interests", "at").alias("interests"))


def reader_changes(batches: DataFrame, items: DataFrame, stored: ReaderState, toggles: DataFrame | None = None, limit: int | None = None) -> ReaderChanges:
    """What batches (profile_id, batch_id, received_at, payload) and mute toggles change in the stored state.

    Batch ids are unique and grow with time. Signals on unknown items count as a visit only. Of the stored rows only
    those of touched keys take part; the item table is read once, in the columns that matter.
    """
    c = F.col
    parsed = parse_signal_batches(batches.filter("profile_id IS NOT NULL"), limit).withColumn("id", request_order(c("pos")))
    parsed = materialize(parsed.select("id", "profile_id", "item_id", "type", "value", c("received_at").alias("created_at")), "signals")
    asked = broadcast_if_small(parsed.select(c("item_id").alias("id")).distinct())
    facts = materialize(items.select("id", "source_id", "author", "topics").join(asked, "id", "left_semi"), "facts")
    log = materialize(known_items(parsed, facts), "known-signals")
    saves = log.filter("type IN ('save', 'unsave')").select("id", *SAVE_KEY, (c("type") == "save").alias("adds"), "created_at")
    hidden = log.filter("type = 'hide_source'").join(facts.select(c("id").alias("item_id"), "source_id"), "item_id")
    mutes = hidden.select("id", *MUTE_KEY, F.lit(True).alias("adds"), "created_at")
    if toggles is not None:
        mutes = mutes.unionByName(toggles.select("id", *MUTE_KEY, c("muted").alias("adds"), "created_at"))
    return ReaderChanges(
        log, affinity.fold_affinities(log, facts, stored=stored.affinities), _members(saves, stored.saves, SAVE_KEY), _members(mutes, stored.mutes, MUTE_KEY),
        parsed.groupBy("profile_id").agg(F.max("created_at").alias("last_seen_at")),
    )


def _members(moves: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The touched members of a set as they stand after the moves. One that is in the set already keeps its time."""
    touched = moves.select(*keys).distinct()
    first = F.struct(F.lit(-1).cast("bigint").alias("batch"), F.lit(-1).alias("place"))
    before = stored.join(touched, keys, "left_semi").select(first.alias("id"), *keys, F.lit(True).alias("adds"), "created_at")
    left = logs.fold_set(before.unionByName(moves), keys, F.col("adds"), ~F.col("adds"))
    return touched.join(left, keys, "left").withColumn("gone", F.col("created_at").isNull())


def _after(stored: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    kept = stored.join(changed.select(*keys), keys, "left_anti").select(*keys, "created_at")
    return kept.unionByName(changed.filter("NOT gone").select(*keys, "created_at"))


def signals_job(batches: DataFrame, items: DataFrame, stored: ReaderState, limit: int | None = None, toggles: DataFrame | None = None) -> SignalRun:
    """``reader_changes`` laid over whole tables; ``ReaderStore`` keeps tables of which a batch rewrites only what it touches."""
    new = reader_changes(batches, items, stored, toggles, limit)
    state = ReaderState(affinity.upsert_affinities(stored.affinities, new.affinities), _after(stored.saves, new.saves, SAVE_KEY), _after(stored.mutes, new.mutes, MUTE_KEY))
    return SignalRun(new.log, state, new.seen)
