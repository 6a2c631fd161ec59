"""The item table of continuous ingest: dated bodies, a key index, title sets, and places (cluster and verification).

* ``items``: whole rows by publication date. An upsert adds the touched rows to their dates, and takes a row off
  its old date when it moves.
* ``keys``: for every key its id, date and fingerprint, by hash bucket. A batch looks its keys up in its own buckets
  and then opens the bodies of the dates that hold one, so its cost follows the batch and not the table.
* ``titles``: for every item its title tokens, rarest first under an order that is frozen when the store is made, by date. New titles probe it (see ``increments``).
* ``places``: what clustering decides about an item, newer than its body, by date. It is laid over the bodies when
  they are read, and folded into them when a date is merged.
* ``versions`` and ``clusters`` only grow.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import broadcast_if_small, materialize
from .upsert import DATE, ITEM_COLUMNS, KEY, Upsert, dense_ids, plan_upsert
from .versioned import GONE, VERSION, Layout, Manifest, VersionedTables, part_text

#: Hash buckets of the key index; about one for every million items.
BUCKETS = 64
#: Versions of a part that are read side by side before a merge.
MOST_VERSIONS = 8
PLACE = ["cluster_id", "verification_status"]

_KEYS = "source_id bigint, guid string, id bigint, day date, content_fingerprint string"
_TITLES = "id bigint, source_id bigint, title string, canonical_url string, published_at timestamp, tokens array<string>, ranked array<string>, changed bigint"
_PLACES = "id bigint, cluster_id bigint, verification_status string"
_VERSIONS = "item_id bigint, title string, excerpt string, content_fingerprint string, status string, captured_at timestamp"
_CLUSTERS = "id bigint, key string, title string, created_at timestamp"


def ranked_tokens(rows: DataFrame, frequency: DataFrame, key: str = "id") -> DataFrame:
    """The rows with ``ranked``: the tokens, rarest first (see ``similarity.prefix_of``).

    Any fixed order of tokens serves; a token that the frozen counts do not know comes first, by name.
    """
    words = rows.select(key, F.explode("tokens").alias("token")).join(frequency, "token", "left")
    # One title's tokens, so the collected list is short.
    sorted_ = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("r"))
    ranked = F.transform("r", lambda t: t["token"])
    return rows.join(sorted_.select(key, ranked.alias("ranked")), key, "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))


class Looked(NamedTuple):
    rows: DataFrame  # stored rows of the asked keys
    known: DataFrame  # source_id, guid, id, day of the asked keys that are stored
    at: Manifest  # the state that was asked


class ItemStore:
    """One writer at a time; any number of readers. See ``create`` and ``open``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        of = lambda ddl: T._parse_datatype_string(ddl)
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = VersionedTables(
            spark, path,
            {
                "items": Layout(T.StructType([T.StructField(c, schema[c].dataType) for c in ITEM_COLUMNS]), tuple(KEY), DATE),
                "keys": Layout(of(_KEYS), tuple(KEY), "bucket", T.IntegerType()),
                "titles": Layout(of(_TITLES), ("id",), DATE),
                "places": Layout(of(_PLACES), ("id",), DATE),
                "versions": Layout(of(_VERSIONS), (), "captured_date"),
                "clusters": Layout(of(_CLUSTERS), (), "created_date"),
            },
        )

    @classmethod
    def create(cls, path: str, items: DataFrame, buckets: int = BUCKETS) -> ItemStore:
        """A store that begins with the rows of ``items`` (ids and clusters as they are)."""
        store = cls(items.sparkSession, path, items.schema)
        items = items.select(*ITEM_COLUMNS).withColumn(DATE, F.to_date("published_at"))
        titles = materialize(store._title_rows(items, 1), "titles")
        frequency = titles.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        frequency.write.mode("overwrite").parquet(f"{store.path}/frequency")
        tops = items.agg(F.max("id").alias("id"), F.max("cluster_id").alias("cluster")).first()
        facts = {"buckets": buckets, "top_id": tops.id or 0, "top_cluster": tops.cluster or 0, "batch": -1, "clustered": 0}
        changes = {"items": items, "keys": store._key_rows(items, buckets), "titles": ranked_tokens(titles, store.frequency())}
        store.tables.commit(changes, facts)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: T.StructType) -> ItemStore:
        return cls(spark, path, schema)

    def frequency(self) -> DataFrame:
        return self.spark.read.schema("token string, df bigint").parquet(f"{self.path}/frequency")

    @property
    def facts(self) -> dict:
        return self.tables.manifest().facts

    @staticmethod
    def bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")

    def _key_rows(self, dated: DataFrame, buckets: int) -> DataFrame:
        return dated.select(*KEY, "id", F.col(DATE).alias("day"), "content_fingerprint", self.bucket(buckets).alias("bucket"))

    def _title_rows(self, dated: DataFrame, version: int) -> DataFrame:
        tokens = F.sort_array(X.title_tokens(F.col("title")))
        return dated.select("id", "source_id", "title", "canonical_url", "published_at", tokens.alias("tokens"), F.lit(version).cast("bigint").alias("changed"), DATE)

    def _days_since(self, start: Column | None, at: Manifest, table: str) -> list[str] | None:
        """The dates of a table from that of ``start`` on; the manifest knows them all."""
        if start is None:
            return None
        first = part_text(self.spark.range(1).select(start.cast("date").alias("d")).first().d)
        return [p for p in at.live[table] if p[:1] == "_" or p >= first]

    def items(self, days=None, since: Column | None = None, at: Manifest | None = None) -> DataFrame:
        """Current rows (item columns and date), of some dates or from a time on; only folders of such dates are opened."""
        at = at or self.tables.manifest()
        if since is not None:
            days = self._days_since(since, at, "items")
        rows = self.tables.read("items", days, at)
        wanted = None if days is None else {part_text(d) for d in days}
        if any(wanted is None or p in wanted for p in at.live["places"]):
            places = self.tables.read("places", days, at).select("id", DATE, F.struct(*PLACE, VERSION).alias("__place"))
            rows = rows.join(broadcast_if_small(places), ["id", DATE], "left")
            newer = F.col(f"__place.{VERSION}") > F.col(VERSION)
            rows = rows.withColumns({c: F.when(newer, F.col(f"__place.{c}")).otherwise(F.col(c)) for c in PLACE})
        rows = rows.select(*ITEM_COLUMNS, DATE)
        return rows if since is None else rows.where(F.col("published_at") >= since)

    def titles(self, since: Column, at: Manifest | None = None) -> DataFrame:
        at = at or self.tables.manifest()
        rows = self.tables.read("titles", self._days_since(since, at, "titles"), at)
        return rows.where(F.col("published_at") >= since)

    def versions(self) -> DataFrame:
        return self.tables.read("versions").drop("captured_date", VERSION)

    def clusters(self) -> DataFrame:
        return self.tables.read("clusters").drop("created_date", VERSION)

    def lookup(self, keys: DataFrame) -> Looked:
        """The stored rows of keys: their buckets of the index first, then the bodies of the dates found there."""
        at = self.tables.manifest()
        keys = materialize(keys.select(*KEY).distinct().withColumn("bucket", self.bucket(at.facts["buckets"])), "keys")
        buckets = [r.bucket for r in keys.select("bucket").distinct().collect()]
        index = self.tables.read("keys", buckets, at)
        known = materialize(index.join(keys, [*KEY, "bucket"], "left_semi").select(*KEY, "id", "day"), "known")
        days = [r.day for r in known.select("day").distinct().collect()]
        return Looked(self.items(days, at=at).join(known.select(*KEY, F.col("day").alias(DATE)), [*KEY, DATE], "left_semi"), known, at)

    def upsert(self, batch: DataFrame, now: Column, number: int | None = None) -> Upsert:
        """Fold a batch of cleaned entries into the store. ``number`` marks the batch as done (see ``has_done``)."""
        batch = materialize(batch, "batch")
        found = self.lookup(batch)
        plan = plan_upsert(found.rows, batch, now, cut=lambda df: materialize(df, "upsert"))
        fresh = dense_ids(plan.rows.where("action = 'insert'"), found.at.facts["top_id"], ["ord", *KEY])
        rows = plan.rows.join(fresh.drop("ord"), KEY, "left").withColumn("id", F.coalesce("id", "new_id")).drop("new_id")
        rows = materialize(rows, "rows")
        self.put(rows, plan.versions, found, number)
        return Upsert(rows, plan.versions)

    def put(self, rows: DataFrame, versions: DataFrame, found: Looked, number: int | None = None) -> None:
        """Commit touched rows (stored, with ``action``) and what they looked like, after a ``lookup`` of their keys."""
        at = found.at
        dated = rows.withColumn(DATE, F.to_date("published_at"))
        changed = dated.where("action <> 'seen'")
        moved = found.known.select(*KEY, "day").join(changed.select(*KEY, "id", DATE), KEY).where(f"NOT day <=> {DATE}").select(*KEY, "id", F.col("day").alias(DATE))
        moved = materialize(moved.withColumn(GONE, F.lit(True)), "moved")
        here = F.lit(False).alias(GONE)
        titles = ranked_tokens(self._title_rows(changed, at.version + 1), self.frequency())
        changes = {
            "items": dated.select(*ITEM_COLUMNS, DATE, here).unionByName(moved, allowMissingColumns=True),
            "keys": self._key_rows(changed, at.facts["buckets"]),
            "titles": materialize(titles.withColumn(GONE, F.lit(False)).unionByName(moved.select("id", DATE, GONE), allowMissingColumns=True), "new-titles"),
            "versions": versions.withColumn("captured_date", F.to_date("captured_at")),
        }
        top = rows.agg(F.max("id").alias("top")).first().top
        facts = {"top_id": max(top or 0, at.facts["top_id"])} | ({} if number is None else {"batch": number})
        self.tables.commit(changes, facts, base=at)

    def has_done(self, number: int) -> bool:
        """Whether a numbered batch is in the store already, so that a replay of it changes nothing."""
        return number <= self.facts["batch"]

    def place(self, rows: DataFrame, clusters: DataFrame | None = None, facts: dict | None = None) -> None:
        """Commit what clustering decided: ``id``, date, ``cluster_id`` and ``verification_status`` of the rows that change."""
        changes = {"places": rows.select("id", *PLACE, DATE)}
        if clusters is not None:
            changes["clusters"] = clusters.withColumn("created_date", F.to_date("created_at"))
        self.tables.commit(changes, facts)

    def merge(self, most: int = MOST_VERSIONS) -> None:
        """Fold every part of more than ``most`` folders into one; places of merged dates go into their bodies."""
        at = self.tables.manifest()
        days = [p for p, v in at.live["items"].items() if len(v) + len(at.live["places"].get(p, [])) > most]
        if days:
            self.tables.merge("items", days, self.items(days, at=at), drop={"places": days})
        for name in ("keys", "titles", "versions", "clusters"):
            parts = self.tables.long_parts(name, most)
            if parts:
                self.tables.merge(name, parts)

    def vacuum(self, keep: int = 2) -> int:
        return self.tables.vacuum(keep)
