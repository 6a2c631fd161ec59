"""Title search for any number of needles at once, over posting lists in levels of the search order.

Every title is listed under its runs of one to three characters. The titles are cut into levels along their position,
the first of about ``FIRST`` titles and each further one four times as large. A needle looks up its rarest run, level by
level, and is done once it has enough hits: a frequent needle ends in the first levels, a rare one has short lists, so no
needle goes through all titles. A run of three stands there at each of its places with the characters around it, so what
holds the run but not the needle goes where it is met, and only hits are dealt out and looked up among the titles. Lists
lie in folders by level and hash bucket, and a search opens those of its needles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import trim_all
from ..session import broadcast_if_small, list_paths, materialize

RUN = 3
#: Characters that a list keeps on either side of a run.
AROUND = 7
FIRST = 4096
BUCKETS = 32

_POSTINGS = "gram string, head string, tail string, id bigint, level int, bucket int"
_TITLES = "id bigint, title string, position bigint, level int"
_COUNTS = "gram string, n bigint, bucket int"
_HITS = "needle string, place int, id bigint, title string"


def _runs(characters: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a list of characters."""
    starts = F.sequence(F.lit(0), F.size(characters) - size)
    run = lambda i: F.concat(*[F.get(characters, i + k) for k in range(size)])
    return F.when(F.size(characters) >= size, F.array_distinct(F.transform(starts, run))).otherwise(F.array().cast("array<string>"))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _listed(letters: DataFrame) -> DataFrame:
    """The rows with ``gram``: distinct shorter runs, and each place of a whole one with the text around it."""
    c, text = F.col, lambda start, size: F.array_join(F.slice("letters", start, size), "")
    keys = [k for k in letters.columns if k != "letters"]
    short = F.concat(*[_runs(c("letters"), k) for k in range(1, RUN)])
    short = letters.select(*keys, F.explode(short).alias("gram"), F.lit("").alias("head"), F.lit("").alias("tail"))
    places = letters.where(F.size("letters") >= RUN).select("*", F.explode(F.sequence(F.lit(1), F.size("letters") - (RUN - 1))).alias("at"))
    before = F.least(c("at") - 1, F.lit(AROUND))
    return short.unionByName(places.select(
        *keys, text(c("at"), F.lit(RUN)).alias("gram"), text(c("at") - before, before).alias("head"), text(c("at") + RUN, F.lit(AROUND)).alias("tail")
    ))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def folded(needle: Column) -> Column:
    return F.lower(trim_all(needle))


class TitleIndex:
    """Posting lists of titles under a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    @classmethod
    def build(cls, path: str, titles: DataFrame, buckets: int = BUCKETS, first: int = FIRST) -> TitleIndex:
        """Index ``id``, ``title`` and ``position`` (a whole number; hits come in its order, ties by id). Null titles hold nothing."""
        index = cls(titles.sparkSession, path, buckets)
        rows = titles.where("title IS NOT NULL AND position IS NOT NULL").select("id", "title", F.col("position").cast("bigint").alias("position"))
        n = rows.count()
        cuts = [first * 4**k / n for k in range(max(0, math.ceil(math.log(n / first, 4))))] if n > first else []
        # Where a level ends need not be exact, only the same for all.
        ends = rows.agg(F.percentile_approx("position", cuts, 10_000).alias("ends")).first().ends if cuts else []
        level = sum((F.when(F.col("position") > e, 1).otherwise(0) for e in sorted(set(ends))), F.lit(0)).cast("int")
        rows = rows.withColumn("level", level)
        rows.hint("rebalance", "level").write.partitionBy("level").mode("overwrite").parquet(f"{index.path}/titles")
        letters = index._read("titles", _TITLES).select("id", "level", _characters(F.lower("title")).alias("letters"))
        grams = _listed(letters).withColumn("bucket", _bucket(buckets)).hint("rebalance", "level", "bucket").sortWithinPartitions("level", "bucket", "gram")
        grams.write.partitionBy("level", "bucket").mode("overwrite").parquet(f"{index.path}/postings")
        counts = index._read("postings", _POSTINGS).groupBy("gram", "bucket").agg(F.count("*").alias("n"))
        counts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(f"{index.path}/counts")
        return index

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def levels(self) -> list[int]:
        return sorted(int(p.rsplit("=", 1)[1]) for p in list_paths(self.spark, f"{self.path}/titles/level=*"))

    def _rarest(self, needles: DataFrame) -> DataFrame:
        """``needle`` with its rarest run; needles with a run that no title holds find nothing and go."""
        letters = needles.select("needle", _characters(F.col("needle")).alias("letters"))
        runs = F.coalesce(*[F.when(F.size("letters") >= k, _runs(F.col("letters"), k)) for k in range(RUN, 0, -1)])
        runs = materialize(letters.select("needle", F.explode(runs).alias("gram")).withColumn("bucket", _bucket(self.buckets)), "runs")
        counts = self._read("counts", _COUNTS).where(F.col("bucket").isin(self._buckets_of(runs)))
        known = runs.join(counts, ["gram", "bucket"], "left").groupBy("needle").agg(
            F.min(F.struct("n", "gram", "bucket")).alias("rarest"), F.bool_or(F.col("n").isNull()).alias("unknown")
        )
        return known.where("NOT unknown").select("needle", "rarest.gram", "rarest.bucket")

    @staticmethod
    def _buckets_of(rows: DataFrame) -> list[int]:
        return [r.bucket for r in rows.select("bucket").distinct().collect()]

    def candidates(self, pending: DataFrame, level: int) -> DataFrame:
        """``needle`` and ``id`` of the titles of a level that hold the needle's rarest run with what is next to it there."""
        at, n = F.instr(F.col("needle"), F.col("gram")), F.length("gram")
        asked = pending.select(
            "needle", "gram", "bucket", F.right(F.substring("needle", F.lit(1), at - 1), F.lit(AROUND)).alias("before"),
            F.substring("needle", at + n, F.lit(AROUND)).alias("after"),
        )
        lists = self._read("postings", _POSTINGS).where((F.col("level") == level) & F.col("bucket").isin(self._buckets_of(pending)))
        met = lists.join(broadcast_if_small(asked), ["gram", "bucket"])
        return met.where(F.endswith("head", F.col("before")) & F.startswith("tail", F.col("after"))).select("needle", "id").distinct()

    def search(self, needles: DataFrame, limit: int = K.SEARCH_STORY_LIMIT) -> DataFrame:
        """``needle`` (trimmed, lower-cased), ``place``, ``id`` and ``title`` of the first ``limit`` titles that hold each needle.

        Null and blank needles find nothing; needles that are equal once folded are one.
        """
        asked = needles.select(folded(F.col("needle")).alias("needle")).where("needle <> ''").distinct()
        pending = materialize(self._rarest(asked).withColumn("had", F.lit(0)), "needles")
        out = self.spark.createDataFrame([], _HITS)
        order = Window.partitionBy("needle").orderBy("position", "id")
        for level in self.levels():
            if pending.isEmpty():
                break
            titles = self._read("titles", _TITLES).where(F.col("level") == level)
            hits = self.candidates(pending, level).join(titles, "id").where(F.contains(F.lower("title"), F.col("needle")))
            hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
            hits = hits.join(broadcast_if_small(pending.select("needle", "had")), "needle").withColumn("place", F.col("place") + F.col("had")).where(F.col("place") <= limit)
            hits = materialize(hits.select("needle", "place", "id", "title"), "hits")
            out = out.unionByName(hits)
            last = hits.groupBy("needle").agg(F.max("place").alias("last"))
            pending = pending.join(last, "needle", "left").withColumn("had", F.coalesce("last", "had")).drop("last").where(F.col("had") < limit)
            pending = materialize(pending, "needles")
        return out


def search_readers(index: DataFrame, requests: DataFrame, limit: int = K.SEARCH_STORY_LIMIT) -> DataFrame:
    """Each request (``profile_id``, ``needle``) over the stories its reader is shown (``profile_id``, ``id``, ``title``,
    ``position``, …), which are few by the definition of a feed."""
    asked = requests.select("profile_id", folded(F.col("needle")).alias("needle")).where("needle <> ''").distinct()
    hits = index.join(asked, "profile_id").where(F.contains(F.lower("title"), F.col("needle")))
    place = F.row_number().over(Window.partitionBy("profile_id", "needle").orderBy("position", "id"))
    return hits.withColumn("place", place).where(F.col("place") <= limit)
