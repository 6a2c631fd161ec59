"""Decaying reader affinities folded from the signal log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

KEY = ["profile_id", "dimension", "key"]
HEAVY_PROFILE = 20_000
CHUNK_BITS = 12
DAY_MICROS = 86_400_000_000


def signal_delta(kind: Column, value: Column) -> Column:
    delta = F.when(kind == "read_time", F.least(value / K.READ_TIME_SECONDS_PER_POINT, F.lit(K.READ_TIME_MAX_POINTS)))
    for name, points in K.SIGNAL_DELTAS.items():
        delta = delta.when(kind == name, F.lit(points))
    return delta


def unopened_impressions(signals: DataFrame) -> DataFrame:
    """Drop impressions of items the same profile has opened (off by default in the jobs)."""
    opened = signals.filter("type = 'open'").select("profile_id", "item_id").distinct()
    kept = signals.filter("type = 'impression'").join(opened, ["profile_id", "item_id"], "left_anti")
    return kept.select(*signals.columns).unionByName(signals.filter("type <> 'impression'"))


def affinity_deltas(signals: DataFrame, items: DataFrame, by_profile: bool = False) -> DataFrame:
    """One row per affinity key a signal touches: its item's topics, source and author.

    ``by_profile`` shuffles the signals by profile before they are taken apart, so that grouping by key needs no shuffle of
    its keys; for profiles of bounded histories only.
    """
    c = F.col
    facts = items.select(c("id").alias("item_id"), "source_id", "author", "topics")
    delta, share = c("delta"), c("delta") * K.SOURCE_AUTHOR_SHARE
    touched = F.concat(
        F.transform("topics", lambda t: F.struct(F.lit("topic").alias("dimension"), t.alias("key"), delta.alias("delta"))),
        F.array(F.struct(
            F.lit("source").alias("dimension"), c("source_id").cast("string").alias("key"),
            F.when(c("type") == "hide_source", delta).otherwise(share).alias("delta"),
        )),
        F.when(
            c("author") != "",
            F.array(F.struct(F.lit("author").alias("dimension"), F.lower("author").alias("key"), share.alias("delta"))),
        ).otherwise(F.array().cast("array<struct<dimension:string,key:string,delta:double>>")),
    )
    rows = signals.select("id", "profile_id", "item_id", "type", "created_at", signal_delta(c("type"), c("value")).alias("delta")).join(facts, "item_id")
    if by_profile:
        rows = rows.repartition("profile_id")
    return (
        rows.select("id", "profile_id", "created_at", F.explode(touched).alias("k"))
        .select("profile_id", "k.dimension", "k.key", F.unix_micros("created_at").alias("t"), "id", "k.delta")
    )


def _clamp(w: Column) -> Column:
    return F.least(F.lit(K.AFFINITY_MAX), F.greatest(F.lit(K.AFFINITY_MIN), w))


def decay(elapsed_micros: Column) -> Column:
    half_life = K.AFFINITY_HALF_LIFE_DAYS * DAY_MICROS
    return F.when(elapsed_micros > 0, F.pow(F.lit(2.0), -elapsed_micros / half_life)).otherwise(F.lit(1.0))


def _start(stored: DataFrame | None, folded: DataFrame) -> DataFrame:
    """Attach the stored weight a fold continues from."""
    if stored is None:
        return folded.withColumns({"w0": F.lit(0.0), "t0": F.lit(None).cast("bigint")})
    old = stored.select(*KEY, F.col("weight").alias("w0"), F.unix_micros("updated_at").alias("t0"))
    return folded.join(old, KEY, "left").withColumn("w0", F.coalesce("w0", F.lit(0.0)))


def _weight_rows(folded: DataFrame, final: Column) -> DataFrame:
    return folded.withColumn("s", final).select(
        *KEY, F.col("s.w").alias("weight"), F.timestamp_micros(F.col("s.t")).alias("updated_at")
    )


def _fold_short(deltas: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Keys whose history is known to be short: collect, sort and fold in one step."""
    history = deltas.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("t", "id", "delta"))).alias("h"))
    history = _start(stored, history)
    first = F.struct(F.col("w0").alias("w"), F.coalesce("t0", F.col("h")[0]["t"]).alias("t"))
    final = F.aggregate(
        "h", first,
        lambda s, x: F.struct(
            _clamp(s["w"] * decay(x["t"] - s["t"]) + x["delta"]).alias("w"), x["t"].alias("t")
        ),
    )
    return _weight_rows(history, final)


MAP_TYPE = "struct<a:double,b:double,lo:double,hi:double,t0:bigint,t:bigint>"


def _compose(m: Column, n: Column) -> Column:
    """Run map ``n`` after map ``m``; both have the form x -> min(hi, max(lo, a*x + b)), which composing keeps."""
    d = decay(n["t0"] - m["t"])

    def after(x: Column) -> Column:
        return F.least(n["hi"], F.greatest(n["lo"], n["a"] * d * x + n["b"]))

    return F.struct(
        (n["a"] * d * m["a"]).alias("a"), (n["a"] * d * m["b"] + n["b"]).alias("b"),
        after(m["lo"]).alias("lo"), after(m["hi"]).alias("hi"), m["t0"].alias("t0"), n["t"].alias("t"),
    ).cast(MAP_TYPE)


def _compose_groups(maps: DataFrame, shift: int) -> DataFrame:
    """Compose runs of maps whose positions share their upper bits; no group exceeds 2**CHUNK_BITS rows."""
    grouped = maps.groupBy(*KEY, F.shiftright("pos", shift).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("run")
    )
    composed = F.aggregate(
        F.slice("run", F.lit(2), F.greatest(F.size("run") - 1, F.lit(0))), F.col("run")[0]["m"],
        lambda acc, x: _compose(acc, x["m"]),
    )
    return grouped.select(*KEY, F.col("run")[0]["pos"].alias("pos"), composed.alias("m"))


def _fold_long(deltas: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Keys with long histories: cut each history into ordered chunks over many tasks and compose their maps.

    The range partitioning includes time, so one key spans tasks. Each level shortens a history 4096-fold.
    """
    step = F.struct(
        F.lit(1.0).alias("a"), F.col("delta").alias("b"), F.lit(K.AFFINITY_MIN).alias("lo"),
        F.lit(K.AFFINITY_MAX).alias("hi"), F.col("t").alias("t0"), F.col("t").alias("t"),
    ).cast(MAP_TYPE)
    maps = (
        deltas.repartitionByRange(*[F.col(k) for k in KEY], F.col("t"), F.col("id"), F.col("delta"))
        .sortWithinPartitions(*KEY, "t", "id", "delta")
        .select(*KEY, F.monotonically_increasing_id().alias("pos"), step.alias("m"))
    )
    maps = _compose_groups(maps, CHUNK_BITS)
    maps = _compose_groups(maps, 2 * CHUNK_BITS)
    # What is left is a few maps per task the key touched.
    rest = maps.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("run"))
    rest = _start(stored, rest)
    first = F.struct(F.col("w0").alias("w"), F.coalesce("t0", F.col("run")[0]["m"]["t0"]).alias("t"))

    def apply(s: Column, x: Column) -> Column:
        m = x["m"]
        w = F.least(m["hi"], F.greatest(m["lo"], m["a"] * decay(m["t0"] - s["t"]) * s["w"] + m["b"]))
        return F.struct(w.alias("w"), m["t"].alias("t"))

    return _weight_rows(rest, F.aggregate("run", first, apply))


def fold_affinities(
    signals: DataFrame, items: DataFrame, stored: DataFrame | None = None, heavy_profile: int = HEAVY_PROFILE
) -> DataFrame:
    """(profile_id, dimension, key, weight, updated_at) of every key the signals touch, in (created_at, id) order.

    A key belongs to one profile, so counting signals per profile bounds every history before anything is
    collected. Profiles over the bound take the chunked path.
    """
    busy = signals.groupBy("profile_id").agg(F.count("*").alias("n")).filter(F.col("n") > heavy_profile).select("profile_id")
    deltas = affinity_deltas(signals, items, by_profile=True)
    if busy.limit(1).count() == 0:
        return _fold_short(deltas, stored)
    light = affinity_deltas(signals.join(busy, "profile_id", "left_anti"), items, by_profile=True)
    heavy = affinity_deltas(signals.join(busy, "profile_id", "left_semi"), items)
    return _fold_short(light, stored).unionByName(_fold_long(heavy, stored))


def upsert_affinities(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """The whole table with the touched keys replaced."""
    kept = stored.join(touched.select(*KEY), KEY, "left_anti")
    return kept.select(*touched.columns).unionByName(touched)


def decayed(affinities: DataFrame, now: Column) -> DataFrame:
    """Weights as of ``now`` (reports only; scoring uses stored weights)."""
    elapsed = F.unix_micros(now) - F.unix_micros("updated_at")
    return affinities.withColumn("weight", F.col("weight") * decay(elapsed))
