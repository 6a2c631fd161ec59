"""Per-story figures and report labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import squeeze


def minutes(n) -> Column:
    return F.make_dt_interval(mins=n if isinstance(n, Column) else F.lit(n))


def hours_between(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(3_600_000_000.0)


def hn_points(excerpt: Column) -> Column:
    return F.regexp_extract(excerpt, K.HN_EXCERPT_PATTERN, 1).try_cast("bigint")


def hn_comments(excerpt: Column) -> Column:
    return F.regexp_extract(excerpt, K.HN_EXCERPT_PATTERN, 2).try_cast("bigint")


def discussion_velocity(also_covered: Column, excerpt: Column, source_class: Column) -> Column:
    chatter = F.least(F.coalesce(hn_comments(excerpt) / 300.0, F.lit(0.0)), F.lit(1.0))
    social = F.when(source_class == "social", F.lit(0.25)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(also_covered / 4.0, chatter, social))


def controversy(excerpt: Column) -> Column:
    points = hn_points(excerpt)
    ratio = (hn_comments(excerpt) / points - 0.8) / 1.2
    return F.when(points >= 30, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).otherwise(F.lit(0.0))


def reading_minutes(word_count: Column) -> Column:
    return F.when(
        word_count > 0, F.greatest(F.lit(1), F.floor(word_count / float(K.WORDS_PER_MINUTE) + 0.5).cast("int"))
    )


def recency(published_at: Column, source_class: Column, now: Column) -> Column:
    half_life = F.lit(None).cast("double")
    for name, hours in K.RECENCY_HALF_LIFE_HOURS.items():
        half_life = F.when(source_class == name, F.lit(hours)).otherwise(half_life)
    age = F.greatest(F.lit(0.0), hours_between(now, published_at))
    return F.pow(F.lit(2.0), -age / half_life)


def verification_label(status: Column, verification: Column, also_covered: Column, source_name: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in K.STATUS_LABELS.items() for x in kv])
    label = F.when(verification == "unconfirmed", F.lit(K.UNCONFIRMED_LABEL)).when(
        verification == "corroborated", _around(K.CORROBORATED_LABEL, (also_covered + 1).cast("string"))
    )
    return F.coalesce(F.try_element_at(named, status), label, F.concat(F.lit(K.REPORTED_LABEL), source_name))


def _around(texts: tuple[str, str], value: Column) -> Column:
    return F.concat(F.lit(texts[0]), value, F.lit(texts[1]))


def story_context(excerpt: Column, also_covered: Column, published_at: Column, reading: Column, world: Column, now: Column) -> Column:
    clean = squeeze(excerpt)
    short = F.when(F.length(clean) <= K.CONTEXT_MAX, clean).otherwise(
        F.concat(F.rtrim(F.substring(clean, 1, K.CONTEXT_CUT)), F.lit("…"))
    )
    return (
        F.when(F.length(excerpt) > 0, short)
        .when(also_covered > 0, _around(K.COVERED_LABEL, (also_covered + 1).cast("string")))
        .when(hours_between(now, published_at) < 1, _around(K.BREAKING_LABEL, world))
        .when(reading.isNotNull(), F.concat(reading.cast("string"), F.lit(K.READING_LABEL)))
        .otherwise(_around(K.RECOMMENDED_LABEL, world))
    )


def topic_label(topic: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in K.TOPIC_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, topic), F.replace(topic, F.lit("-"), F.lit(" ")))


def age_label(published_at: Column, now: Column) -> Column:
    """now, 4m, 2h, then the weekday, then the date."""
    millis = (F.unix_millis(now) - F.unix_millis(published_at)).cast("double")
    mins = F.greatest(F.lit(0), F.floor(millis / 60_000.0 + 0.5))
    hours = F.floor(mins / 60.0 + 0.5)
    days = F.floor(hours / 24.0 + 0.5)
    return (
        F.when(mins < 1, F.lit("now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h")))
        .when(days < 7, F.date_format(published_at, "EEE"))
        .otherwise(F.date_format(published_at, "MMM d"))
    )


def full_date(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, MMMM d, yyyy")


def masthead_date(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, MMMM d")
