"""The shape every source parser returns: one landed entry, before clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

RAW_COLUMNS = {
    "source_id": "bigint",
    "guid": "string",
    "title": "string",
    "url": "string",
    "canonical_url": "string",
    "author": "string",
    "excerpt": "string",
    "content_html": "string",
    "image_url": "string",
    "published_at": "timestamp",
    "updated_at": "timestamp",
    "status_hint": "string",
    "correction_note": "string",
}

ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def raw_items(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the raw shape; columns that are not given are null."""
    return df.select(
        *[
            (columns[name] if name in columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in RAW_COLUMNS.items()
        ]
    )


RFC_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy")
WRITTEN_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")


def parse_date(text: Column) -> Column:
    """RFC 822 (years of two digits too), ISO 8601, or a date with a written month; null when it is none of them."""
    offsets = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])

    def numeric_zone(t: Column) -> Column:
        zone = F.regexp_extract(t, "\\s([A-Z]{1,3})$", 1)
        offset = F.coalesce(F.try_element_at(offsets, zone), zone)
        return F.when(zone == "", t).otherwise(F.concat(F.regexp_replace(t, "\\s[A-Z]{1,3}$", " "), offset))

    def whole_year(t: Column) -> Column:
        """A year of two digits belongs to 1969-2068."""
        late = F.regexp_replace(t, "^(\\d{1,2} [A-Za-z]{3} )(?=(?:69|[7-9]\\d) )", "$119")
        return F.regexp_replace(late, "^(\\d{1,2} [A-Za-z]{3} )(?=\\d{2} )", "$120")

    def parsed(t: Column) -> Column:
        iso = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}"), t.try_cast("timestamp"))
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in RFC_FORMATS], iso, *[F.try_to_timestamp(t, F.lit(f)) for f in WRITTEN_FORMATS])

    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "\\s+", " "), "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? ", "")
    return bind(plain, lambda t: bind(numeric_zone(t), lambda u: bind(whole_year(u), parsed)))
