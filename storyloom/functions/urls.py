"""URL canonicalisation as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import bind, trim_all

URL = "(?s)^([hH][tT][tT][pP][sS]?)://((?:[^/?#]*@)?)([^/?#@\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$"
# Kept as they are in a path; everything else becomes the percent form of its UTF-8 bytes.
PATH_TEXT = "[!$-;=@-_a-z|~]"
DOTS, TWO_DOTS = ["." , "%2e"], ["..", ".%2e", "%2e.", "%2e%2e"]


def _param(pair: Column) -> Column:
    has_value = pair.contains("=")
    key = F.when(has_value, F.substring_index(pair, "=", 1)).otherwise(pair)
    value = F.when(has_value, pair.substr(F.length(key) + 2, F.length(pair))).otherwise(F.lit(""))

    def plain(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    return F.struct(plain(key).alias("k"), plain(value).alias("v"))


def canonicalize_url(raw: Column) -> Column:
    """One address per article: no fragment, tracking parameters or trailing slash, sorted parameters.

    Line ends and tabs inside an address are dropped, paths are folded and percent-encoded, and only scheme and
    host change case. Anything that is not an http(s) address is returned trimmed.
    """
    return bind(trim_all(raw), lambda url: F.when(url.rlike(URL), bind(F.translate(url, "\t\n\r", ""), _clean)).otherwise(url))


def _percent(path: Column) -> Column:
    def code(ch: Column) -> Column:
        return F.when(ch.rlike(PATH_TEXT), ch).otherwise(F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1"))

    plain = path.rlike(f"^(?:{PATH_TEXT}|%)*$")
    each = F.transform(F.split(path, ""), lambda ch: F.when(ch == "%", ch).otherwise(code(ch)))
    return F.when(plain, path).otherwise(F.array_join(each, ""))


def _fold(path: Column) -> Column:
    """Without dot segments; one at the end leaves a slash."""
    low = F.lower
    steps = lambda parts: F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda kept, s: F.when(low(s).isin(DOTS), kept)
        .when(low(s).isin(TWO_DOTS), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
        .otherwise(F.concat(kept, F.array(s))),
    )

    def folded(parts: Column) -> Column:
        last = low(F.element_at(parts, -1)).isin(DOTS + TWO_DOTS)
        return F.concat(F.array_join(steps(parts), "/"), F.when(last, "/").otherwise(""))

    return F.when(path.rlike("(?i)/(?:\\.|%2e){1,2}(?:/|$)"), bind(F.split(path, "/"), folded)).otherwise(path)


def _clean(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, URL, 1))
    user = F.regexp_extract(url, URL, 2)
    host = F.lower(F.regexp_extract(url, URL, 3))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(_fold(_percent(F.regexp_extract(url, URL, 4))), "^$", "/")
    query = F.regexp_replace(F.regexp_extract(url, URL, 5), "^\\?", "")
    params = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), _param)
    kept = F.filter(params, lambda p: ~p["k"].startswith("utm_") & ~p["k"].isin(*K.TRACKING_PARAMS))
    # The position keeps equal keys in their original order.
    ordered = F.sort_array(F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    search = F.array_join(
        F.transform(ordered, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"
    )
    address = F.struct(F.concat(scheme, F.lit("://"), user, host, path).alias("base"), search.alias("search"))
    return bind(
        address,
        lambda a: F.when(a["search"] == "", F.regexp_replace(a["base"], "/$", "")).otherwise(
            F.concat(a["base"], F.lit("?"), a["search"])
        ),
    )
