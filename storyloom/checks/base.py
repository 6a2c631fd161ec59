"""Registry that keeps each query next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from .. import demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; ``needs`` names the derived tables its SQL reads."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, needs)
        return fn

    return register


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


NOW = f"TIMESTAMP '{demo.NOW_TEXT}'"


def classify_sql(title: str, excerpt: str, hints: str, taxonomy) -> str:
    entries = []
    for order, (topic, strong, weak) in enumerate(taxonomy):
        def hits(text, terms):
            tests = [
                "(regexp_matches({}, {}, 'i'))::int".format(text, quote("(?:^|[^a-z0-9])" + t + "(?:$|[^a-z0-9])"))
                for t in terms
            ]
            return "(" + (" + ".join(tests) or "0") + ")"

        strong_any = f"({hits(title, strong)} + {hits(excerpt, strong)} > 0)"
        score = (
            f"(3 * (2 * {hits(title, strong)} + {hits(title, weak)})"
            f" + 2 * {hits(excerpt, strong)} + {hits(excerpt, weak)})"
        )
        entries.append(
            f"CASE WHEN {strong_any} OR {score} >= 2 THEN "
            f"lpad((1000 - {score} - CASE WHEN {strong_any} THEN 3 ELSE 0 END)::varchar, 4, '0')"
            f" || '{order}' || '{topic}' END"
        )
    ranked = "list_sort(list_filter([" + ", ".join(entries) + "], lambda e: e IS NOT NULL))"
    best = f"list_transform({ranked}[1:3], lambda e: substr(e, 6))"
    return f"CASE WHEN len({ranked}) > 0 THEN {best} ELSE {hints} END"


CATEGORY_ROWS = ", ".join(
    f"({i}, {quote(slug)}, {quote(label)}, {sql_list(topics)}::varchar[])" for i, (slug, label, topics) in enumerate(K.CATEGORIES)
)

_CUT = "substr(t, 1, 320)"
_LAST_SPACE = f"(length({_CUT}) - strpos(reverse({_CUT}), ' '))"
# The documents' texts hold no markup, so an excerpt is the text with single blanks, cut at a word.
DOC_EXCERPT = (
    f"CASE WHEN t = '' THEN NULL WHEN length(t) <= 320 THEN t WHEN contains({_CUT}, ' ') AND {_LAST_SPACE} > 192 "
    f"THEN substr({_CUT}, 1, {_LAST_SPACE}) || '…' ELSE {_CUT} || '…' END"
)

# name -> (tables it needs first, SQL)
TABLES: dict[str, tuple[str, str]] = {
    "categories": ("", f"SELECT * FROM (VALUES {CATEGORY_ROWS}) AS v(ord, slug, label, topics)"),
    "category_topics": (
        "categories", "SELECT ord, slug, unnest(topics) AS topic FROM categories WHERE len(topics) > 0",
    ),
    "source_ids": ("", "SELECT DISTINCT substr(source, 4)::bigint AS id FROM documents"),
    "source_class": ("source_ids", "SELECT id, ['social', 'news', 'longform'][id % 3 + 1] AS cls FROM source_ids"),
    "source_tier": (
        "source_class",
        "SELECT id, cls, CASE WHEN id % 4 = 1 THEN 'major' WHEN cls = 'social' THEN 'social' ELSE 'independent' END AS tier FROM source_class",
    ),
    "sources": (
        "source_tier",
        f"""SELECT id, ['rss', 'hn', 'bluesky', 'x', 'substack'][id % 5 + 1] AS kind, cls AS source_class,
        'Source ' || id AS name, 'https://src' || id || '.example.com/feed' AS feed_url,
        'https://www.src' || id || '.example.com/' AS homepage_url,
        [{sql_list(K.KNOWN_TOPICS)}[id % 10 + 1]] AS topic_hints, 0.5::double + (id % 10) * 0.05::double AS quality_prior,
        tier AS credibility_tier, 'fam' || (id % 12) AS source_family,
        CASE WHEN cls = 'longform' THEN 30 WHEN tier = 'major' OR cls = 'social' THEN 5 ELSE 10 END AS poll_interval_minutes,
        (cls = 'longform' OR (cls = 'social' AND tier = 'social')) AS named_author_required,
        id % 10 <> 7 AS active,
        CASE WHEN id % 9 <> 0 THEN {NOW} - to_minutes((id * 7 % 50)) END AS last_successful_fetch_at,
        CASE WHEN id % 7 <> 0 THEN {NOW} + to_minutes(((id % 5 - 2) * 10)) END AS next_fetch_at
        FROM source_tier""",
    ),
    "docs": (
        "",
        """SELECT doc_id AS id, substr(source, 4)::bigint AS source_id, text, n_chars,
        regexp_extract(text, '^[^.\n]*') AS title, {DOC_EXCERPT} AS excerpt
        FROM (SELECT *, trim(regexp_replace(replace(text, chr(10), ' '), '  +', ' ', 'g')) AS t FROM documents)""".replace("{DOC_EXCERPT}", DOC_EXCERPT),
    ),
    "items": (
        "docs",
        f"""SELECT id, source_id, 'doc-' || id AS guid, CASE WHEN id % 5 <> 0 THEN 'Author ' || (id % 17) END AS author,
        title, 'https://src' || source_id || '.example.com/story/' || id AS url,
        CASE WHEN id % 40 < 2 THEN 'https://wire.example.com/' || (id - id % 40)
             ELSE 'https://src' || source_id || '.example.com/story/' || id END AS canonical_url,
        excerpt, text AS content_html,
        {NOW} - to_minutes(id * 37 % 10080) AS published_at,
        {NOW} - to_minutes(id * 37 % 10080) + to_minutes(2) AS fetched_at,
        {NOW} - to_minutes(id * 37 % 10080) + to_minutes(id % 90) AS updated_at,
        sha256(text) AS content_fingerprint,
        (n_chars // 6)::int AS word_count,
        CASE id % 50 WHEN 0 THEN 'retracted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'updated' ELSE 'active' END AS status,
        CASE id % 3 WHEN 0 THEN 'reported' WHEN 1 THEN 'corroborated' ELSE 'unconfirmed' END AS verification_status,
        {classify_sql("title", "excerpt", f"[{sql_list(K.KNOWN_TOPICS)}[source_id % 10 + 1]]", demo.TEST_TAXONOMY)} AS topics,
        CASE WHEN id % 4 = 0 THEN id * 31 % 97 + 1 END AS cluster_id
        FROM docs""",
    ),
    "typed_events": (
        "",
        """SELECT *, CASE WHEN event_id % 101 = 7 THEN 'hide_source' WHEN event_id % 13 = 5 THEN 'read_time'
        WHEN event_id % 11 = 3 THEN 'unsave' WHEN event_type = 'view' THEN 'impression' WHEN event_type = 'click' THEN 'open'
        WHEN event_type = 'purchase' THEN 'save' WHEN event_type = 'signup' THEN 'more_like' ELSE 'less_like' END AS type
        FROM events""",
    ),
    "signals": (
        "typed_events",
        """SELECT event_id AS id, 'p' || user_id AS profile_id,
        CASE WHEN type IN ('save', 'unsave') THEN (event_id // 16) % (SELECT count(*) FROM documents)
             ELSE event_id % (SELECT count(*) FROM documents) END AS item_id,
        type, value::double AS value, ts AS created_at FROM typed_events""",
    ),
    "profiles": (
        "",
        f"""SELECT DISTINCT 'p' || user_id AS profile_id,
        CASE user_id % 3 WHEN 0 THEN ['nba', 'tech'] WHEN 1 THEN ['taiwan', 'us-politics', 'world'] ELSE []::varchar[] END AS interests,
        CASE WHEN user_id % 4 <> 0 THEN {NOW} - INTERVAL 12 HOUR END AS last_feed_opened_at FROM events""",
    ),
    "mutes": (
        "",
        f"""SELECT DISTINCT 'p' || user_id AS profile_id, (user_id % 20)::bigint AS source_id, {NOW} AS created_at
        FROM events WHERE user_id % 5 = 0""",
    ),
    "web": (
        "",
        """SELECT page_id, ' ' || CASE WHEN page_id % 6 = 0 AND NOT contains(url, '#')
          THEN (CASE WHEN page_id % 4 = 1 THEN replace(url, 'example', 'Example') ELSE url END)
             || (CASE WHEN contains(url, '?') THEN '&' ELSE '?' END) || 'z=' || page_id || '&utm_medium=m&b=1&gclid=9'
          ELSE (CASE WHEN page_id % 4 = 1 THEN replace(url, 'example', 'Example') ELSE url END) END AS url,
        html || '<p>Q&amp;A &#8217; &#x2014; &hellip; &unknown; &#38;lt;</p>'
          || CASE page_id % 3 WHEN 0 THEN '<IMG alt="x" src="https://img.example.com/' || page_id || '.jpg">'
             WHEN 1 THEN '<img src="/local.png">' ELSE '' END AS html FROM pages""",
    ),
}


def with_tables(sql: str, needs: str) -> str:
    ordered: list[str] = []

    def add(name: str):
        if name in ordered:
            return
        for dep in TABLES[name][0].split():
            add(dep)
        ordered.append(name)

    for name in needs.split():
        add(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({TABLES[name][1]})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"
