"""URL, markup, excerpt, token and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import demo
from ..functions import story as S
from ..functions import text as T
from ..functions.markup import sanitize_html
from ..functions.urls import canonicalize_url
from .base import NOW, check, quote, sql_list

# Browser whitespace for RE2.
RE2_SPACE = "\\t\\n\\v\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def squeeze_sql(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace({text}, '[{RE2_SPACE}]+', ' ', 'g'), '^ +| +$', '', 'g')"
    )


def decode_sql(text: str) -> str:
    """Only the entities that the derived pages contain, replaced in the documented order."""
    out = text
    for source, target in [("&#8217;", "’"), ("&#38;", "&"), ("&#x2014;", "—"), ("&hellip;", "…"), ("&unknown;", " "), ("&copy;", " "), ("&middot;", " "),
                           ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")]:
        out = f"replace({out}, {quote(source)}, {quote(target)})"
    return out


def strip_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)<style.*?</style>', '', 'g')"
    out = f"regexp_replace({out}, '(?is)<script.*?</script>', '', 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    return squeeze_sql(decode_sql(out))


def excerpt_sql(base: str) -> str:
    cut = f"substr({base}, 1, 320)"
    last = f"(length({cut}) - strpos(reverse({cut}), ' '))"
    return (
        f"CASE WHEN {base} = '' THEN NULL WHEN length({base}) <= 320 THEN {base} "
        f"WHEN contains({cut}, ' ') AND {last} > 192 THEN substr({cut}, 1, {last}) || '…' ELSE {cut} || '…' END"
    )


URL_SQL = f"""
WITH parts AS (
  SELECT page_id, trim(url) AS u, split_part(trim(url), '#', 1) AS bare FROM web
), cut AS (
  SELECT page_id, lower(split_part(bare, '://', 1)) AS scheme,
    lower(split_part(split_part(split_part(bare, '?', 1), '://', 2), '/', 1)) AS host,
    substr(split_part(split_part(bare, '?', 1), '://', 2), length(split_part(split_part(split_part(bare, '?', 1), '://', 2), '/', 1)) + 1) AS path,
    list_sort(list_filter(str_split(split_part(bare, '?', 2), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')
      AND NOT list_contains({sql_list(K.TRACKING_PARAMS)}, split_part(p, '=', 1)))) AS params FROM parts
)
SELECT page_id, CASE WHEN len(params) = 0 THEN regexp_replace(scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END, '/$', '')
  ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || '?' || array_to_string(params, '&') END AS canonical_url
FROM cut"""


@check("canonical_urls", URL_SQL, "web")
def canonical_urls(spark, d):
    return demo.pages(spark, d).select("page_id", canonicalize_url(F.col("url")).alias("canonical_url"))


@check("html_text", f"SELECT page_id, {strip_sql('html')} AS body_text FROM web", "web")
def html_text(spark, d):
    return demo.pages(spark, d).select("page_id", T.strip_html(F.col("html")).alias("body_text"))


@check("word_counts", f"WITH t AS (SELECT page_id, {strip_sql('html')} AS s FROM web) "
       "SELECT page_id, CASE WHEN s = '' THEN 0 ELSE len(str_split(s, ' ')) END AS word_count FROM t", "web")
def word_counts(spark, d):
    return demo.pages(spark, d).select("page_id", T.count_words(F.col("html")).alias("word_count"))


@check("excerpts", f"""WITH t AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' NULL ' WHEN 2 THEN '' ELSE html END AS said,
        CASE WHEN page_id % 10 = 0 THEN NULL ELSE html END AS body FROM web),
      b AS (SELECT page_id, {strip_sql("CASE WHEN page_id % 5 > 2 THEN said ELSE coalesce(body, '') END")} AS s FROM t)
      SELECT page_id, {excerpt_sql('s')} AS excerpt FROM b""", "web")
def excerpts(spark, d):
    p = F.col("page_id")
    said = F.when(p % 5 == 1, F.lit(" NULL ")).when(p % 5 == 2, F.lit("")).when(p % 5 > 2, F.col("html"))
    body = F.when(p % 10 != 0, F.col("html"))
    return demo.pages(spark, d).select("page_id", T.make_excerpt(said, body).alias("excerpt"))


@check("content_fingerprints", "SELECT id, sha256(array_to_string(list_filter([title, author, content_html, canonical_url], "
       "lambda p: p IS NOT NULL), '␟')) AS fingerprint FROM items", "items")
def content_fingerprints(spark, d):
    c = F.col
    return demo.items(spark, d).select("id", T.fingerprint(c("title"), c("author"), c("content_html"), c("canonical_url")).alias("fingerprint"))


FNV_SQL = """WITH chars AS (SELECT page_id, trim(url) AS s FROM web),
codes AS (SELECT page_id, list_prepend(2166136261::bigint, list_transform(str_split(s, ''), lambda ch: ord(ch)::bigint)) AS u FROM chars)
SELECT page_id, lpad(lower(to_hex(list_reduce(u, lambda h, x: (xor(h, x) * 16777619::bigint) & 4294967295::bigint))), 8, '0') AS fingerprint FROM codes"""


@check("compact_fingerprints", FNV_SQL, "web")
def compact_fingerprints(spark, d):
    return demo.pages(spark, d).select("page_id", T.fingerprint32(F.trim("url")).alias("fingerprint"))


# A dirty body from known parts, and what must be left of it.
DIRTY_TAILS = [
    ("<select><option>one<option>two</select>", ""),
    ('<noscript><img src="https://img.example.com/a.jpg" onload="x()"></noscript>',
     '<img src="https://img.example.com/a.jpg" loading="lazy" decoding="async" referrerpolicy="no-referrer" />'),
    ("<ul><li>one<li>two</ul>", "<ul><li>one</li><li>two</li></ul>"),
    ('<a href="javascript:x()" title="t">go</a><form>kept<input></form>', '<a title="t" rel="noopener noreferrer" target="_blank">go</a>kept'),
    ("<table><tr><td>a<td>b<tr><th>c</table><textarea>gone</textarea>", "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>"),
]
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@check("safe_markup", f"""SELECT doc_id, '<p>' || {_ESCAPED} || '</p>' || CASE doc_id % {len(DIRTY_TAILS)}
      {" ".join(f"WHEN {i} THEN {quote(clean)}" for i, (_, clean) in enumerate(DIRTY_TAILS))} END || '<p>' || lang || '</p>' AS content_html FROM documents""")
def safe_markup(spark, d):
    tail = F.element_at(F.array(*[F.lit(dirty) for dirty, _ in DIRTY_TAILS]), (F.col("doc_id") % len(DIRTY_TAILS) + 1).cast("int"))
    script = F.concat(F.lit("<script>track("), "doc_id", F.lit(")</script><style>p{}</style></p>"))
    body = F.concat(F.lit('<div class="x"><P onclick="x()" style="a">'), T.escape_html(F.col("text")), script, tail, F.lit("</div><p>"), "lang")
    return demo.table(spark, d, "documents").select("doc_id", sanitize_html(body).alias("content_html"))


@check("first_images", "SELECT page_id, CASE WHEN starts_with(regexp_extract(html, '(?is)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1), 'http') "
       "THEN regexp_extract(html, '(?is)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1) END AS image_url FROM web", "web")
def first_images(spark, d):
    return demo.pages(spark, d).select("page_id", T.first_image(F.col("html")).alias("image_url"))


@check("story_topics", "SELECT id, array_to_string(topics, ',') AS topics FROM items", "items")
def story_topics(spark, d):
    return demo.items(spark, d).select("id", F.array_join("topics", ",").alias("topics"))


TOKENS = (
    "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[''’]', '', 'g'), '[^a-z0-9]+'), "
    f"lambda w: length(w) > 2 AND NOT list_contains({sql_list(K.STOPWORDS)}, w)))"
)


@check("title_tokens", f"SELECT id, array_to_string(list_sort({TOKENS}), ' ') AS tokens FROM items", "items")
def title_token_sets(spark, d):
    return demo.items(spark, d).select("id", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("tokens"))


@check("cluster_keys", f"SELECT id, substr(array_to_string(list_sort({TOKENS}), '-'), 1, 200) AS cluster_key FROM items", "items")
def cluster_keys(spark, d):
    return demo.items(spark, d).select("id", T.cluster_key(F.col("title")).alias("cluster_key"))


@check("posts_without_links", f"""SELECT doc_id, {squeeze_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' reut.rs/' || doc_id || ' , see https://t.co/' || doc_id || '  now', '(?i)https?://[^S]+', '', 'g'), '(?i)\\b[a-z0-9-]+\\.[a-z]{2,6}/[^S]+', '', 'g'), '[S]{2,}', ' ', 'g'), '[S]+([.,;:!?])', '\\1', 'g')".replace('S]', RE2_SPACE + ']')).replace("'[" + RE2_SPACE + "]+', ' ', 'g'), '^ +| +$'", "'^[" + RE2_SPACE + "]+|[" + RE2_SPACE + "]+$', '', 'g'), '^ +| +$'")} AS post_text FROM documents""")
def posts_without_links(spark, d):
    post = F.concat("text", F.lit(" reut.rs/"), "doc_id", F.lit(" , see https://t.co/"), "doc_id", F.lit("  now"))
    return demo.table(spark, d, "documents").select("doc_id", T.strip_urls(post).alias("post_text"))


@check("posts_as_html", """SELECT conv_id, turn, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'
      || CASE WHEN turn % 2 = 0 THEN '<p><a href="https://example.com/?a=1&amp;b=' || conv_id || '" rel="noopener noreferrer" target="_blank">'
      || CASE WHEN conv_id % 2 = 0 THEN role ELSE 'https://example.com/?a=1&amp;b=' || conv_id END || '</a></p>' ELSE '' END AS content_html
      FROM conversations""")
def posts_as_html(spark, d):
    link = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://example.com/?a=1&b="), "conv_id"))
    title = F.when(F.col("conv_id") % 2 == 0, F.col("role"))
    return demo.table(spark, d, "conversations").select("conv_id", "turn", T.post_html(F.col("text"), link, title).alias("content_html"))


HINT_TITLE = ("CASE doc_id % 6 WHEN 0 THEN 'Correction: ' WHEN 1 THEN 'UPDATE: ' WHEN 2 THEN 'Retraction of ' WHEN 3 THEN 'Updated: ' "
              "ELSE '' END || regexp_extract(text, '^[^.\n]*')")


@check("correction_notes", f"""WITH t AS (SELECT doc_id, {HINT_TITLE} AS title, text AS summary FROM documents),
      h AS (SELECT doc_id, title, CASE WHEN regexp_matches(lower(title || ' ' || summary), '\\bretract(?:ed|ion)\\b') THEN 'retracted'
        WHEN regexp_matches(lower(title || ' ' || summary), '(?:^|\\b)(?:correction|corrected)(?::|\\b)') THEN 'corrected'
        WHEN regexp_matches(title, '(?i)^(?:updated?|update):') THEN 'updated' END AS status_hint FROM t)
      SELECT doc_id, status_hint, CASE WHEN status_hint IS NOT NULL THEN title END AS correction_note FROM h""")
def correction_notes(spark, d):
    k = F.col("doc_id") % 6
    prefix = F.when(k == 0, "Correction: ").when(k == 1, "UPDATE: ").when(k == 2, "Retraction of ").when(k == 3, "Updated: ").otherwise("")
    t = demo.table(spark, d, "documents").select("doc_id", F.concat(prefix, demo.first_sentence(F.col("text"))).alias("title"), "text")
    t = t.withColumn("status_hint", T.status_hint(F.col("title"), F.col("text")))
    return t.select("doc_id", "status_hint", F.when(F.col("status_hint").isNotNull(), F.col("title")).alias("correction_note"))


HN_LINE = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'plain words' ELSE (value * 10)::int || ' points · ' || (event_id % 400)
    || ' comments on Hacker News' END AS excerpt, (value * 10)::int AS pts, event_id % 400 AS cmts, event_type = 'error' AS plain,
    event_id % 5 AS covered, CASE WHEN event_id % 3 = 0 THEN 'social' ELSE 'news' END AS cls FROM events"""


@check("discussion_figures", f"""WITH h AS ({HN_LINE})
      SELECT event_id, CASE WHEN NOT plain THEN pts::bigint END AS points, CASE WHEN NOT plain THEN cmts::bigint END AS comments,
        round(least(1.0, greatest(covered / 4.0, CASE WHEN plain THEN 0 ELSE least(cmts / 300.0, 1.0) END, CASE WHEN cls = 'social' THEN 0.25 ELSE 0 END))::double, 6) AS velocity,
        round(CASE WHEN plain OR pts < 30 THEN 0 ELSE least(1.0, greatest(0.0, (cmts::double / pts - 0.8) / 1.2)) END::double, 6) AS controversy
      FROM h""")
def discussion_figures(spark, d):
    e = F.col("event_id")
    points = F.rint(F.col("value") * 10).cast("int")
    t = demo.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "plain words").otherwise(
            F.concat(points, F.lit(" points · "), e % 400, F.lit(" comments on Hacker News"))).alias("excerpt"),
        (e % 5).alias("covered"), F.when(e % 3 == 0, "social").otherwise("news").alias("cls"),
    )
    x = F.col("excerpt")
    return t.select(
        "event_id", S.hn_points(x).alias("points"), S.hn_comments(x).alias("comments"),
        F.round(S.discussion_velocity(F.col("covered"), x, F.col("cls")), 6).alias("velocity"),
        F.round(S.controversy(x), 6).alias("controversy"),
    )


MINS = f"floor(date_diff('second', published_at, {NOW}) / 60.0 + 0.5)"
HRS = f"floor({MINS} / 60.0 + 0.5)"


@check("story_labels", f"""SELECT i.id,
      CASE WHEN i.status = 'retracted' THEN 'Retracted at source' WHEN i.status = 'corrected' THEN 'Corrected at source'
        WHEN i.status = 'updated' THEN 'Updated at source' WHEN verification_status = 'unconfirmed' THEN 'Unconfirmed · single-source social report'
        WHEN verification_status = 'corroborated' THEN 'Corroborated by ' || (i.id % 4 + 1) || ' sources' ELSE 'Reported by ' || s.name END AS verification,
      CASE WHEN i.id % 3 > 0 THEN CASE WHEN length({squeeze_sql('excerpt')}) <= 150 THEN {squeeze_sql('excerpt')}
          ELSE rtrim(substr({squeeze_sql('excerpt')}, 1, 147)) || '…' END
        WHEN i.id % 4 > 0 THEN 'Covered by ' || (i.id % 4 + 1) || ' sources.'
        WHEN date_diff('second', published_at, {NOW}) < 3600 THEN 'Breaking now in World.'
        WHEN word_count > 0 THEN greatest(1, floor(word_count / 230.0 + 0.5)::int) || ' minute read.' ELSE 'Recommended in World.' END AS context,
      CASE WHEN {MINS} < 1 THEN 'now' WHEN {MINS} < 60 THEN {MINS}::int || 'm' WHEN {HRS} < 24 THEN {HRS}::int || 'h'
        WHEN floor({HRS} / 24.0 + 0.5) < 7 THEN strftime(published_at, '%a') ELSE strftime(published_at, '%b %-d') END AS age,
      CASE i.topics[1] {" ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in K.TOPIC_LABELS.items())} END AS topic,
      strftime(published_at, '%A, %B %-d, %Y') AS full_date, strftime(published_at, '%A, %B %-d') AS masthead
      FROM items i JOIN sources s ON s.id = i.source_id""", "items sources")
def story_labels(spark, d):
    c = F.col
    names = demo.sources(spark, d).select(c("id").alias("source_id"), "name")
    covered = c("id") % 4
    excerpt = F.when(c("id") % 3 > 0, c("excerpt"))
    return demo.items(spark, d).join(names, "source_id").select(
        "id", S.verification_label(c("status"), c("verification_status"), covered, c("name")).alias("verification"),
        S.story_context(excerpt, covered, c("published_at"), S.reading_minutes(c("word_count")), F.lit("World"), demo.now()).alias("context"),
        S.age_label(c("published_at"), demo.now()).alias("age"), S.topic_label(c("topics")[0]).alias("topic"),
        S.full_date(c("published_at")).alias("full_date"), S.masthead_date(c("published_at")).alias("masthead"),
    )
