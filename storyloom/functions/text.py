"""Text clean-up, fingerprints, title tokens and topic classification as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Browser whitespace: wider than Java's \s.
SPACE = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
UNIT_SEPARATOR = "␟"
REPLACEMENT = "�"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


# The same characters, spelled out.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def squeeze(text: Column) -> Column:
    """One blank for each run of white space and none at the ends, without a pattern over a wide class."""
    return F.trim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), "  +", " "))


def _code_point(code: Column) -> Column:
    valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    raw = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(valid, raw).otherwise(F.lit(REPLACEMENT))


def _decode_pieces(text: Column, opener: str, pattern: str, decode) -> Column:
    """One left-to-right pass: split on ``opener`` and decode each piece that starts like an entity."""

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, pattern, 1)
        rest = F.regexp_replace(p, pattern, "")
        return F.when(p.rlike(pattern), F.concat(decode(name), rest)).otherwise(F.concat(F.lit(opener), p))

    def rejoin(pieces: Column) -> Column:
        tail = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.concat(pieces[0], F.array_join(F.transform(tail, piece), ""))

    return bind(
        text, lambda t: F.when(t.contains(opener), bind(F.split(t, opener), rejoin)).otherwise(t)
    )


def decode_entities(text: Column) -> Column:
    """Decimal, then hexadecimal, then named entities, each in its own pass."""
    named = F.create_map(*[F.lit(x) for kv in K.NAMED_ENTITIES.items() for x in kv])
    text = _decode_pieces(
        text, "&#", "^([0-9]+);",
        lambda n: _code_point(F.coalesce(n.try_cast("bigint"), F.lit(-1))),
    )
    text = _decode_pieces(
        text, "&#", "^[xX]([0-9a-fA-F]+);",
        lambda n: _code_point(F.when(F.length(F.ltrim(n, F.lit("0"))) <= 12, F.conv(n, 16, 10).try_cast("bigint")).otherwise(F.lit(-1))),
    )
    return _decode_pieces(text, "&", "^([a-zA-Z]+);", lambda n: F.coalesce(F.try_element_at(named, n), F.lit(" ")))


def squeeze_start(text: Column, length: int) -> Column:
    """``squeeze``, but of a text that stays longer than ``length`` only a beginning longer than that."""
    start = squeeze(F.substring(text, 1, 4 * length))
    return bind(start, lambda s: F.when(F.length(s) > length, s).otherwise(squeeze(text)))


def _without_markup(html: Column) -> Column:
    text = F.regexp_replace(html, "(?is)<style.*?</style>", "")
    text = F.regexp_replace(text, "(?is)<script.*?</script>", "")
    text = F.when(html.contains("<"), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(html)
    return decode_entities(text)


def strip_html(html: Column) -> Column:
    return squeeze(_without_markup(html))


def count_words(html: Column) -> Column:
    return bind(
        strip_html(F.coalesce(html, F.lit(""))),
        lambda text: F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1),
    )


def make_excerpt(description: Column, body: Column) -> Column:
    """The publisher's description, else the opening of the body, cut at a word; null when both are empty."""
    said = trim_all(F.coalesce(description, F.lit("")))
    usable = (said != "") & ~F.lower(said).isin(*K.PLACEHOLDER_TEXTS)
    whole = _without_markup(F.when(usable, description).otherwise(F.coalesce(body, F.lit(""))))
    # What follows the cut is not looked at, however long the body is.
    base = bind(whole, lambda t: squeeze_start(t, K.EXCERPT_MAX))

    def shortened(cut: Column) -> Column:
        last_space = F.length(cut) - F.locate(" ", F.reverse(cut))
        whole_words = F.when(cut.contains(" ") & (last_space > K.EXCERPT_MIN_CUT), last_space).otherwise(F.lit(K.EXCERPT_MAX))
        return F.concat(F.substring(cut, F.lit(1), whole_words), F.lit("…"))

    def pick(t: Column) -> Column:
        long_text = bind(F.substring(t, 1, K.EXCERPT_MAX), shortened)
        return F.when(F.length(t) > K.EXCERPT_MAX, long_text).when(t != "", t)

    return bind(base, pick)


def first_image(html: Column) -> Column:
    src = F.regexp_extract(html, K.IMAGE_PATTERN, 1)
    return F.when(src.startswith("http"), src)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def fingerprint(*parts: Column) -> Column:
    """Change-detection hash of the non-null parts."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256)


def fingerprint32(*parts: Column) -> Column:
    """32-bit variant over UTF-16 units, for stores that already hold such values."""
    quads = F.hex(F.encode(F.concat_ws(UNIT_SEPARATOR, *parts), "UTF-16BE"))
    units = F.filter(F.split(quads, "(?<=\\G.{4})"), lambda q: q != "")
    folded = F.aggregate(
        units,
        F.lit(0x811C9DC5).cast("bigint"),
        lambda h, q: (h.bitwiseXOR(F.conv(q, 16, 10).cast("bigint")) * F.lit(0x01000193).cast("bigint")).bitwiseAND(
            F.lit(0xFFFFFFFF).cast("bigint")
        ),
    )
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def title_tokens(title: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(title), "['’]", ""), "[^a-z0-9]+")
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*[F.lit(w) for w in K.STOPWORDS]))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def cluster_key(title: Column) -> Column:
    return F.substring(F.array_join(F.sort_array(title_tokens(title)), "-"), 1, 200)


def strip_urls(text: Column) -> Column:
    text = F.regexp_replace(text, f"(?i)https?://[^{SPACE}]+", "")
    text = F.regexp_replace(text, f"(?i)\\b[a-z0-9-]+\\.[a-z]{{2,6}}/[^{SPACE}]+", "")
    text = F.regexp_replace(text, f"[{SPACE}]{{2,}}", " ")
    return trim_all(F.regexp_replace(text, f"[{SPACE}]+([.,;:!?])", "$1"))


def escape_html(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def post_html(text: Column, link: Column | None = None, link_title: Column | None = None) -> Column:
    """Post text as a paragraph, with the linked article as a second one."""
    body = F.concat(F.lit("<p>"), escape_html(text), F.lit("</p>"))
    if link is None:
        return body
    label = F.coalesce(link_title, link) if link_title is not None else link
    anchor = F.concat(
        F.lit('<p><a href="'), escape_html(link), F.lit('" rel="noopener noreferrer" target="_blank">'),
        escape_html(label), F.lit("</a></p>"),
    )
    return F.concat(body, F.coalesce(F.when(link != "", anchor), F.lit("")))


def shorten(text: Column, limit: int) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, limit), f"[{SPACE}]+$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("…"))).otherwise(text)


def status_hint(title: Column, summary: Column) -> Column:
    """Retraction, correction or update announced in the title or summary; null otherwise."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit(""))))
    return (
        F.when(text.rlike(K.RETRACTED_PATTERN), F.lit("retracted"))
        .when(text.rlike(K.CORRECTED_PATTERN), F.lit("corrected"))
        .when(title.rlike(K.UPDATED_PATTERN), F.lit("updated"))
    )


def term_pattern(term: str) -> str:
    special = set(".*+?^${}()|[]\\")
    escaped = "".join("\\" + ch if ch in special else ch for ch in term)
    return f"(?i)(?:^|[^a-z0-9]){escaped}(?:$|[^a-z0-9])"


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = "struct<topic:int,strong:boolean,term:string,pattern:string>"


class TermIndex:
    """Terms by their words, so that a text is looked at once whatever the number of terms.

    The words of a text (runs of a-z and 0-9) and their sequences are looked up in one hashed set; only the terms that
    are found by their words are tried by pattern, as a term may hold other characters between or around them.
    """

    def __init__(self, rows: list[dict]):
        by_words: dict[str, list[dict]] = {}
        for row in rows:
            by_words.setdefault(" ".join(re.findall("[a-z0-9]+", row["term"])), []).append(row)
        self.wordless = by_words.pop("", [])
        self.by_words = by_words
        self.lengths = sorted({w.count(" ") + 1 for w in by_words})
        self.openers = {n: sorted({w.split(" ")[0] for w in by_words if w.count(" ") + 1 == n}) for n in self.lengths}

    def matched(self, text: Column) -> Column:
        """The terms that the text holds."""
        words = F.filter(F.split(F.translate(text, _CAPITALS, _SMALL), "[^a-z0-9]+"), lambda w: w != "")
        known = list(self.by_words)
        lookup = F.from_json(F.lit(json.dumps(self.by_words)), f"map<string,array<{_TERM}>>")
        wordless = F.from_json(F.lit(json.dumps(self.wordless)), f"array<{_TERM}>")

        def sequences(w: Column, n: int) -> Column:
            if n == 1:
                return w
            # Only the places of a word that begins such a term are joined to texts.
            opens = F.filter(F.transform(w, lambda x, i: F.when(x.isin(self.openers[n]), i + 1)), lambda i: i.isNotNull())
            starts = F.filter(opens, lambda i: i <= F.size(w) - n + 1)
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

        def found(w: Column) -> Column:
            hits = F.array_distinct(F.concat(*[F.filter(sequences(w, n), lambda g: g.isin(known)) for n in self.lengths]))
            return F.concat(wordless, F.flatten(F.transform(hits, lambda g: F.element_at(lookup, g))))

        tried = bind(words, found) if known else wordless
        return F.filter(tried, lambda x: F.regexp_like(text, x["pattern"]))


def classify(title: Column, excerpt: Column, hints: Column, taxonomy=None) -> Column:
    """Up to three topics by weighted term hits; the source's hints when nothing matches.

    The taxonomy is one constant index, so the plan stays small and a text is read once, whatever its size.
    """
    taxonomy = taxonomy or K.TAXONOMY
    rows = [
        {"topic": order, "strong": strong, "term": term.lower(), "pattern": term_pattern(term)}
        for order, (_, strong_terms, weak_terms) in enumerate(taxonomy)
        for strong, terms in ((True, strong_terms), (False, weak_terms))
        for term in terms
    ]
    terms = TermIndex(rows)
    names = F.from_json(F.lit(json.dumps([topic for topic, _, _ in taxonomy])), "array<string>")

    def points(found: Column, topic: Column) -> tuple[Column, Column]:
        own = F.filter(found, lambda x: x["topic"] == topic)
        strong = F.size(F.filter(own, lambda x: x["strong"]))
        return F.size(own) + strong, strong

    def total(h: Column, topic: Column) -> Column:
        in_title, strong_title = points(h["title"], topic)
        in_excerpt, strong_excerpt = points(h["excerpt"], topic)
        score = F.struct((3 * in_title + in_excerpt).alias("n"), (strong_title + strong_excerpt > 0).alias("strong"))
        return bind(score, lambda p: F.when(p["strong"], p["n"] + 3).when(p["n"] >= 2, p["n"]))

    def best(h: Column) -> Column:
        present = F.array_distinct(F.concat(h["title"]["topic"], h["excerpt"]["topic"]))
        ranked = F.transform(present, lambda t: F.struct(total(h, t).alias("total"), (-t).alias("ord")))
        kept = F.slice(F.sort_array(F.filter(ranked, lambda r: r["total"].isNotNull()), asc=False), 1, 3)
        return F.transform(kept, lambda r: F.element_at(names, 1 - r["ord"]))

    found = F.struct(
        terms.matched(title).alias("title"),
        terms.matched(F.coalesce(excerpt, F.lit(""))).alias("excerpt"),
    )
    return bind(bind(found, best), lambda topics: F.when(F.size(topics) > 0, topics).otherwise(hints))
