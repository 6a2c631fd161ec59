import pytest
from pyspark.sql import functions as F

from storyloom.functions import story as S
from storyloom.functions import text as T
from storyloom.functions.markup import clean_markup, sanitize_html
from storyloom.functions.urls import canonicalize_url


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


URLS = [
    ("HTTPS://Harbor.Example/Tides?page=3&utm_content=top&gclid=q9#low", "https://harbor.example/Tides?page=3"),
    ("https://harbor.example/?ref=home", "https://harbor.example"),
    ("http://harbor.example:80?q=salt marsh", "http://harbor.example/?q=salt+marsh"),
    ("https://harbor.example:443/x:8443/", "https://harbor.example/x:8443"),
    ("https://harbor.example/é/日?a=1", "https://harbor.example/%C3%A9/%E6%97%A5?a=1"),
    ("https://harbor.example/%C3%A9/100%", "https://harbor.example/%C3%A9/100%"),
    ("https://harbor.example/a/./b/../../c/%2e%2E/d", "https://harbor.example/d"),
    ("https://harbor.example/a/b/..", "https://harbor.example/a"),
    ("https://harbor.example/../../a", "https://harbor.example/a"),
    ("https://Keeper:Pw@Harbor.Example/dock", "https://Keeper:Pw@harbor.example/dock"),
    ("https://harbor.example/old quay/\tpier", "https://harbor.example/old%20quay/pier"),
    ("https://harbor.example/l?z=1&m=2&m=1&a=", "https://harbor.example/l?a=&m=2&m=1&z=1"),
    ("ftp://harbor.example/a?b=2&a=1", "ftp://harbor.example/a?b=2&a=1"),
    ("  plain words  ", "plain words"),
    ("https://", "https://"),
]


def test_urls(spark):
    assert column(spark, [u for u, _ in URLS], canonicalize_url) == [c for _, c in URLS]


def test_canonical_urls_stay(spark):
    canonical = [c for _, c in URLS]
    assert column(spark, canonical, canonicalize_url) == canonical


def test_markup_to_text(spark):
    got = column(spark, [
        "Salt &amp; pepper&nbsp;&ndash;<em>ground</em>", "&#x26;amp; &#9731;!", "&nosuch;x", "a<STYLE>b{}</STYLE>c<script src='d'>e</script>f", "&#xD800;&#1114112;", "one<br>　two ",
    ], T.strip_html)
    assert got == ["Salt & pepper – ground", "& ☃!", "x", "acf", "��", "one two"]


def test_squeeze_and_words(spark):
    assert column(spark, ["﻿ a\t\tb \n c ", " ", ""], T.squeeze) == ["a b c", "", ""]
    assert column(spark, ["<p>a b</p><p>c</p>", "", None, " \n "], T.count_words) == [3, 0, 0, 0]


def test_excerpts(spark):
    body = "<div>" + "lantern " * 90 + "</div>"
    rows = spark.createDataFrame([
        (0, "Tide tables <b>revised</b>", body), (1, "", body), (2, " n/a ", "<p>From the body</p>"), (3, "Undefined", ""), (4, None, "x" * 400), (5, None, None),
    ], "i int, d string, b string")
    got = [r.x for r in rows.select("i", T.make_excerpt(F.col("d"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got[0] == "Tide tables revised"
    assert got[1] == ("lantern " * 39 + "lantern")[:319].rsplit(" ", 1)[0] + "…" or (got[1].endswith("…") and len(got[1]) <= 321)
    assert got[2:] == ["From the body", None, "x" * 320 + "…", None]


def test_fingerprint32(spark):
    """Published values of the 32-bit hash: the offset basis for nothing, and one letter over 16-bit units."""
    assert column(spark, ["", "a"], T.fingerprint32) == ["811c9dc5", "e40c292c"]


CLEAN = [
    ("2 < 3 & 4", "2 &lt; 3 &amp; 4"),
    ('<h2 class="k" onmouseover="f()">Quay</h2>', "<h2>Quay</h2>"),
    ('<a href=" jav\tascript:f()">no</a><a href="/rel">yes</a>', '<a rel="noopener noreferrer" target="_blank">no</a><a href="/rel" rel="noopener noreferrer" target="_blank">yes</a>'),
    ('<img src="//img.example/b.png" alt="a&quot;b">', '<img src="//img.example/b.png" alt="a&quot;b" loading="lazy" decoding="async" referrerpolicy="no-referrer" />'),
    ("<p>before</p><select><option>x<option>y</select><p>after</p>", "<p>before</p><p>after</p>"),
    ("<select><optgroup><option>x<p>after", "<p>after</p>"),
    ("<noscript><em>kept</em></noscript>", "<em>kept</em>"),
    ("<p>one<p>two<ul><li>three<li>four</ul>five", "<p>one</p><p>two</p><ul><li>three</li><li>four</li></ul>five"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
    ("<table><tr><td>a<td><p>b<tr><td>c</table>d", "<table><tr><td>a</td><td><p>b</p></td></tr><tr><td>c</td></tr></table>d"),
    ("<b>open <i>both", "<b>open <i>both</i></b>"),
    ("</p>stray</b>", "stray"),
    ("<textarea><b>x</b></textarea>y<style>z</style><script>w", "y"),
    ("<x-y>inner</x-y><br/><hr>", "inner<br /><hr />"),
]


@pytest.mark.parametrize("dirty, clean", CLEAN)
def test_sanitize(dirty, clean):
    assert clean_markup(dirty) == clean
    assert clean_markup(clean) == clean


def test_sanitize_column(spark):
    assert column(spark, [CLEAN[1][0], None], sanitize_html) == [CLEAN[1][1], None]


OWN_TAXONOMY = [("sea", ["lighthouse"], ["tide", "harbor", "c++"]), ("hill", ["summit hut"], ["ridge", "scree"]), ("sky", [], ["cloud"]), ("rock", [], ["scree"])]


@pytest.mark.parametrize(
    "title, excerpt, topics",
    [
        ("Lighthouse keeper retires", None, ["sea"]),
        ("A ridge walk", None, ["hill"]),
        ("Nothing here", "one tide", ["hint"]),
        ("Nothing here", "tide and harbor", ["sea"]),
        ("Tides and ridges", None, ["hint"]),
        ("Cloud over the ridge", "the Summit Hut and a lighthouse", ["hill", "sea", "sky"]),
        ("scree, cloud, C++ and a summit hut", None, ["hill", "sea", "sky"]),
        ("", None, ["hint"]),
    ],
)
def test_topics(spark, title, excerpt, topics):
    df = spark.createDataFrame([(title, excerpt, ["hint"])], "t string, e string, h array<string>")
    assert df.select(T.classify(F.col("t"), F.col("e"), F.col("h"), OWN_TAXONOMY).alias("x")).first().x == topics


def test_default_taxonomy_names_known_topics(spark):
    df = spark.createDataFrame([("A telescope and a vaccine", None, ["media"]), ("Quiet village fair", None, ["media"])], "t string, e string, h array<string>")
    assert [r.x for r in df.select(T.classify(F.col("t"), F.col("e"), F.col("h")).alias("x")).collect()] == [["science"], ["media"]]


@pytest.mark.parametrize(
    "a, b, similarity",
    [
        ("Ferry crews end strike", "Strike by ferry crews ends", 3 / 5),
        ("The ferry's crew", "ferrys crew", 1.0),
        ("Old bridge opens", "Market square flooded", 0.0),
        ("to be or not", "to be or not", 0.0),
        ("a1 b22 c333", "c333 b22", 1.0),
    ],
)
def test_title_similarity(spark, a, b, similarity):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.jaccard(T.title_tokens(F.col("a")), T.title_tokens(F.col("b"))).alias("x")).first().x == pytest.approx(similarity)


def test_posts(spark):
    got = column(spark, ["Low water at noon HTTPS://t.example/x9 , bring boots", "map at harbor.io/m", "release 3.1.4 is out", "https://only.example"], T.strip_urls)
    assert got == ["Low water at noon, bring boots", "map at", "release 3.1.4 is out", ""]


def test_controversy(spark):
    got = column(spark, ["60 points · 120 comments on Hacker News", "60 points · 30 comments on Hacker News", "20 points · 90 comments on Hacker News", "no figures"], S.controversy)
    assert got == [pytest.approx(1.0), 0.0, 0.0, 0.0]


def test_topic_terms_by_index(spark):
    """Terms of several words, with punctuation, without words, and many of them: as one pattern after the other."""
    import random
    import re

    from storyloom.functions import text as X

    rng = random.Random(3)
    terms = ["ai", "a.i.", "of the", "u.s.", "#go", "€", "c++", "new york city", "x-ray", "ing", "méxico"] + [f"term{i} {i % 7}" for i in range(600)] + [f"t{i}" for i in range(600)]
    rows = [{"topic": i % 5, "strong": False, "term": t, "pattern": X.term_pattern(t)} for i, t in enumerate(terms)]
    pieces = ["AI", "a.i.", " of the ", "OF  THE", "u.s", "U.S.", "#Go", "€", "C++", "New York City", "x ray", "X-Ray", "thing", "ing", "México", " ", ",", "term5 5", "term6-6", "T17", "t18x", "\u212aai", "é"]
    texts = ["", "ai", None] + ["".join(rng.choice(pieces) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.found for r in df.select("i", X.TermIndex(rows).matched(F.col("t"))["term"].alias("found")).collect()}
    for i, text in enumerate(texts):
        want = None if text is None else sorted(t for t in terms if re.search("(?:^|[^a-zA-Z0-9])" + "".join(f"[{c}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in t) + "(?:$|[^a-zA-Z0-9])", text))
        assert (sorted(got[i]) if got[i] is not None else None) == want, text
