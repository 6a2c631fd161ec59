"""Feed tables derived from the driver's parquet files, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions import text as T
from .functions.story import minutes

NOW_TEXT = "2024-01-31 00:00:00"

# Topic terms taken from the invented words of the test documents.
TEST_TAXONOMY = [
    ("nba", ["thanedble"], ["anea", "eriner", "of the"]),
    ("tech", ["therhean"], ["tion", "thon", "thing"]),
    ("ai", [], ["ing", "than"]),
    ("vc", ["oredble"], ["eror", "innd"]),
    ("taiwan", ["nicht"], ["und", "der", "sch"]),
    ("us-politics", ["elle"], ["que", "aux", "des"]),
    ("world", ["reedes"], ["from", "this"]),
    ("business", [], ["thnt", "thble", "are"]),
    ("science", [], ["was", "thes"]),
    ("media", ["enmentai"], ["los", "para", "las"]),
]


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source_number() -> Column:
    return F.substring("source", 4, 10).cast("bigint")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct document source, with every policy and fetch-state column."""
    n = F.col("id")
    cls = F.element_at(F.array(F.lit("social"), F.lit("news"), F.lit("longform")), (n % 3 + 1).cast("int"))
    tier = F.when(n % 4 == 1, "major").when(cls == "social", "social").otherwise("independent")
    ok_at = F.when(n % 9 != 0, now() - minutes((n * 7 % 50).cast("int")))
    return (
        table(spark, sf_dir, "documents")
        .select(_source_number().alias("id")).distinct()
        .select(
            "id",
            F.element_at(F.array(*[F.lit(k) for k in ("rss", "hn", "bluesky", "x", "substack")]), (n % 5 + 1).cast("int")).alias("kind"),
            cls.alias("source_class"),
            F.concat(F.lit("Source "), n).alias("name"),
            F.concat(F.lit("https://src"), n, F.lit(".example.com/feed")).alias("feed_url"),
            F.concat(F.lit("https://www.src"), n, F.lit(".example.com/")).alias("homepage_url"),
            F.array(F.element_at(F.array(*[F.lit(t) for t in K.KNOWN_TOPICS]), (n % 10 + 1).cast("int"))).alias("topic_hints"),
            (F.lit(0.5) + (n % 10) * F.lit(0.05)).alias("quality_prior"),
            tier.alias("credibility_tier"),
            F.concat(F.lit("fam"), n % 12).alias("source_family"),
            F.when(cls == "longform", 30).when((tier == "major") | (cls == "social"), 5).otherwise(10).alias("poll_interval_minutes"),
            ((cls == "longform") | ((cls == "social") & (tier == "social"))).alias("named_author_required"),
            (n % 10 != 7).alias("active"),
            ok_at.alias("last_successful_fetch_at"),
            F.when(n % 7 != 0, now() + minutes(((n % 5 - 2) * 10).cast("int"))).alias("next_fetch_at"),
            F.lit(None).cast("string").alias("last_status"),
        )
    )


def hints(source_id: Column) -> Column:
    return F.array(F.element_at(F.array(*[F.lit(t) for t in K.KNOWN_TOPICS]), (source_id % 10 + 1).cast("int")))


def first_sentence(text: Column) -> Column:
    """Up to the first full stop or line end."""
    return F.regexp_extract(text, "^[^.\\n]*", 0)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    published = now() - minutes((i * 37 % 10080).cast("int"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), _source_number().alias("source_id"), "text", "n_chars",
        first_sentence(F.col("text")).alias("title"), T.make_excerpt(F.lit(None).cast("string"), F.col("text")).alias("excerpt"),
    )
    url = F.concat(F.lit("https://src"), F.col("source_id"), F.lit(".example.com/story/"), i)
    return docs.select(
        "id", "source_id", F.concat(F.lit("doc-"), i).alias("guid"),
        F.when(i % 5 != 0, F.concat(F.lit("Author "), i % 17)).alias("author"),
        "title", url.alias("url"),
        F.when(i % 40 < 2, F.concat(F.lit("https://wire.example.com/"), i - i % 40)).otherwise(url).alias("canonical_url"),
        "excerpt", F.col("text").alias("content_html"), F.lit(None).cast("string").alias("image_url"),
        published.alias("published_at"),
        (published + minutes(2)).alias("fetched_at"),
        F.lit(None).cast("timestamp").alias("source_updated_at"),
        (published + minutes((i % 90).cast("int"))).alias("updated_at"),
        published.alias("first_seen_at"), published.alias("last_seen_at"),
        F.sha2("text", 256).alias("content_fingerprint"),
        F.floor(F.col("n_chars") / 6).cast("int").alias("word_count"),
        F.when(i % 50 == 0, "retracted").when(i % 50 == 1, "corrected").when(i % 50 == 2, "updated").otherwise("active").alias("status"),
        F.when(i % 3 == 0, "reported").when(i % 3 == 1, "corroborated").otherwise("unconfirmed").alias("verification_status"),
        F.lit(None).cast("string").alias("correction_note"),
        T.classify(F.col("title"), F.col("excerpt"), hints(F.col("source_id")), TEST_TAXONOMY).alias("topics"),
        F.when(i % 4 == 0, i * 31 % 97 + 1).alias("cluster_id"),
    )


def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _source_number().alias("source_id"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as reader signals; saves and unsaves of near events fall on one item, so that they meet."""
    n_items = table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).scalar()
    e = F.col("event_id")
    kind = (
        F.when(e % 101 == 7, "hide_source").when(e % 13 == 5, "read_time").when(e % 11 == 3, "unsave")
        .when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "open")
        .when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "signup", "more_like")
        .otherwise("less_like")
    )
    return table(spark, sf_dir, "events").select(
        e.alias("id"), F.concat(F.lit("p"), F.col("user_id")).alias("profile_id"),
        F.when(kind.isin("save", "unsave"), F.floor(e / 16) % n_items).otherwise(e % n_items).alias("item_id"),
        kind.alias("type"), F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("p"), u).alias("profile_id"),
        F.when(u % 3 == 0, F.array(F.lit("nba"), F.lit("tech")))
        .when(u % 3 == 1, F.array(F.lit("taiwan"), F.lit("us-politics"), F.lit("world")))
        .otherwise(F.array().cast("array<string>")).alias("interests"),
        F.when(u % 4 != 0, now() - F.expr("interval 12 hours")).alias("last_feed_opened_at"),
    )


def mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().filter(u % 5 == 0).select(
        F.concat(F.lit("p"), u).alias("profile_id"), (u % 20).cast("bigint").alias("source_id"),
        now().alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with tracking parameters, entities and images worked into them."""
    p = F.col("page_id")
    extra = F.concat(
        F.lit('<p>Q&amp;A &#8217; &#x2014; &hellip; &unknown; &#38;lt;</p>'),
        F.when(p % 3 == 0, F.concat(F.lit('<IMG alt="x" src="https://img.example.com/'), p, F.lit('.jpg">')))
        .when(p % 3 == 1, F.lit('<img src="/local.png">')).otherwise(F.lit("")),
    )
    url = F.when(p % 4 == 1, F.concat(F.replace("url", F.lit("example"), F.lit("Example")), F.lit(""))).otherwise(F.col("url"))
    url = F.when((p % 6 == 0) & ~F.col("url").contains("#"), F.concat(
        url, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("z="), p, F.lit("&utm_medium=m&b=1&gclid=9"))).otherwise(url)
    return table(spark, sf_dir, "pages").select(
        p.alias("page_id"), F.concat(F.lit(" "), url).alias("url"), F.concat("html", extra).alias("html"),
    )
