"""The corpus pipeline: documents to token identifiers in five stages, each reading what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import containment, language_id, pii, pieces, simhash
from storyloom.llm.common import table
from storyloom.llm.queries import PSEUDONYM_KEY, model_path
from storyloom.session import materialize


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one struct beside their text, so that their columns cannot clash with those of an operator."""
    return docs.select(F.struct("*").alias("__row"), F.col("text").alias("__whole"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays."""
    return simhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = containment.contained_items(_packed(docs), table(spark, sf_dir, "benchmark"), "__row", "__whole")
    return found.where(~F.col("contaminated")).select("__row.*")


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; ``n_chars`` follows the text."""
    new = pii.pseudonymize(_packed(docs), PSEUDONYM_KEY, ["__row"], "__whole")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return new.select([changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of identifiers and decoded texts; ``pieces.encode_texts`` gives the identifiers themselves."""
    return pieces.round_trip_digests(docs, model_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_pseudonyms", pseudonymize),
    ("sentencepiece", encode),
]
#: The stages hold a trained model and merge rounds, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read back as the next one's input.

    ``release_scratch`` drops the stored results, once the last one has been read.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
