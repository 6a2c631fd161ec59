import pytest
from pyspark.sql import functions as F

#: Names that operators use for their own columns.
CLASHING = ["ids", "score", "word", "bits", "rep", "items", "containment", "labels", "component_id", "n_tokens", "lang_pred", "__text", "__doc", "__row", "rank", "kind", "n", "form", "output", "prefix_chars", "stats", "label", "weight", "held_out", "predicted", "__id", "__held", "__draws", "__source"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    long_text = ("the very long text of many words that goes on and on\n" * 4000) + "x" * 30_000
    rows = [
        (1, "A plain text of some words under the MIT license.", "en", "s", 3),
        (1, "A plain text of some words under the MIT license.", "en", "s", 3),
        (2, None, None, None, None),
        (3, "", "en", "", 0),
        (4, " \n\t ", "fr", "s", 5),
        (5, long_text, "en", "s", len(long_text)),
        (6, "12345 !!! 678", "de", "s", 9),
        (7, "Ünïcödé ▁ marks ﷽ 😀 and\x00controls", "de", None, 1),
        (None, "A row without an id", "en", "s", 1),
        (8, "A plain text of some words under the MIT license.", "en", "s", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
