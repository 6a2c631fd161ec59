"""Statistics against a plain version, rules against their trees, and accuracy on held-out labels."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import quality as Q
from storyloom.llm.common import crc_remainder

SF = "/root/testdata/sf0.1"
SYMBOLS, EXCLAIMS = b"#$%&*|<>=^~\\_@+/{}[]", b"!?"


def plain(text):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, letters = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[A-Za-z]", raw))
    blank, lines = count(b" \t\n\x0b\x0c\r"), raw.count(b"\n") + 1
    size, n = max(len(raw), 1), max(len(words), 1)
    odd = [w for w in words if set(w) & set(SYMBOLS + EXCLAIMS)]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        len(raw), len(words), lines, (len(raw) - blank) / n, upper / max(letters, 1), letters / size, len(re.findall(rb"[0-9]", raw)) / size, blank / size,
        count(SYMBOLS) / size, count(EXCLAIMS) / size, count(b".,;:") / size, sum(c > 127 for c in raw) / size,
        again / n, sum(len(w) <= 3 for w in words) / n, len(odd) / n, len(words) / lines,
    ]


@pytest.mark.parametrize("window", [1 << 20, 7, 40])
def test_statistics(monkeypatch, window):
    monkeypatch.setattr(Q, "_WINDOW", window)
    rng = random.Random(window)
    parts = ["the ", "the ", "a", "B", "é", "\n", " ", "!!", "#", "12", ". ", "word ", "\t", "漢字 ", "x" * 9]
    texts = ["", " ", "one", "one one one one one one one one", "\n\n", ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [""]
    got = Q.Measurer().statistics(pa.array(texts))
    want = np.array([plain(t) for t in texts])
    if window == 7:  # a word longer than two windows is cut
        at = [i for i, t in enumerate(texts) if max(map(len, (w.encode() for w in t.split())), default=0) <= 7]
        got, want = got[at], want[at]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_rules_follow_their_tree(spark):
    tree = """Model: depth=2
  If (feature 1 <= 0.5)
   If (feature 0 <= 2.0)
    Predict: 0.0
   Else (feature 0 > 2.0)
    If (feature 1 <= 0.25)
     Predict: 1.0
    Else (feature 1 > 0.25)
     Predict: 0.0
  Else (feature 1 > 0.5)
   Predict: 1.0
"""
    assert Q.path_rules(tree) == {
        ((1, None, 0.5),), ((0, None, 2.0), (1, None, 0.5)), ((0, 2.0, None), (1, None, 0.5)),
        ((0, 2.0, None), (1, None, 0.25)), ((0, 2.0, None), (1, 0.25, 0.5)), ((1, 0.5, None),),
    }
    model = Q.RuleEnsemble(((((0, 2.0, None), (1, 0.25, 0.5)), 1.5), (((1, None, 0.5),), -0.5)), 0.25)
    stats = [[3.0, 0.3], [3.0, 0.2], [1.0, 0.9], [2.0, 0.5], [2.5, 0.5]]
    held = lambda s: 0.25 + (1.5 if s[0] > 2 and 0.25 < s[1] <= 0.5 else 0) - (0.5 if s[1] <= 0.5 else 0)
    got = spark.createDataFrame([(s,) for s in stats], "stats array<double>").select(model.column()).collect()
    np.testing.assert_allclose([r[0] for r in got], [1 / (1 + np.exp(-held(s))) for s in stats])
    assert len(model.describe()) == 2


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return Q.score_quality(docs, labels, crc_remainder("doc_id", 5) == 0).collect()


def test_accuracy_on_held_out_labels(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(scored) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in labels]
    right = lambda q: np.mean([r.predicted == q for r in held if labels[r.doc_id] == q])
    assert len(held) > 500 and right(1) > 0.99 and right(0) > 0.95


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.createDataFrame([(i, "good plain words here. " * (i % 7 + 1) if i % 2 else "BAD!! ### " * (i % 5 + 1)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    held = F.col("doc_id") % 5 == 0
    lied = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(Q.score_quality(docs, x, held, trees=3).collect()) for x in (labels, lied))
    assert one == two and all(r.predicted == r.doc_id % 2 for r in one)


def test_few_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score_quality(odd_docs, none, F.lit(False)).collect()
    assert len(got) == odd_docs.count() and all(r.score == 0.5 for r in got)
    one = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (None, 1, 0), (3, None, 0), (4, 7, 1), (99, 1, 1)], none.schema)
    # Two equal rows with two labels each; nothing else is labelled.
    assert {round(r.score, 9) for r in Q.score_quality(odd_docs, one, F.lit(False)).collect()} == {round(1 / 6, 9)}
    assert Q.score_quality(no_docs, one, F.lit(False)).collect() == []
    both = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (5, 1, 0), (6, 0, 0), (7, 1, 0)], none.schema)
    assert Q.score_quality(odd_docs, both, F.lit(None).cast("boolean"), trees=2).count() == odd_docs.count()
