"""Fill-in-middle against a plain version, and round trips."""

import hashlib
import random
import re

import pytest

from storyloom.llm import fim

SF = "/root/testdata/sf0.001"


def plain(doc_id, text):
    """(n, form, output, prefix characters, middle characters), cut by a regular expression."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transform(docs)
    got = sorted(made.collect(), key=str)
    assert [tuple(r) for r in got] == sorted(((d, *plain(d, t)) for d, t in rows), key=lambda r: str(fim_row(r)))
    back = fim.restore(made, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((d, t or "") for d, t in rows if d is not None)
    return got


def fim_row(values):
    from pyspark.sql import Row

    return Row("doc_id", "n", "form", "output", "prefix_chars", "middle_chars")(*values)


def test_random_texts(spark):
    rng = random.Random(3)
    letters = ["a", "Zq", " ", "\n", "é", "漢", "😀", "<", ">", "P", "<P", "S>", "M", "\x00", "1", "ß", "<<", "P>"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    forms = [r.form for r in check(spark, rows)]
    assert min(forms.count(f) for f in fim.FORMS) > 100


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "<P>"), (4, "x<M>y"), (5, "<<S>>"), (6, "a" * 3_000_000), (7, "é" * 1_500_000), (None, "no id"), (8, "twice"), (8, "twice"), (9, "<P"), (10, "P>"), (11, "\n")]
    rows += [(i, "") for i in range(20, 60)] + [(i, "<P" if i % 2 else "S>") for i in range(60, 90)]
    check(spark, rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_rates(spark):
    docs = spark.createDataFrame([(i, "some words in a text") for i in range(300)], "doc_id long, text string")
    assert {r.form for r in fim.transform(docs, rewritten=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(docs, rewritten=100, suffix_first=100).collect()} == {"spm"}
    one, two = (sorted(fim.transform(docs, seed=s).collect()) for s in ("1", "2"))
    assert one != two


@pytest.mark.parametrize(
    ("output", "form", "text"),
    [
        ("<P>a<S>c<M>b", "psm", "abc"), ("<S>c<P>a<M>b", "spm", "abc"), ("<P><S><M>", "psm", ""), ("<P>a<S>c<M>b", "spm", None), ("x<P>a<S>c<M>b", "psm", None),
        ("<P>a<S>c", "psm", None), ("<P>a<S>c<M>b<M>", "psm", None), ("<P>a<S>c<M>b", "plain", "<P>a<S>c<M>b"), ("a", "other", None), ("a", None, None), (None, "plain", ""),
    ],
)
def test_restoring_by_form(spark, output, form, text):
    df = spark.createDataFrame([(1, "<P>1<S>3<M>2", "psm"), (2, output, form), (3, "", "plain")], "k int, output string, form string")
    assert {r.k: r.text for r in fim.restore(df, ["k"]).collect()} == {1: "123", 2: text, 3: ""}


def test_clashing_columns_and_no_rows(spark, odd_docs, no_docs):
    made = fim.transform(odd_docs)
    assert made.count() == odd_docs.count() and fim.restore(made, ["doc_id", "n"]).count() == odd_docs.count()
    assert fim.restore(fim.transform(no_docs), ["doc_id"]).collect() == []
