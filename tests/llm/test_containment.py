import numpy as np
import pyarrow.parquet as pq
import pytest

from storyloom.llm import containment as C

SF = "/root/testdata/sf0.01"


def plain(docs, items):
    """Contained items of each document by exact comparison with every item."""
    sets = {i: C.shingle_set(C.words_of(t or "")) for i, t in items}
    out = []
    for d, text in docs:
        have = C.shingle_set(C.words_of(text or ""))
        scores = {i: len(s & have) / len(s) for i, s in sets.items() if s and i is not None}
        out.append((d, sorted(i for i, x in scores.items() if x >= C.THRESHOLD)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, list(r["items"])) for r in frame.collect()), key=str)


def test_tables_equal_brute_force(spark):
    docs, items = (pq.read_table(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = C.contained_items(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    want = plain(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True), list(zip(items["item_id"].to_pylist(), items["text"].to_pylist(), strict=True)))
    assert got(found) == want and sum(bool(i) for _, i in want) > 10


@pytest.mark.parametrize("block_bytes", [C.BLOCK_BYTES, 300])
def test_edited_passages_in_long_documents(spark, monkeypatch, block_bytes):
    """Items of many sizes, whole, edited, split in two, or too much changed, inside documents of thousands of words."""
    monkeypatch.setattr(C, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    items, docs = [], []
    for k, n in enumerate([3, 5, 9, 12, 20, 40, 90, 200]):
        item = words(n)
        items.append((k, " ".join(item)))
        edited = [w if i % 31 else "changed" for i, w in enumerate(item)]
        spoiled = [w if i % 4 else "changed" for i, w in enumerate(item)]
        halves = [*item[: n // 2 + 4], *words(300), *item[n // 2 :]]
        for m, part in enumerate((item, edited, spoiled, halves)):
            docs.append((100 * k + m, " ".join([*words(2000), *part, *words(3000)])))
        docs.append((100 * k + 9, ", ".join(item).upper()))
    items += [(50, items[4][1]), (51, None), (52, " ... "), (None, items[4][1])]
    found = C.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain(docs, items)
    assert got(found) == want and sum(bool(i) for _, i in want) >= 20


def test_items_of_few_shingles_are_all_found():
    """Thousands of short items, whole or with a changed end, inside documents of hundreds of words."""
    rng = np.random.default_rng(3)
    missed = 0
    for n in (3, 5, 6, 7, 9, 12):
        items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))) for k in range(400)]
        index = C.Index(items, C.SHINGLE_WORDS, C.THRESHOLD, C.FUNCTIONS)
        docs = []
        for _, item in items:
            words = item.split()
            around = [] if n < C.SHINGLE_WORDS else [f"x{x}" for x in rng.integers(0, 100_000, 150)]
            docs.append(C.words_of(" ".join([*around, *(words[:-1] + ["changed"] if n >= 9 else words), *around])))
        found = index.candidates([C._hashes(d, C.SHINGLE_WORDS) for d in docs])
        for k, d in enumerate(docs):
            held = len(index.sets[k] & C.shingle_set(d)) >= C.THRESHOLD * len(index.sets[k])
            missed += held and k not in found[k]
            assert held
    assert missed == 0


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "some words under the MIT license"), (2, "a row without an id")], "item_id long, text string").selectExpr("*", "'x' as items")
    found = C.contained_items(odd_docs, items)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(found) == plain(rows, [(r.item_id, r.text) for r in items.collect()])
    assert {r.doc_id for r in found.where("contaminated").collect()} == {1, 8, None}
    assert C.contained_items(no_docs, items).collect() == []
    clean = C.contained_items(odd_docs, items.where("false"))
    assert clean.count() == odd_docs.count() and clean.where("contaminated").count() == 0
