import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from storyloom.llm import components, simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    import re

    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """Smallest id reachable, from (id, fingerprint) pairs with all pairs of fingerprints."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, f in enumerate(prints):
        for g in prints[:i]:
            if (f ^ g).bit_count() <= 3:
                parent[find(f)] = find(g)
    least = {}
    for d, f in pairs:
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f"{f:016x}", least[find(f)]) for d, f in pairs}


def test_fingerprints(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).slice(0, 150).to_pylist()
    for row in table:
        assert simhash.fingerprint(row["text"]) == plain_fingerprint(row["text"])
    native = spark.createDataFrame([("a b c",)], "s string").selectExpr("xxhash64(s) as h").first().h
    assert simhash.fingerprint("A b\tC") == native & (1 << 64) - 1


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert {tuple(r) for r in got} == plain_components(prints)


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_loses_no_link(spark, seed):
    """Dense clusters of fingerprints: every pair within three bits is found, and no other."""
    rng = random.Random(seed)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            prints.add(f)
    prints = sorted(prints)
    rows = [(int(np.array(f, np.uint64).view(np.int64)),) for f in prints]
    found = simhash.linked_fingerprints(spark.createDataFrame(rows, "bits long")).collect()
    number = {r[0]: i for i, r in enumerate(rows)}
    got = {tuple(sorted((number[r.a], number[r.b]))) for r in found}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (5000, 4000), (4000, 5000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)} | {4000: 4000, 5000: 4000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_documents(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    by_id = {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()}
    assert got.count() == odd_docs.count()
    assert by_id[2] == by_id[3] == by_id[4] == ("0" * 16, 2)
    assert by_id[8][1] == 1 and by_id[None][1] is None
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 7, None], key=str)
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_first(no_docs).collect() == []


A, B = "one two three four five six", "quite another text with other words in it"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0), (1, 0, 2)])
def test_ids_with_several_texts(spark, order):
    """An id keeps a row in each group that it is the first of; a clean text under the id of a copy stays."""
    rows = [(5, B, 1), (3, A, 2), (5, A, 3)]
    docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string, __first int").coalesce(1)
    assert sorted(tuple(r) for r in simhash.keep_first(docs).collect()) == [(3, A, 2), (5, B, 1)]
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    a, b = (f"{simhash.fingerprint(t):016x}" for t in (A, B))
    assert found == {(3, a): 3, (5, a): 3, (5, b): 5}


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, equal ids with near texts, and columns that Spark cannot order."""
    rows = [(1, A), (1, A), (1, B), (2, B), (None, A), (7, None), (8, ""), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map(1, doc_id) AS __row", "1 AS __hash", "2 AS component")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 4 and {(1, A), (1, B), (None, A)} <= set(got) and sum(r[0] == 7 for r in got) == 1
