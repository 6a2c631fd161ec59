"""PPM scores against a plain trie, and base scores against plain counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import ppm


def symbols(text):
    return [ppm.START] * ppm.ORDER + list(text.encode().translate(ppm._TABLE)) + [ppm.END]


def brute(training, texts, least):
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for text in training:
        x = symbols(text)
        for i in range(ppm.ORDER, len(x)):
            for k in range(ppm.ORDER + 1):
                counts[k][tuple(x[i - k : i])][x[i]] += 1
    out = []
    for text in texts:
        x, total = symbols(text), 0.0
        for i in range(ppm.ORDER, len(x)):
            excluded, p, found = set(), 1.0, False
            for k in range(ppm.ORDER, -1, -1):
                seen = counts[k].get(tuple(x[i - k : i]), {})
                own = {s: n for s, n in seen.items() if s not in excluded}
                if not own or (k >= 3 and sum(seen.values()) < least):
                    continue
                if x[i] in own:
                    p, found = p * (own[x[i]] - 0.5) / sum(own.values()), True
                    break
                p *= 0.5 * len(own) / sum(own.values())
                excluded |= own.keys()
            if not found:
                p /= 256 - len(counts[0].get((), {}))
            total += math.log10(p)
        out.append(total)
    return out


def random_texts(rng, n):
    return ["".join(rng.choice(["a", "b", "c", "The ", "ing", "é", "\n", " "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("entries", [1 << 21, 400, 0])
def test_trie_equals_brute_force(spark, entries):
    rng = random.Random(3)
    training, texts = random_texts(rng, 200), [*random_texts(rng, 30), "", "Zß"]
    trie = ppm.train(spark.createDataFrame([(t,) for t in training], "text string"), entries=entries).ready()
    assert len(trie.keys) <= entries
    # The least number of occurrences that the kept contexts imply.
    by_context = Counter()
    for t in training:
        x = symbols(t)
        for i in range(ppm.ORDER, len(x)):
            for k in range(3, ppm.ORDER + 1):
                by_context[k, tuple(x[i - k : i])] += 1
    kept = {(int(n) >> 48, tuple((int(n) >> 8 * (int(n >> 48) - 1 - j)) & 255 for j in range(int(n >> 48)))) for n in trie.node_keys}
    least = min((by_context[c] for c in kept), default=1 << 30)
    assert kept == {c for c, n in by_context.items() if n >= least}
    assert np.allclose(trie.score(pa.array(texts)), brute(training, texts, least), atol=1e-4)


@pytest.mark.parametrize("entries", [1 << 21, 400, 0])
def test_scores_count_every_context(spark, monkeypatch, entries):
    """Whatever fits the broadcast trie, a score is that of all contexts."""
    monkeypatch.setattr(ppm, "GROUP_WINDOWS", 200)
    rng = random.Random(4)
    training, texts = random_texts(rng, 150), [*random_texts(rng, 40), "", "Zß", "the the the the"]
    rows = [(i, t, False) for i, t in enumerate(training)] + [(1000 + i, t, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in ppm.score_texts(docs, held_out=docs.held, entries=entries).collect()}
    want = brute(training, [t for _, t, _ in rows], 0)
    assert len(got) == len(rows) and np.allclose([got[i] for i, _, _ in rows], want, atol=1e-4)


def test_each_context_is_a_distribution():
    counts = (np.array([0xFEFE61, 0x616162, 0x616163], np.int64), np.array([3, 2, 5]))
    trie = ppm.Trie(counts, {})
    assert np.allclose((10.0 ** trie.table.astype(float)).sum(1), 1, atol=1e-5)


def test_scores_of_odd_documents(spark, odd_docs, no_docs):
    got = ppm.score_texts(odd_docs, broadcast_words=4).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32((str(d) if d is not None else "").encode()) % 5 == 1
    words = lambda t: (t or "").encode().translate(ppm._TABLE).split()
    counts, n_texts = Counter(w for d, t in rows if not held(d) for w in words(t)), sum(not held(d) for d, _ in rows)
    total, distinct = sum(counts.values()) + n_texts, len(counts) + (n_texts > 0)
    norm = math.log10(total + 0.5 * (distinct + 1))
    want = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10(counts[x] + 0.5) for x in w) + math.log10(n_texts + 0.5) - (len(w) + 1) * norm
        want.append((d, held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(base, 4)))
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)
    assert ppm.score_texts(no_docs).collect() == []
