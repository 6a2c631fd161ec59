"""Encoding, decoding and counting against the library."""

import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from storyloom.llm import pieces, token_counts
from storyloom.llm.queries import model_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def expected(library, text):
    return [library.bos_id(), *library.encode(text or ""), library.eos_id()]


def random_texts(n):
    rng = random.Random(7)
    parts = ["a", "b", "e", "th", "the", "ing", " ", "  ", "\n", "▁", "é", "①", "😀", "aaaa", " " * 15, " " * 16, " " * 33, "\x00", ".", "==", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_merge_rounds_equal_the_library(library):
    encoder = pieces.Encoder(model_path())
    texts = [*random_texts(1500), "", " ", "a \nb", "\n\nab", "a" * 3000, "ab" * 2000, " " * 200 + "x", "the quick brown" * 50]
    ids, offsets = encoder.encode(texts)
    decoded = encoder.pieces.decode_batch(ids, offsets)
    for i, text in enumerate(texts):
        want = expected(library, text)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want
        assert decoded[i].decode() == library.decode(want)


def test_heap_counts_equal_the_library(library):
    model = pieces.load(model_path())
    chars = {chr(i): int(s) for i, s in enumerate(model.of_char.tolist()) if s >= 0}
    for text in random_texts(800):
        got = sum(token_counts.count_word(model.spelled(w), chars, model.pairs, model.stride, model.size) for w in model.cut(text))
        assert got == len(library.encode(text)), text


def test_decoding_any_identifiers(library):
    rng = random.Random(3)
    model = pieces.load(model_path())
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2, 0, 28705]) for _ in range(rng.randint(0, 12))]
        import numpy as np

        assert model.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == library.decode(ids), ids


def test_spark_operators(spark, library, odd_docs, no_docs):
    texts = odd_docs.select("doc_id", "text").collect()
    digests = sorted(map(tuple, pieces.round_trip_digests(odd_docs, model_path()).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text in texts:
        ids = expected(library, text)
        want.append((doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode(ids).encode())))
    assert digests == sorted(want, key=str)
    counts = sorted(map(tuple, token_counts.count_tokens(odd_docs, model_path(), limit=20).collect()), key=str)
    sizes = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in texts]
    assert counts == sorted(((d, b, n, n > 20) for d, b, n in sizes), key=str)
    encoded = pieces.encode_texts(odd_docs, model_path())
    back = pieces.decode_ids(encoded, model_path())
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, encoded.select("doc_id", "decoded").collect()), key=str)
    for empty in (pieces.round_trip_digests(no_docs, model_path()), token_counts.count_tokens(no_docs, model_path()), pieces.encode_texts(no_docs, model_path())):
        assert empty.collect() == []
