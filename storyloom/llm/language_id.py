"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and all but letters become spaces; n-grams of one to three characters are hashed into
``BUCKETS`` counters. Training counts are summed by Spark, the log-probability matrix (buckets x languages) is
broadcast, and a batch of texts is scored as one sparse count matrix: gathered rows, summed per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Training texts of each language, on average: those with the smallest hash of id and text. A documented bound of the fit.
TRAIN_TEXTS = 4_000
#: Languages that a model may have; more labels than that are an error, as the matrix is broadcast.
MAX_LANGUAGES = 256
SMOOTHING = 0.1
UNDETERMINED = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Characters of a text that are in arrays at once.
_BLOCK = 1 << 18


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _blocks(texts: list[str]):
    """Lower-cased texts in groups of about a block; a longer text comes in pieces that share its last two characters.

    Yields (row of each piece, pieces, whether a piece goes on from the one before).
    """
    rows, parts, more, size = [], [], [], 0
    for row, text in enumerate(texts):
        text = text.lower()
        for at in range(0, max(1, len(text)), _BLOCK):
            rows.append(row)
            more.append(at > 0)
            parts.append(text[max(0, at - 2) : at + _BLOCK])
            size += len(parts[-1])
            if size >= _BLOCK:
                yield np.array(rows), parts, np.array(more)
                rows, parts, more, size = [], [], [], 0
    if rows:
        yield np.array(rows), parts, np.array(more)


def _grams(parts: list[str], more: np.ndarray, letters: np.ndarray):
    """For each order: bucket of each place (BUCKETS where no n-gram starts), and the start of each part; letters by place."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    code = np.frombuffer("\n".join(parts + [""]).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lens) - lens
    letter = letters[code]
    code = np.where(letter, code, np.uint32(32)).astype(np.uint32)
    left = np.repeat(starts + lens - 1, lens) - np.arange(len(code))  # characters from this place to the end of the part
    shared = np.zeros(len(code), np.int8)  # 2, 1 at the two characters that a part shares with the one before
    for k in (0, 1):
        at = starts[more & (lens > k + 1)] + k
        shared[at] = 2 - k
    out = []
    h = np.zeros(len(code), np.uint32)
    blank = np.ones(len(code), bool)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.roll(code, 1 - n)
        h = (h ^ shifted) * _ODD[n - 1]
        h ^= h >> np.uint32(15)
        blank &= shifted == 32
        if n in ORDERS:
            bucket = (h * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64) % BUCKETS
            # An n-gram belongs to the part where it ends.
            bucket[(left < n) | blank | (shared >= n)] = BUCKETS
            out.append(bucket)
    return out, starts, letter


def _count(batches):
    """(language index, bucket, count) of a task's training texts."""
    totals: dict[str, np.ndarray] = {}
    letters = _letters()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs.tolist()):
            sums = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for _, parts, more in _blocks([texts[i] or "" for i in np.nonzero(langs == lang)[0]]):
                for bucket in _grams(parts, more, letters)[0]:
                    sums += np.bincount(bucket, minlength=BUCKETS + 1)
    for lang, sums in totals.items():
        at = np.nonzero(sums[:BUCKETS])[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_TEXTS):
    """(languages, matrix): log-probabilities by bucket, the last two rows being zero (no n-gram) and the log priors.

    Learns from rows with a text and a language: of each language about ``per_language``, those with the smallest
    hashes of id and text, or all if it has fewer. Without such rows there are no languages.
    """
    labelled = docs.select(F.col(doc_id).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return [], np.zeros((BUCKETS + 2, 0))
    # Hashes are even, so a share of their range is that share of the texts, found in a plain scan.
    limits = [(r.lang, min((1 << 63) - 1, int(per_language / r.n * (1 << 64)) - (1 << 63))) for r in sizes]
    limit = F.create_map(*[F.lit(x) for r in limits for x in r])
    sample = labelled.where(F.xxhash64("k", "text") <= limit[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    where = {x: i for i, x in enumerate(languages)}
    matrix = np.full((BUCKETS, len(languages)), SMOOTHING)
    columns = np.fromiter((where[x] for x in counts.column("lang").to_pylist()), np.int64, counts.num_rows)
    np.add.at(matrix, (counts.column("bucket").to_numpy(), columns), counts.column("n").to_numpy())
    matrix = np.log(matrix / matrix.sum(0))
    texts = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    prior = np.log(np.array([texts.get(x, 0) + 1.0 for x in languages]))
    return languages, np.vstack([matrix, np.zeros(len(languages)), prior - np.logaddexp.reduce(prior)])


def predict(docs: DataFrame, model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` (the posterior probability) of every row.

    A null text, one without a letter, or any text if there are no languages is ``und`` with score 0; of equal
    languages the first by name wins. The whole text is read in bounded blocks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        languages, matrix = sent.value
        letters = _letters()
        weights, prior = np.ascontiguousarray(matrix[: BUCKETS + 1]), matrix[BUCKETS + 1]

        def run(texts, _):
            texts = texts.to_pylist()
            sums, lettered = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), bool)
            for rows, parts, more in _blocks(texts):
                grams, starts, letter = _grams(parts, more, letters)
                np.logical_or.at(lettered, rows, np.logical_or.reduceat(letter, starts))
                if len(languages):
                    for bucket in grams:
                        np.add.at(sums, rows, np.add.reduceat(weights[bucket], starts, axis=0))
            if not len(languages):
                return [[UNDETERMINED] * len(texts), pa.array(np.zeros(len(texts)))]
            best = sums.argmax(1)
            score = np.exp(sums[np.arange(len(texts)), best] - np.logaddexp.reduce(sums, axis=1))
            named = [languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            return [named, pa.array(np.where(lettered, np.minimum(score, 1.0), 0.0))]

        return run

    return map_texts(docs, keep or ["doc_id"], text, [("lang_pred", T.StringType()), ("score", T.DoubleType())], worker)


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of a documents table whose language is determined with at least ``least_score``; the others go.

    If no row has a language label there is no model, and every text with a letter stays.
    """
    # The rows travel as one struct, so that their columns cannot clash with the results.
    rows = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__whole"))
    model = train(docs)
    if not model[0]:
        return rows.where(F.col("__whole").rlike(r"\p{L}")).select("__row.*")
    found = predict(rows, model, ["__row"], "__whole")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("__row.*")
