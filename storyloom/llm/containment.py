"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by their number of shingles into classes of doubling size. For a class of size s every
document is a run of windows of 2 s shingles that start every s shingles, so that a passage of an item lies
whole in one of them and their resemblance does not fade with the length of the document. Per hash function
the minimum of each block of the smallest class is taken once; windows of larger classes are minima of these
minima. A window that has an item's minimum under one of the functions makes that item a candidate. An item of few
shingles, which may miss all functions by chance, is a candidate also where one of its shingles stands of which a
document that contains the item must have one. All candidates are verified by exact containment of their word shingles in the whole document.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

SHINGLE_WORDS = 5
THRESHOLD = 0.8
FUNCTIONS = 48
#: Size of the smallest class, in shingles.
SMALLEST = 8
#: Bytes of benchmark text that one broadcast index may hold; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 16_000_000
#: Words are runs of ASCII letters and digits (lower-cased) and of all bytes of other characters.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def shingle_set(words: list[bytes], size: int = SHINGLE_WORDS) -> set[tuple[bytes, ...]]:
    """Distinct word shingles; fewer words than a shingle are one shingle, no words none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


_MIX = np.random.default_rng(5).integers(1 << 30, 1 << 32, 128, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 32-bit hash for each shingle place (repeats included); candidates are verified on the words themselves."""
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    n = max(len(h) - size + 1, min(len(h), 1))
    out = np.zeros(n, np.uint32)
    for i in range(min(size, len(h))):
        out ^= h[i : i + n]
        out *= _MIX[i]
        out ^= out >> np.uint32(15)
    return out


def _permuted(h: np.ndarray, j: int) -> np.ndarray:
    out = h ^ _MIX[j + 64]
    out *= _MIX[j]
    return out


class Index:
    """The items of one block: shingle sets, sizes, and per class and function the items by minimum."""

    def __init__(self, items: list[tuple], size: int, threshold: float, functions: int):
        self.size, self.threshold, self.functions = size, threshold, functions
        self.ids, self.sets = [], []
        self.classes: dict[int, list[dict[int, list[int]]]] = {}
        self.small: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text or "")
            shingles = shingle_set(words, size)
            if not shingles or item_id is None:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.sets.append(shingles)
            h = _hashes(words, size)
            if len(shingles) <= SMALLEST:
                # A document without any of these lacks too many of the item's shingles.
                spare = len(shingles) - math.ceil(threshold * len(shingles) - 1e-9) + 1
                for value in np.unique(h)[:spare].tolist():
                    self.small[value].append(k)
            width = SMALLEST
            while width < len(shingles):
                width *= 2
            tables = self.classes.setdefault(width, [defaultdict(list) for _ in range(functions)])
            for j in range(functions):
                tables[j][int(_permuted(h, j).min())].append(k)
        # The sorted minima, and a bit table of their low bits that answers most look-ups with no.
        self.sorted = {w: [np.array(sorted(t), np.uint32) for t in tables] for w, tables in self.classes.items()}
        self.bits = {w: [self._bit_table(s) for s in per] for w, per in self.sorted.items()}
        self.small_keys = np.array(sorted(self.small), np.uint32)
        self.small_bits = self._bit_table(self.small_keys)

    @staticmethod
    def _bit_table(values: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << 16, bool)
        table[values & np.uint32(0xFFFF)] = True
        return table

    @staticmethod
    def _add(found: list[set[int]], bits: np.ndarray, keys: np.ndarray, table: dict[int, list[int]], doc: np.ndarray, values: np.ndarray) -> None:
        """Add the items of all values that are keys of the table to the documents of these values."""
        maybe = np.nonzero(bits[values & np.uint32(0xFFFF)])[0]
        if not len(maybe):
            return
        asked = values[maybe]
        hit = maybe[keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked]
        for d, value in set(zip(doc[hit].tolist(), values[hit].tolist(), strict=True)):
            found[d].update(table[value])

    def candidates(self, hashes: list[np.ndarray]) -> list[set[int]]:
        """Items that share a minimum with a window, for each document."""
        found: list[set[int]] = [set() for _ in hashes]
        lens = np.array([len(h) for h in hashes], np.int64)
        if not lens.sum() or not self.classes:
            return found
        flat = np.concatenate(hashes)
        base = min(self.classes)
        starts, owner = _blocks(lens, base)
        for j in range(self.functions):
            mins, doc, width = np.minimum.reduceat(_permuted(flat, j), starts), owner, base
            for w in sorted(self.classes):
                if w > width:
                    counts = np.bincount(doc, minlength=len(hashes))
                    at, next_doc = _blocks(counts, w // width)
                    mins, doc, width = np.minimum.reduceat(mins, at), next_doc, w
                window = mins
                if len(mins) > 1:
                    window = np.append(np.where(doc[1:] == doc[:-1], np.minimum(mins[1:], mins[:-1]), mins[:-1]), mins[-1])
                self._add(found, self.bits[w][j], self.sorted[w][j], self.classes[w][j], doc, window)
        self._add(found, self.small_bits, self.small_keys, self.small, np.repeat(np.arange(len(lens)), lens), flat)
        return found


def _blocks(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``size`` places that do not cross documents, and the document of each."""
    counts = -(-lens // size)
    owner = np.repeat(np.arange(len(lens)), counts)
    first = np.cumsum(lens) - lens
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[owner] + within * size, owner


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, at least one. The driver holds one of them; broadcast ones lie on disk."""
    block, size = [], 0
    for row in items.select(item_id, text).toLocalIterator():
        n = len((row[1] or "").encode())
        if size + n > BLOCK_BYTES and block:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    functions: int = FUNCTIONS,
    extra: list[str] | None = None,
) -> DataFrame:
    """``doc_id``, ``items`` (ids of contained items, sorted), ``n_items``, ``containment`` (the largest) and ``contaminated``.

    An item is contained if at least ``threshold`` of its distinct word shingles stand in the document. One row
    for every row of ``docs``: null, empty and wordless texts contain nothing (containment 0), and items
    without words are in no document, as are items without an id. An item of fewer words than a shingle is one shingle and is found only
    in a document of the same words. Repeated rows give repeated results; equal items are listed each.
    ``extra`` columns of ``docs`` are passed on.
    """
    kind = T.ArrayType(benchmark.schema[item_id].dataType)
    keep = list(dict.fromkeys([doc_id, *(extra or [])]))
    found = docs.select(*keep, F.col(text).alias("__doc"), F.array().cast(kind).alias("items"), F.lit(0.0).alias("containment"))
    for block in _item_blocks(benchmark, item_id, item_text):
        # A benchmark of several blocks is several passes; each adds to what those before it have found.
        found = _search(found, keep, block, kind, threshold, functions)
    return found.select(*keep, "items", F.size("items").cast("long").alias("n_items"), "containment", (F.size("items") > 0).alias("contaminated"))


def _search(docs: DataFrame, keep: list[str], block: list[tuple], kind: T.ArrayType, threshold: float, functions: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def worker():
        index = Index(sent.value, SHINGLE_WORDS, threshold, functions)

        def run(texts, rows):
            words = [words_of(t) for t in texts.to_pylist()]
            found = index.candidates([_hashes(w, SHINGLE_WORDS) for w in words])
            items, best = rows.column("__items").to_pylist(), rows.column("__best").to_pylist()
            for d, ks in enumerate(found):
                have = shingle_set(words[d], SHINGLE_WORDS) if ks else set()
                for k in ks:
                    score = len(index.sets[k] & have) / len(index.sets[k])
                    if score >= threshold:
                        items[d].append(index.ids[k])
                        best[d] = max(best[d], score)
                items[d].sort()
            return [items, pa.array(best, pa.float64())]

        return run

    renamed = docs.withColumnsRenamed({"items": "__items", "containment": "__best"})
    carried = [*keep, "__doc", "__items", "__best"]
    out = map_texts(renamed, carried, "__doc", [("items", kind), ("containment", T.DoubleType())], worker)
    return out.drop("__items", "__best")
