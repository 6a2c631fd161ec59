"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

The symbols of a word form a linked list, its pairs a heap by (rank, place). The lowest pair is popped and
merged until none is left; the count is the initial symbols minus the merges, where a character outside the
vocabulary counts as many as it has bytes. Words are cut as in ``pieces`` and a worker remembers counts.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts
from .pieces import load

CACHED_WORDS = 400_000


def count_word(word: str, chars: dict[str, int], pairs: dict[int, tuple[int, int]], stride: int, size: int) -> int:
    """Tokens of one word. ``chars``: symbol by character; ``pairs``: (rank, merged symbol) by left * stride + right."""
    sym = [chars.get(c, -1) for c in word]
    n = len(sym)
    heap = []
    for i in range(n - 1):
        left, right = sym[i], sym[i + 1]
        if left >= 0 and right >= 0 and (found := pairs.get(left * stride + right)):
            heap.append((found[0], i, left, right, i + 1, found[1]))
    merges = 0
    if heap:
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, left, right, j, to = heappop(heap)
            if sym[i] != left or sym[j] != right or after[i] != j:
                continue
            sym[i], sym[j] = to, -2
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if sym[k] >= 0 and (found := pairs.get(to * stride + sym[k])):
                    heappush(heap, (found[0], i, to, sym[k], k, found[1]))
            h = before[i]
            if h >= 0 and sym[h] >= 0 and (found := pairs.get(sym[h] * stride + to)):
                heappush(heap, (found[0], h, sym[h], to, i, found[1]))
    rest = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, s in zip(word, sym, strict=True) if s == -1 or s >= size)
    return n - merges + rest


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``) for every row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results; other columns are not read.
    """

    def worker():
        pieces = load(model)
        chars = {chr(i): int(pieces.of_char[i]) for i in np.nonzero(pieces.of_char >= 0)[0].tolist()}
        known: dict[str, int] = {}

        def run(texts, _):
            if len(known) > CACHED_WORDS:
                known.clear()
            totals = []
            for t in texts.to_pylist():
                total = 0
                for w in pieces.cut(t):
                    if (n := known.get(w)) is None:
                        n = known[w] = count_word(pieces.spelled(w), chars, pieces.pairs, pieces.stride, pieces.size)
                    total += n
                totals.append(total)
            tokens = np.array(totals, np.int64)
            sizes = pc.binary_length(texts).cast(pa.int64())
            return [sizes, pa.array(tokens), pa.array(tokens > limit)]

        return run

    outputs = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_texts(docs, [doc_id], text, outputs, worker)
