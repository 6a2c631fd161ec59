"""Language-model scoring by prediction by partial matching on bytes.

The model is a trie of byte contexts of up to five bytes, filled from all training texts: Spark sums the counts
of six-byte windows. A symbol's probability is taken at the longest context that has seen it; each step to a
shorter one costs an escape (method D: half the distinct symbols over the occurrences, and half an occurrence
less for each symbol), and symbols seen in the longer context are excluded there, in counts and escape.

A text's code length is a sum of look-ups by window: the exclusions below a context depend on that context alone
and are worked out once. The broadcast trie has a fixed size: contexts of up to two bytes are all in it (at most
256 ** 3 counts), longer ones from a number of occurrences on that leaves at most ``TRIE_ENTRIES`` counts of whole
contexts. A kept context's suffix occurs at least as often and is kept too, so a window whose five-byte context is
kept is answered from it alone. The other windows of a text (each once, with its number) meet all counts in a
join; those that share the last three bytes of context meet in one group, which fills a trie of its own.

Words are counted for the base score. Those that occur often travel in a broadcast of bounded size, the others
meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import crc_remainder, map_texts, text_slices, utf8

#: Stand before and after every text; neither byte occurs in UTF-8.
START, END = 0xFE, 0xFF
#: Most frequent words that are broadcast.
BROADCAST_WORDS = 200_000
#: Counts of contexts of three bytes and more in the broadcast trie; what is not in it is looked up in a join.
TRIE_ENTRIES = 1 << 21
#: Windows that meet in one group of that join on average at most.
GROUP_WINDOWS = 1 << 14
ORDER = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = _LOWER.tobytes()


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each as ORDER times START, its bytes, END; and the offsets of the texts."""
    raw, offsets = utf8(texts)
    lens = np.diff(offsets)
    at = offsets + (ORDER + 1) * np.arange(len(offsets))
    out = np.full(at[-1], START, np.uint8)
    place = np.arange(len(raw)) + np.repeat(at[:-1] + ORDER - offsets[:-1], lens)
    out[place] = _LOWER[raw]
    out[at[1:] - 1] = END
    return out, at


def _windows(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte window that ends at each real symbol, and the number of symbols of each text."""
    wide = x.astype(np.int64)
    n = len(x) - ORDER
    codes = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        codes = (codes << 8) | wide[i : i + n]
    real = np.ones(len(x), bool)
    for i in range(ORDER):
        real[at[:-1] + i] = False
    return codes[real[ORDER:]], np.diff(at) - ORDER


def _count_windows(batches):
    found = []

    def merged():
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)

    def sent(keys, sums):
        for at in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000]), pa.array(sums[at : at + 50_000])], names=["code", "n"])

    for batch in batches:
        texts = pc.fill_null(batch.column(0), "")
        for a, b in text_slices(texts):
            found.append(np.unique(_windows(*_symbols(texts.slice(a, b - a)))[0], return_counts=True))
            if sum(len(k) for k, _ in found) > 3_000_000:
                keys, sums = merged()
                found.clear()
                if len(keys) > 2_000_000:
                    yield from sent(keys, sums)
                else:
                    found.append((keys, sums))
    if found:
        yield from sent(*merged())


class _Table:
    """Open-addressed columns by long key; a missing key has position -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 // 3).bit_length())  # at most three quarters full
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.where = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # of the keys that want a free slot, one takes it; the others go one on
            free = self.slots[at] < 0
            self.where[at[free]] = left[free]
            self.slots[at[free]] = keys[left[free]]
            rest = self.where[at] != left
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.slots[self.where >= 0] = keys[self.where[self.where >= 0]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.slots[at]
        other = np.nonzero((seen != keys) & (seen >= 0))[0]
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            seen = self.slots[at[other]]
            other = other[(seen != keys[other]) & (seen >= 0)]
        return np.where(self.slots[at] == keys, self.where[at], -1)


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


class Trie:
    """``low``: (code, count) of three-byte windows; ``high``: by order from three on, the same of kept contexts."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], high: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.low = low
        codes, counts = low[0], low[1].astype(np.float64)
        one, zero = np.zeros((256, 256)), np.zeros(256)
        np.add.at(one, ((codes >> 8) & 255, codes & 255), counts)
        np.add.at(zero, codes & 255, counts)
        contexts, at = np.unique(codes >> 8, return_inverse=True)
        new = zero == 0
        last = new / max(1, new.sum())  # below the empty context: equal shares of the symbols that never occurred
        floor = _mixed(zero[None], np.zeros((1, 256), bool), last[None])
        bare = _mixed(one, np.zeros((256, 256), bool), _mixed(np.broadcast_to(zero, one.shape), one > 0, np.broadcast_to(last, one.shape)))
        rows, seen_rows, escapes = [bare, floor], [np.zeros((257, 256), bool)], [np.ones(257)]
        for k in range(0, len(contexts), 4096):
            two = np.zeros((len(contexts[k : k + 4096]), 256))
            mine = (at >= k) & (at < k + 4096)
            np.add.at(two, (at[mine] - k, codes[mine] & 255), counts[mine])
            seen, shorter = two > 0, one[contexts[k : k + 4096] & 255]
            tail = _mixed(np.broadcast_to(zero, two.shape), shorter > 0, np.broadcast_to(last, two.shape))
            rows.append(_mixed(two, np.zeros_like(seen), _mixed(shorter, seen, tail)))
            seen_rows.append(seen)
            escapes.append(0.5 * seen.sum(1) / two.sum(1))
        self.table, self.seen = _log(np.concatenate(rows)).astype(np.float32), np.concatenate(seen_rows)
        self.escape = _log(np.concatenate(escapes)).astype(np.float32)
        self.row = np.where(one.sum(1) > 0, np.arange(256), 256)[np.arange(1 << 16) & 255].astype(np.int32)
        self.row[contexts] = 257 + np.arange(len(contexts))
        self._longer(low, high)

    def _longer(self, low, high) -> None:
        """Entries: log probability at their own context. Nodes: escape; then, for the suffix without what the node has seen, escape and factor."""
        keys, tops, node_keys, own, norms, chains = [], [], [], [], [], []
        below, amount = low
        for k in range(3, ORDER + 1):
            codes, counts = high.get(k, (np.zeros(0, np.int64), np.zeros(0)))
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order].astype(np.float64)
            if not len(codes):
                break
            # Occurrences and distinct symbols of the contexts below, by sorted code.
            by_code = np.argsort(below)
            below, amount = below[by_code], amount[by_code].astype(np.float64)
            first = np.nonzero(np.append(True, np.diff(below >> 8) > 0))[0]
            names, n_below, d_below = (below >> 8)[first], np.add.reduceat(amount, first), np.diff(np.append(first, len(below)))
            start = np.nonzero(np.append(True, np.diff(codes >> 8) > 0))[0]
            nodes, n, d = (codes >> 8)[start], np.add.reduceat(counts, start), np.diff(np.append(start, len(codes)))
            suffix = np.searchsorted(names, nodes & ((1 << 8 * (k - 1)) - 1))
            taken = np.add.reduceat(amount[np.searchsorted(below, codes & ((1 << 8 * k) - 1))], start)
            left, kinds = n_below[suffix] - taken, d_below[suffix] - d
            some = left > 0
            keys.append(codes | (k << 48))
            tops.append(_log((counts - 0.5) / np.repeat(n, d)))
            node_keys.append(nodes | (k << 48))
            own.append(_log(0.5 * d / n))
            norms.append(np.where(some, _log(n_below[suffix]) - _log(np.where(some, left, 1)), 0))
            chains.append(np.where(some, _log(0.5 * np.maximum(kinds, 1) / np.where(some, left, 1)), 0))
            below, amount = codes, counts
        flat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
        self.keys, self.node_keys = flat(keys, np.int64), flat(node_keys, np.int64)
        # The last place of each column is for what is missing.
        self.top, self.own, self.norm, self.chain = (np.append(flat(x, np.float32), np.float32(0)) for x in (tops, own, norms, chains))

    @classmethod
    def of(cls, columns: dict) -> Trie:
        """From the columns of another, as a broadcast carries them."""
        trie = cls.__new__(cls)
        trie.__dict__.update(columns)
        return trie

    def ready(self) -> Trie:
        """With its look-up tables, which are built where they are used."""
        self.entry, self.node = _Table(self.keys), _Table(self.node_keys)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each whole text and its end."""
        out = np.zeros(len(texts))
        for a, b in text_slices(texts, 1_000_000):
            codes, lens = _windows(*_symbols(texts.slice(a, b - a)))
            out[a:b] = np.add.reduceat(self._values(codes), np.cumsum(lens) - lens)
        return out

    def score_kept(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """As ``score`` of the windows whose whole context is kept; and for each text the others with their numbers."""
        out, stops, found, times = np.zeros(len(texts)), [np.zeros(1, np.int64)], [], []
        for a, b in text_slices(texts, 1_000_000):
            codes, lens = _windows(*_symbols(texts.slice(a, b - a)))
            kept = self.node.find((codes >> 8) | (ORDER << 48)) >= 0
            value = np.zeros(len(codes))
            value[kept] = self._values(codes[kept])
            out[a:b] = np.add.reduceat(value, np.cumsum(lens) - lens)
            other, of = codes[~kept], np.repeat(np.arange(b - a), lens)[~kept]
            order = np.lexsort((other, of))
            other, of = other[order], of[order]
            first = np.nonzero(np.append(True, (np.diff(other) != 0) | (np.diff(of) != 0))[: len(other)])[0]
            found.append(other[first])
            times.append(np.diff(np.append(first, len(other))))
            stops.append(stops[-1][-1] + np.cumsum(np.bincount(of[first], minlength=b - a)))
        flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64())
        pairs = pa.StructArray.from_arrays([flat(found), flat(times)], names=["code", "times"])
        return out, pa.ListArray.from_arrays(pa.array(np.concatenate(stops), pa.int32()), pairs)

    def _values(self, codes: np.ndarray) -> np.ndarray:
        value = np.zeros(len(codes))
        open_, norm, chain = np.arange(len(codes)), np.zeros(len(codes), np.float32), np.zeros(len(codes), np.float32)
        started = np.zeros(len(codes), bool)
        for k in range(ORDER, 2, -1) if len(self.keys) else ():
            code = codes[open_] & ((1 << 8 * (k + 1)) - 1)
            at = self.entry.find(code | (k << 48))
            hit = at >= 0
            value[open_[hit]] += self.top[at[hit]] + norm[hit]
            miss = ~hit
            open_, started = open_[miss], started[miss]
            node = self.node.find((code[miss] >> 8) | (k << 48))
            value[open_] += np.where(started, chain[miss], self.own[node])
            norm, chain, started = self.norm[node], self.chain[node], node >= 0
        code = codes[open_]
        row, symbol = self.row[(code >> 8) & 0xFFFF], code & 255
        flat = self.table[row, symbol]
        value[open_] += flat + np.where(started, np.where(self.seen[row, symbol], norm, chain - self.escape[row]), 0)
        return value


def _mixed(counts: np.ndarray, excluded: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of one order: own symbols that are not excluded, and the escape times ``shorter``."""
    own = np.where(excluded, 0, counts)
    n, d = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
    escape = np.where(n > 0, 0.5 * d / np.maximum(n, 1), 1.0)
    return np.where(own > 0, (own - 0.5) / np.maximum(n, 1), escape * shorter)


def train(texts: DataFrame, text: str = "text", entries: int = TRIE_ENTRIES) -> Trie:
    """The trie of all rows of ``texts`` with the most frequent contexts; without rows every symbol has the same probability."""
    return _train(texts, text, entries)[0]


def _train(texts: DataFrame, text: str, entries: int) -> tuple[Trie, DataFrame, bool]:
    """The trie, all windows (``code``, ``n``), and whether the trie has every context of them."""
    counts = texts.select(text).mapInArrow(_count_windows, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "windows")
    low = counts.groupBy(F.expr("code & 16777215L").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    orders = range(3, ORDER + 1)
    windows = {k: counts if k == ORDER else counts.groupBy(F.expr(f"code & {(1 << 8 * (k + 1)) - 1}L").alias("code")).agg(F.sum("n").alias("n")) for k in orders}
    contexts = None
    for k, w in windows.items():
        mine = w.groupBy(F.expr("shiftright(code, 8)").alias("context")).agg(F.sum("n").alias("times"), F.count("*").alias("entries"))
        mine = mine.select(F.lit(k).alias("k"), "context", F.expr("cast(floor(log2(times)) as int)").alias("size"), "entries")
        contexts = mine if contexts is None else contexts.unionByName(mine)
    contexts = materialize(contexts, "contexts")
    sizes = {r.size: r.n for r in contexts.groupBy("size").agg(F.sum("entries").alias("n")).collect()}
    least = _least_size(sizes, entries)
    high = {}
    for k, w in windows.items():
        kept = contexts.where((F.col("k") == k) & (F.col("size") >= least)).select("context")
        found = w.withColumn("context", F.expr("shiftright(code, 8)")).join(kept, "context", "left_semi").select("code", "n").toArrow()
        high[k] = (found.column("code").to_numpy(), found.column("n").to_numpy())
    return Trie((low.column("code").to_numpy(), low.column("n").to_numpy()), high), counts, least == 0


def _values_of_group(sent):
    """``code``, ``value`` of the windows ``asked`` by a trie of the ``counts`` that share their three last bytes of context."""

    def run(counts: pa.Table, asked: pa.Table) -> pa.Table:
        codes = asked.column("code").to_numpy()
        if not len(codes):
            return pa.table({"code": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        windows, n = counts.column("code").to_numpy(), counts.column("n").to_numpy()
        high = {}
        for k in range(3, ORDER + 1):
            names, back = np.unique(windows & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            high[k] = names, np.bincount(back, n, len(names))
        trie = Trie.of(sent.value[0])
        trie._longer(trie.low, high)
        return pa.table({"code": pa.array(codes), "value": pa.array(trie.ready()._values(codes), pa.float64())})

    return run


def _values_in_join(asked: DataFrame, counts: DataFrame, sent) -> DataFrame:
    """``code`` and ``value`` of every code of ``asked``, by all ``counts``."""
    asked = materialize(asked.select("code").distinct(), "asked")
    groups = 1 + (asked.count() + counts.count()) // GROUP_WINDOWS
    group = F.pmod(F.xxhash64(F.expr("shiftright(code, 8) & 16777215L")), F.lit(groups)).alias("group")
    left, right = counts.select("code", "n", group).groupBy("group"), asked.select("code", group).groupBy("group")
    return left.cogroup(right).applyInArrow(_values_of_group(sent), "code bigint, value double")


def _least_size(sizes: dict[int, int], most: int) -> int:
    """The least k such that what has size k or more numbers at most ``most``."""
    k, total = max(sizes, default=0) + 1, 0
    while k > 0 and total + sizes.get(k - 1, 0) <= most:
        k -= 1
        total += sizes.get(k, 0)
    return k


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _count_words(batches):
    counter: Counter = Counter()

    def flush():
        keys = [k.decode("utf-8", "replace") for k in counter]
        for at in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000], pa.string()), pa.array(list(counter.values())[at : at + 50_000], pa.int64())], names=["word", "c"])
        counter.clear()

    for batch in batches:
        for a, b in text_slices(batch.column(0)):
            for t in batch.column(0).slice(a, b - a).to_pylist():
                counter.update(words_of(t or ""))
            if len(counter) > 300_000:
                yield from flush()
    yield from flush()


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(text).mapInArrow(_count_words, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out=None, broadcast_words: int = BROADCAST_WORDS, entries: int = TRIE_ENTRIES) -> DataFrame:
    """Scores of every row, learnt from the rows that are not ``held_out`` (a boolean column expression).

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed word
    frequencies) and ``score`` (by all contexts, ``entries`` counts of which are broadcast). A null text counts as empty: it is one end. With no training row all
    counts are zero. Repeated rows count as often as they come and are returned as often.
    """
    held_out = crc_remainder(doc_id, 5) == 1 if held_out is None else held_out
    docs = docs.select(F.col(doc_id), F.col(text).alias("__t"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    trie, windows, complete = _train(training, "__t", entries)
    counts = materialize(word_counts(training, "__t"), "words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_texts = training.count()
    tokens, distinct = totals.n + n_texts, totals.v + (n_texts > 0)
    frequent = _frequent(counts, broadcast_words)
    sent = docs.sparkSession.sparkContext.broadcast((vars(trie), {w.encode(): math.log10(c + 0.5) for w, c in frequent}, math.log10(n_texts + 0.5)))

    windows_type = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))

    def worker():
        columns, known, end = sent.value
        trie = Trie.of(columns).ready()

        def run(texts, _):
            sums, n_tokens, n_known, words, times, stops = [], [], [], [], [], [0]
            for t in texts.to_pylist():
                found = words_of(t)
                total, in_table = end, 0
                for w, tf in Counter(found).items():
                    value = known.get(w)
                    if value is None:
                        words.append(w)
                        times.append(tf)
                    else:
                        total += tf * value
                        in_table += tf
                sums.append(total)
                n_tokens.append(len(found) + 1)
                n_known.append(in_table)
                stops.append(len(words))
            rare = pa.StructArray.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(times, pa.int64())], names=["word", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rare)
            # A complete trie knows of every context it lacks that it never occurred.
            score, others = (trie.score(texts), pa.nulls(len(texts), windows_type)) if complete else trie.score_kept(texts)
            return [pa.array(score), others, pa.array(sums, pa.float64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), lists]

        return run

    pair = T.StructType([T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())])
    window = T.StructType([T.StructField("code", T.LongType()), T.StructField("times", T.LongType())])
    outputs = [("score", T.DoubleType()), ("others", T.ArrayType(window)), ("sum", T.DoubleType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("rare", T.ArrayType(pair))]
    scored = map_texts(docs, [doc_id, "held_out"], "__t", outputs, worker)
    scored = materialize(scored.withColumn("__row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("__row", F.inline("rare")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = rest.groupBy("__row").agg(F.sum(F.expr("tf * log10(c + 0.5D)")).alias("more"), F.sum(F.expr("if(c > 0, tf, 0L)")).alias("more_known"))
    out = scored.drop("rare", "others").join(rest, "__row", "left")
    if not complete:
        others = scored.select("__row", F.inline("others"))
        values = _values_in_join(others, windows, sent)
        others = others.join(values, "code").groupBy("__row").agg(F.sum(F.expr("times * value")).alias("more_score"))
        out = out.join(others, "__row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    norm = math.log10(tokens + 0.5 * (distinct + 1))
    n_known = F.col("known") + F.lit(int(n_texts > 0)) + F.coalesce("more_known", F.lit(0))
    base = F.col("sum") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return out.select(doc_id, "held_out", "n_tokens", n_known.alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words of at least 2 ** k occurrences, with the least k that leaves at most ``most`` of them."""
    size = F.expr("cast(floor(log2(c)) as int)")
    sizes = {r.k: r.n for r in counts.groupBy(size.alias("k")).agg(F.count("*").alias("n")).collect()}
    return [(r.word, r.c) for r in counts.where(size >= _least_size(sizes, most)).collect()] if sizes else []
