"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut before every run of spaces (no piece has a space mark after another character, which
``load`` checks), so equal words are encoded once for a slice of documents. All distinct words of a slice
lie in one flat symbol array. A round finds the minimum pair rank of each word (a segmented minimum),
merges its leftmost non-overlapping occurrences in all words at once, and compacts the array; words
without a pair leave it. Merges of one word after the first that makes a pair of no higher rank wait for
the next round, so the order is the library's own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

MARK = "▁"
NONE = np.int64(1) << 40
#: Distinct words of which a worker keeps the identifiers; past it the store starts anew.
CACHED_WORDS = 300_000
_WORD = re.compile(f"{MARK}{{16}}(?={MARK})|{MARK}{{1,16}}[^{MARK}\n]*|\n[^{MARK}\n]*")


class Pieces:
    """A SentencePiece BPE vocabulary: symbols, pair ranks, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)])
        self.special = special
        plain = {names[i]: i for i in range(n) if not special[i]}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("a piece has a space mark or a line end inside: texts cannot be cut at words")
        runs = {len(p) for p in plain if set(p) == {MARK}}
        if max(runs, default=1) != 16 or sp.encode(MARK * 15 + MARK * 16 + "a")[0] != plain[MARK * 16]:
            raise ValueError("runs of spaces cannot be cut by sixteens")
        if "  ".join(sp.encode("a  b", out_type=str)) != f"{MARK}a  {MARK}  {MARK}b" or sp.encode("") != []:
            raise ValueError("only models with identity normalisation, a space before the text and escaped spaces are supported")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # Characters that occur in pieces are symbols even where they are no piece themselves.
        letters = sorted({c for p in plain for c in p} - plain.keys())
        self.extra = letters
        symbol = plain | {c: n + k for k, c in enumerate(letters)}
        self.of_char = np.full(0x110000, -1, np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        scores = {p: sp.get_score(i) for p, i in plain.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.stride = n + len(letters) + 1
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * self.stride + symbol[p[k:]]] = (rank[scores[p]], i)
        self.pairs = pairs
        self._hash_pairs()
        plain_bytes = [b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            plain_bytes[i] = bytes([b])
        plain_bytes[self.unknown] = " ⁇ ".encode()
        self.lengths = np.array([len(b) for b in plain_bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(plain_bytes), np.uint8)
        self.leads = np.array([b[:1] == b" " for b in plain_bytes]) & ~special

    def _hash_pairs(self) -> None:
        """An open table of pairs, so that a lookup of many pairs is a few gathers."""
        self.bits = max(4, int(np.ceil(np.log2(len(self.pairs) * 6 + 1))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int64)
        self.slot_to = np.full(1 << self.bits, -1, np.int64)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        for key, at in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            while self.slot_key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slot_key[at], (self.slot_rank[at], self.slot_to[at]) = key, self.pairs[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE where it is no piece. A negative symbol has no pair."""
        key = np.where((left >= 0) & (right >= 0), left * self.stride + right, 0)
        at = self._slot(key)
        seen = self.slot_key[at]
        missed = np.nonzero((seen != key) & (seen >= 0))[0]
        while len(missed):
            at[missed] = (at[missed] + 1) & ((1 << self.bits) - 1)
            seen = self.slot_key[at[missed]]
            missed = missed[(seen != key[missed]) & (seen >= 0)]
        return self.slot_rank[at], self.slot_to[at]

    # -- encoding -----------------------------------------------------------------------------------------

    @staticmethod
    def cut(text: str) -> list[str]:
        """The words that can be encoded on their own; ``spelled`` gives the characters of one.

        A word after one space (one stands before the text) is written without it, so that most texts are
        split by two plain string calls; one after a line end starts with it.
        """
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            found = _WORD.findall(MARK + text.replace(" ", MARK))
            return [w[1:] if w[0] == MARK and w[1:2] != MARK else w for w in found]
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def spelled(word: str) -> str:
        return word if word[:1] in (MARK, "\n") and word else MARK + word

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all words (as ``cut`` writes them), one after the other, and the n + 1 offsets."""
        words = [self.spelled(w) for w in words]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        sym = self.of_char[codes]
        sym = np.where(sym < 0, -codes.astype(np.int64) - 2, sym)
        done_sym, done_word = [], []
        while len(sym):
            rank, to = self.look_up(sym[:-1], sym[1:])
            rank[word[:-1] != word[1:]] = NONE
            rank = np.append(rank, NONE)
            first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = low == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, rank, low, to = sym[live], word[live], rank[live], low[live], np.append(to, -1)[live]
                if not len(sym):
                    break
            at = self._leftmost(np.nonzero(rank == low)[0])
            made = to[at]
            at, made = self._until_new(sym, word, at, made, low)
            sym[at] = made
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = self._fall_back(sym[order], word[order])
        return sym, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Every other place of each run of overlapping occurrences, from its left end."""
        new = np.append(True, np.diff(at) > 1)
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - start) % 2 == 0]

    def _until_new(self, sym, word, at, made, low):
        """Of each word's merges, those up to the first that makes a pair whose turn comes before the others."""
        n = len(sym)
        before = np.maximum(at - 1, 0)
        left = np.where((at > 0) & (word[before] == word[at]), sym[before], -1)
        follows = np.append(False, (at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]]))
        left[1:] = np.where(follows[1:], made[:-1], left[1:])
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (word[after] == word[at]), sym[after], -1)
        limit = low[at]
        early = (self.look_up(left, made)[0] <= limit) | (self.look_up(made, right)[0] <= limit)
        if not early.any():
            return at, made
        count = np.cumsum(early) - early
        first = np.append(True, word[at[1:]] != word[at[:-1]])
        base = np.maximum.accumulate(np.where(first, count, 0))
        keep = count == base
        return at[keep], made[keep]

    def _fall_back(self, sym, word):
        """Characters outside the vocabulary become the identifiers of their bytes."""
        odd = np.nonzero((sym < 0) | (sym >= self.size))[0]
        if not len(odd):
            return sym, word
        chars = [chr(-s - 2) if s < 0 else self.extra[s - self.size] for s in sym[odd].tolist()]
        raw = [self.byte_ids[list(c.encode("utf-8", "surrogatepass"))] for c in chars]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(r) for r in raw]
        at = np.cumsum(times) - times
        out, words = np.repeat(sym, times), np.repeat(word, times)
        out[np.concatenate([np.arange(len(r)) + at[i] for i, r in zip(odd.tolist(), raw, strict=True)])] = np.concatenate(raw)
        return out, words

    # -- decoding -----------------------------------------------------------------------------------------

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each sequence: marks are spaces, the one before the text goes, begin and end ids are nothing."""
        lens = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        source = np.repeat(self.starts[ids] - ends[:-1], lens) + np.arange(ends[-1])
        raw = self.flat[source].tobytes()
        out = []
        real = ~self.special[ids] | np.isin(ids, self.byte_ids) | (ids == self.unknown)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            shown = np.nonzero(real[a:b])[0] + a
            if not len(shown):
                out.append(b"")
                continue
            first, last = int(shown[0]), int(shown[-1])
            start = int(ends[first]) + int(self.leads[ids[first]])
            if last - first + 1 == len(shown):
                out.append(_valid(raw[start : int(ends[last + 1])]))
            else:  # ids of nothing in between part the bytes beside them
                cuts = [start, *ends[np.nonzero(~real[first:last])[0] + first].tolist(), int(ends[last + 1])]
                out.append(b"".join(_valid(raw[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)))
        return out


def _valid(raw: bytes) -> bytes:
    """Each byte that is no part of a character becomes U+FFFD, as in the library."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as bad:
                out += [raw[at : at + bad.start].decode(), "�"]
                at += bad.start + 1
        return "".join(out).encode()


def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts with a store of the words met before; the store has a fixed size."""

    def __init__(self, path: str):
        self.pieces = load(path)
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts, begin and end ids included, and the n + 1 offsets."""
        cut = [self.pieces.cut(t) for t in texts]
        words = [w for c in cut for w in c]
        if len(self.at) > CACHED_WORDS:
            self._empty()
        fresh = list(dict.fromkeys(w for w in words if w not in self.at))
        if fresh:
            ids, offsets = self.pieces.encode_words(fresh)
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        code = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        del cut, words
        # A begin id before and an end id after each text: two single-id words of their own.
        lens = self.offsets[code + 1] - self.offsets[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        body = self.ids[np.repeat(self.offsets[code] - ends[:-1], lens) + np.arange(ends[-1])]
        stops = np.concatenate([[0], np.cumsum(counts)])
        text_ends = ends[stops]
        offsets = text_ends + 2 * np.arange(len(texts) + 1)
        out = np.empty(offsets[-1], np.int64)
        inner = np.ones(len(out), bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        out[inner] = body
        out[offsets[:-1]], out[offsets[1:] - 1] = self.pieces.begin, self.pieces.end
        return out, offsets


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int, begin and end ids included) and ``decoded`` for every row.

    A null text counts as empty: its ids are begin and end, and it decodes to the empty text. Repeated rows
    give repeated results; columns other than the two named ones are not read.
    """

    def worker():
        encoder = Encoder(model)

        def run(texts, _):
            ids, offsets = encoder.encode(texts.to_pylist())
            decoded = encoder.pieces.decode_batch(ids, offsets)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), [d.decode() for d in decoded]]

        return run

    return map_texts(docs, [doc_id], text, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], worker)


def round_trip_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row, as ``encode_texts`` gives them.

    The digests are taken in the task that encodes, so identifiers and texts do not leave it.
    """

    def worker():
        encoder = Encoder(model)

        def run(texts, _):
            ids, offsets = encoder.encode(texts.to_pylist())
            decoded = encoder.pieces.decode_batch(ids, offsets)
            raw = memoryview(ids.astype("<u4").tobytes())
            cuts = (4 * offsets).tolist()
            of_ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return [pa.array(np.diff(offsets), pa.int64()), of_ids, [hashlib.sha256(d).hexdigest() for d in decoded]]

        return run

    outputs = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(docs, [doc_id], text, outputs, worker)


def decode_ids(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of every row of identifiers; null or empty identifiers give the empty text, a null or out-of-range identifier nothing."""
    fields = T.StructType([rows.schema[doc_id], T.StructField("text", T.StringType())])

    def run(batches):
        pieces = load(model)
        for batch in batches:
            lists = [[i for i in x or () if i is not None and 0 <= i < pieces.size] for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = [d.decode() for d in pieces.decode_batch(flat, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=fields.names)

    return rows.select(doc_id, F.col(ids)).mapInArrow(run, fields)
