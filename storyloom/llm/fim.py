"""Fill-in-middle transformation by displacement scatter.

A scan over the bytes of a batch finds the units (a run of ASCII letters or any other code point) and with them
the two cuts of each text. Prefix, middle and suffix each move by one distance; these distances enter a
difference array at the pieces' first bytes, its cumulative sum is the shift of every byte, and one scatter
writes all outputs of the batch. ``restore`` finds the marks in the outputs and gathers the bytes back the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, utf8

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: Percent of the texts that are rewritten, and of those the percent that put the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _places(starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Where each of ``size`` bytes goes: a piece that starts at ``starts[i]`` (ascending) moves by ``shifts[i]``."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    np.cumsum(change, out=change)
    return change[:size] + np.arange(size)


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marks that lie inside one text, and their rows."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [ord(m) for m in MARKS])]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[row + 1]
    return at[inside], row[inside]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _rewrite(texts: pa.Array, draws: np.ndarray, rewritten: int, suffix_first: int) -> list:
    """Units, form, output, and the code points of prefix and middle of every text."""
    data, offsets = utf8(texts)
    size, begin, end = len(data), offsets[:-1], offsets[1:]
    lead, letter = (data & 0xC0) != 0x80, _LETTER[data]
    goes_on = np.zeros(size, bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[begin[begin < size]] = False
    units = np.append(np.flatnonzero(lead & ~goes_on), size)
    first = np.searchsorted(units, begin)
    n = np.searchsorted(units, end) - first
    picks = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    # The unit after the last one of a text starts where the text ends.
    cut, stop = units[first + picks[:, 0]], units[first + picks[:, 1]]

    form = np.where(draws[:, 3] % 100 < suffix_first, SPM, PSM)
    form[(begin == end) | (draws[:, 2] % 100 >= rewritten)] = PLAIN
    form[_marks(data, offsets)[1]] = PLAIN
    new = form != PLAIN
    grown = np.concatenate([[0], np.cumsum(end - begin + 9 * new)])
    head, tail = cut - begin, end - stop
    out = grown[:-1]
    # Where the pieces go; in plain texts they stay side by side.
    prefix = out + np.select([form == PSM, form == SPM], [3, tail + 6], 0)
    suffix = out + np.select([form == PSM, form == SPM], [head + 6, 3], stop - begin)
    middle = out + np.where(new, head + tail + 9, head)
    starts = np.stack([begin, cut, stop], 1).ravel()
    moved = np.stack([prefix, middle, suffix], 1).ravel()
    made = np.empty(grown[-1], np.uint8)
    made[_places(starts, moved - starts, size)] = data
    for mark, piece in (("P", prefix), ("S", suffix), ("M", middle)):
        made[(piece[new] - 3)[:, None] + np.arange(3)] = np.frombuffer(MARKS[mark], np.uint8)

    leads = np.flatnonzero(lead)
    points = np.searchsorted(leads, np.stack([begin, cut, stop], 1))
    chars = [pa.array(points[:, i + 1] - points[:, i], pa.int64(), mask=~new) for i in (0, 1)]
    return [pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form].tolist(), pa.string()), _strings(made, grown), *chars]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1", rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``output``, ``prefix_chars`` and ``middle_chars`` of every row.

    The draws of a text come from the SHA-256 of ``seed:doc_id``, so equal ids cut alike at the same number of
    units and no run depends on the order of rows. A null text counts as an empty one, which is plain; a text that
    holds a mark is plain as well, so that every output can be restored. A null id draws like an empty one.
    Repeated rows give repeated results; other columns are not read; no rows give no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = F.transform(F.array(*[F.lit(8 * i + 1) for i in range(4)]), lambda at: F.conv(F.substr(F.col("__digest"), at, F.lit(8)), 16, 10).cast("bigint"))
    rows = docs.select(F.col(doc_id), F.col(text).alias("__source"), digest.alias("__digest")).withColumn("__draws", draws)

    def worker():
        def run(texts, part):
            drawn = part.column(1).flatten().to_numpy().reshape(-1, 4)
            return _rewrite(texts, drawn, rewritten, suffix_first)

        return run

    outputs = [("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    return map_texts(rows, [doc_id, "__draws"], "__source", outputs, worker).drop("__draws")


def _restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts; null where the marks of an output are not those of its form."""
    data, offsets = utf8(outputs)
    begin, end = offsets[:-1], offsets[1:]
    form = pc.fill_null(pc.index_in(forms, pa.array(FORMS)), -1).to_numpy(zero_copy_only=False)
    at, row = _marks(data, offsets)
    count = np.bincount(row, minlength=len(begin))
    three = count == 3
    place = np.repeat(begin[:, None], 3, 1)
    place[three] = at[three[row]].reshape(-1, 3)
    kinds = data[np.minimum(place + 1, max(len(data) - 1, 0))] if len(data) else np.zeros_like(place)
    right = [(kinds == [ord(m) for m in order]).all(1) & three & (place[:, 0] == begin) & (form == f) for f, order in ((PSM, "PSM"), (SPM, "SPM"))]
    new = right[0] | right[1]
    # Pieces in the order of the output: after each mark up to the next one.
    start, stop = place + 3, np.stack([place[:, 1], place[:, 2], end], 1)
    first, second = stop[:, 0] - start[:, 0], stop[:, 1] - start[:, 1]
    psm = right[0]
    source = np.stack([np.where(psm, start[:, 0], start[:, 1]), start[:, 2], np.where(psm, start[:, 1], start[:, 0])], 1)
    length = np.stack([np.where(psm, first, second), stop[:, 2] - start[:, 2], np.where(psm, second, first)], 1)
    plain = form == PLAIN
    source[~new], length[~new] = begin[~new, None], 0
    length[plain, 2] = (end - begin)[plain]
    target = np.concatenate([[0], np.cumsum(length.ravel())])
    size = int(target[-1])
    texts = data[_places(target[:-1], source.ravel() - target[:-1], size)]
    made = _strings(texts, target[::3])
    return pc.if_else(pa.array(new | plain), made, pa.scalar(None, pa.string()))


def restore(df: DataFrame, keep: list[str], output: str = "output", form: str = "form") -> DataFrame:
    """The ``keep`` columns and ``text``, the exact text that each row's ``output`` and ``form`` were made of.

    Null where the output does not hold the three marks of its form in their order, or the form is none of the
    three; a plain output is the text itself, a null one the empty text.
    """

    def worker():
        def run(outputs, part):
            return [_restore(outputs, part.column(len(keep)))]

        return run

    rows = df.select(*keep, F.col(form).alias("__form"), F.col(output).alias("__output"))
    return map_texts(rows, [*keep, "__form"], "__output", [("text", T.StringType())], worker).drop("__form")
