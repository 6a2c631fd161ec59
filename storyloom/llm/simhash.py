"""SimHash near-duplicates: fingerprints meet through a grid over their segment bit counts.

The 64 bits are 32 segments of two bits. A segment's bit count (0, 1 or 2) is written in unary, so that the
Manhattan distance of two count vectors is one ``bit_count`` of two longs. It is never above the Hamming
distance, as each differing bit changes one count by at most one. If it is at most three over both halves of
the vector, it is at most one in one of them: each half is a grid of 16 dimensions where a fingerprint meets
those of its own cell and of the cells one step up in one dimension (the partner takes the step down). The
pairs are verified first on the whole embedding, then exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import map_texts
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint: majority of the bits of XXH64 (seed 42) over word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles), np.uint64, max(1, len(words) - size + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``keep`` columns (``doc_id``) and ``bits`` (the fingerprint as a signed long) of every row; null and wordless texts have 0."""

    def worker():
        def run(texts, _):
            return [pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())]

        return run

    return map_texts(docs, keep or ["doc_id"], text, [("bits", T.LongType())], worker)


def _embedding(bits):
    """Segment bit counts in unary: the low bit of a segment is set from one on, the high bit at two."""
    low, other = F.lit(0x5555555555555555), F.shiftrightunsigned(bits, 1)
    return bits.bitwiseOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(bits.bitwiseAND(other).bitwiseAND(low), 1))


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs of the different ``bits`` that differ in at most ``max_bits`` (three at most), as ``a`` and ``b``.

    A pair can come twice, once for each half.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the two grids with one step hold links of at most three bits")
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    cell = F.expr("cast(if(half = 0, counts, shiftrightunsigned(counts, 32)) & 4294967295L as bigint)")
    points = distinct.select("bits", _embedding(F.col("bits")).alias("counts")).withColumn("half", half).withColumn("cell", cell)
    # One step up in dimension s: the low bit of its two if that is free, else the high one, else no such cell.
    steps = F.expr(
        """concat(array(cell), filter(transform(sequence(0, 15), s -> case
             when (cell & shiftleft(1L, 2 * s)) = 0 then cell | shiftleft(1L, 2 * s)
             when (cell & shiftleft(1L, 2 * s + 1)) = 0 then cell | shiftleft(1L, 2 * s + 1) end), c -> c is not null))"""
    )
    probes = points.select(F.col("half").alias("half2"), F.col("bits").alias("bits2"), F.col("counts").alias("counts2"), F.col("cell").alias("own"), F.explode(steps).alias("cell2"))
    near = F.expr(
        f"""half = half2 and cell = cell2 and (own <> cell2 or bits2 < bits)
            and bit_count(counts ^ counts2) <= {max_bits} and bit_count(bits ^ bits2) <= {max_bits}"""
    )
    return points.join(probes, near).select(F.col("bits").alias("a"), F.col("bits2").alias("b"))


def _components(prints: DataFrame) -> DataFrame:
    """``bits`` and ``component`` (a number of its group) of the fingerprints of rows ``(__id, bits)`` with an id."""
    points = materialize(prints.where("__id is not null").select("bits").distinct(), "points")
    roots = connected_components(linked_fingerprints(points))
    return points.join(roots, points.bits == roots.node, "left").select("bits", F.coalesce("root", "bits").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable) of every row.

    Equal fingerprints are one point; only different ones are paired. Null and wordless texts share the
    fingerprint zero and link like any other. Repeated rows are returned as often as they come. Groups are groups of
    fingerprints: an id with several texts is in the group of each and links none of them. A row with a null id has a
    fingerprint but takes part in no link, and its component is null. No rows give no rows.
    """
    prints = fingerprints(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__whole")), ["__id"], "__whole")
    prints = materialize(prints, "fingerprints")
    groups = materialize(_components(prints), "groups")
    least = prints.where("__id is not null").groupBy("bits").agg(F.min("__id").alias("least")).join(groups, "bits")
    least = least.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = prints.join(groups.join(least, "component").select("bits", "component_id"), "bits", "left")
    component = F.when(F.col("__id").isNotNull(), F.col("component_id"))
    return joined.select(F.col("__id").alias(doc_id), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each group of near duplicates the row with the smallest id.

    If that id has several texts in the group, the one with the smallest fingerprint (as a signed number), then text
    hash, stays; of rows with that id and text one stays. So each group keeps exactly one row, and an id keeps a row in
    each group that it is the first of. Rows with a null id are no member of a group and all stay.
    """
    # The rows travel as one struct, so that their columns cannot clash with the results.
    rows = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__hash"), F.col(text).alias("__whole"))
    prints = materialize(fingerprints(rows, ["__id", "__hash"], "__whole"), "fingerprints")
    firsts = prints.where("__id is not null").groupBy("bits").agg(F.min(F.struct("__id", "bits", "__hash")).alias("first")).join(_components(prints), "bits")
    firsts = firsts.groupBy("component").agg(F.min("first").alias("first")).select("first.__id", "first.__hash").distinct()
    kept = rows.drop("__whole").join(firsts, ["__id", "__hash"]).dropDuplicates(["__id", "__hash"])
    return kept.select("__row.*").unionByName(docs.where(F.col(doc_id).isNull()))
