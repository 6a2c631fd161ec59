"""Helpers shared by the text operators: table readers and Arrow passes over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker holds as objects at once; a longer single text is a slice of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, divisor: int):
    """``crc32`` of the value as text, modulo ``divisor``; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and the n + 1 offsets into them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    outputs: list[tuple[str, T.DataType]],
    worker: Callable[[], Callable[[pa.Array, pa.RecordBatch], list]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """One row per row of ``df``: the columns ``keep`` and what the worker computes from whole texts.

    Only the named columns are read, so other columns may have any name. ``worker()`` is called once in a
    task and returns a function of (texts without nulls, all columns of these rows) that gives one value
    list for each output. Null texts arrive as empty ones.
    """
    fields = [df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in outputs]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    names = [f.name for f in fields]
    source = df.select(*keep, F.col(text).alias("__text"))
    types = [arrow_type(t) for _, t in outputs]

    def run(batches):
        work = worker()
        for batch in batches:
            texts = batch.column(len(keep))
            for start, stop in text_slices(texts, limit):
                part = batch.slice(start, stop - start)
                found = work(pc.fill_null(part.column(len(keep)), ""), part)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, t, from_pandas=False) for x, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
