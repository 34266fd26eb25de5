"""Lines, byte positions and matches of text columns, as expressions and narrow operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cut(keys: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Key, number, first byte and text of all lines of a batch, in a few passes over its bytes."""
    known = texts.is_valid()
    keys, texts = keys.filter(known), texts.filter(known).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    first = offsets[:-1] - offsets[0]
    breaks = np.flatnonzero(data == 10)
    # A line starts with its text or behind a break.
    starts = np.concatenate([first, breaks + 1])
    rows = np.concatenate([np.arange(len(first)), np.searchsorted(first, breaks, side="right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.r_[rows[1:] != rows[:-1], True] if len(rows) else np.zeros(0, bool)
    ends[: len(rows)][last] = (offsets[1:] - offsets[0])[rows[last]]
    ends = ends[: len(rows)]
    kept = data[data != 10]
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary()).cast(pa.string())
    count = np.bincount(rows, minlength=len(first))
    number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + 1
    return keys.take(pa.array(rows)), number, starts - first[rows], text


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``line_no`` (from 1), ``start_byte`` and ``line``; no shuffle.

    A null text has no lines, an empty one has one. Texts are cut by the batch, in time that goes as their
    bytes, however many lines one has; no built-in function gives running sums within a row in linear time.
    """
    kind = files.schema[key]
    schema = T.StructType([kind, T.StructField("line_no", T.IntegerType()), T.StructField("start_byte", T.LongType()), T.StructField("line", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                keys, number, start, line = _cut(some.column(0), some.column(1))
                yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(start, pa.int64()), line], names=schema.names)

    return files.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(cut, schema)


def match_starts(text: Column, pattern: str) -> Column:
    """Start of each match in characters: behind all pieces and matches before it.

    The sums run over pairs of pieces and matches, and each keeps the starts before it: texts with very
    many matches are better cut into lines first.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"] + x["gap"]
        return F.struct((here + x["found"]).alias("at"), F.concat(s["starts"], F.array(here)).alias("starts"))

    return F.when(text.isNotNull(), F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("found")), start, step, lambda s: s["starts"]))


def count_of(text: Column, part: str) -> Column:
    return F.size(F.split(text, part, -1)) - 1
