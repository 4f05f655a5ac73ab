"""A Bloom filter over ids, of a bounded size, to keep rows that a join would drop out of its shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import mix64
from .workers import tidy

HASHES = 4
BITS_PER_ID = 12
#: The filter never exceeds this many bits (8 MB); past it, more rows pass and the join drops them.
MAX_BITS = 1 << 26


def _positions(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(HASHES):
        with np.errstate(over="ignore"):
            yield mix64(ids.astype(np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(bits - 1)


def _set_bits(bits: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for at in _positions(batch.column("id").to_numpy(), bits):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        found = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(words[found].view(np.int64))], names=["word", "mask"])

    return run


def may_hold(rows: DataFrame, column: str, ids: DataFrame, count: int, invert: bool = False) -> DataFrame:
    """The rows whose id may be among ``count`` non-null ids (id long): all that are, and a few others. Inverted, the rest."""
    bits = 1 << max(10, min(MAX_BITS, count * BITS_PER_ID).bit_length())
    masks = ids.mapInArrow(_set_bits(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[masks["word"].to_numpy(np.int64)] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            given = batch.column(column)
            values = given.fill_null(0).to_numpy()
            held = given.is_valid().to_numpy(zero_copy_only=False).copy()
            for at in _positions(values, bits):
                held &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(held != invert))

    return rows.mapInArrow(run, T.StructType(rows.schema.fields))
