"""Packing by first-fit decreasing with a tournament tree over bin capacities, in randomised groups.

A document's ids (with an end id) are cut every ``capacity`` ids; a whole cut fills a sequence alone, and the
rests are packed. Rows go to groups by a hash of their row's place, not of their content, so no key, source
or copy can swell a group; each group packs alone, and groups of thousands of rests leave little padding.

Defined results: null or empty texts are the end id alone; null ids and repeated rows are packed like others;
an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .tokens import DEFAULT_TOKENIZER, crc32, encoded_rows, tokenizer_path
from .workers import keeping

CAPACITY = 2048
END_ID = 1
#: Documents that one group packs, on average.
GROUP_DOCS = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


class TournamentTree:
    """Free capacities of bins in opening order; finds the first bin with room in logarithmic time.

    A complete binary tree: a leaf is a bin, an inner node holds the larger value of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """Puts an item into the first bin that has room for it; returns the bin."""
        best, node = self.best, 1
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        left = best[node] - size
        bin_ = node - self.width
        best[node] = left
        while node > 1:
            node //= 2
            larger = max(best[2 * node], best[2 * node + 1])
            if best[node] == larger:
                break
            best[node] = larger
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, given in non-increasing order of length."""
    tree = TournamentTree(max(1, len(lengths)), capacity)
    return np.fromiter((tree.place(int(x)) for x in lengths), dtype=np.int64, count=len(lengths))


def padding_of(used: np.ndarray, capacity: int) -> np.ndarray:
    """Padding ids of sequences: up to capacity, but none where the length is already a power of two."""
    return np.where(used & (used - 1) == 0, 0, capacity - used)


def _pieces(path: str, end_id: int, capacity: int):
    @keeping("encoders", "powers")
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for row, ids in encoded_rows(batch.column("text"), path, end_id):
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    at.append(row)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(crc32(piece))
                    total.append(n)
            at = pa.array(at, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *numbers, batch.column("row").take(at), batch.column("salt").take(at)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document (doc_id, text): start, length, checksum, the document's ids in all."""
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).withColumn("salt", F.xxhash64("row"))
    return placed.mapInArrow(_pieces(tokenizer_path(tokenizer), end_id, capacity), PIECES)


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        bins = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows = rows.assign(bin=bins).sort_values("bin", kind="stable")
        lengths, bins = rows["length"].to_numpy(), rows["bin"].to_numpy()
        ends = np.cumsum(lengths)
        first = np.searchsorted(bins, np.arange(bins[-1] + 1))
        begin = (ends - lengths)[first]
        used = np.diff(np.append(begin, ends[-1]))
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=ends - lengths - begin[bins], sequence_tokens=used[bins], padding=padding_of(used, capacity)[bins])[[x.split()[0] for x in PACKED.split(", ")]]

    return run


def pack(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids: one row a piece with its sequence, its
    offset there (gapless from 0), the sequence's ids and padding. A piece's ids follow from the document by
    start and length, so ids need not be shuffled."""
    bounded_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    pieces = cut_pieces(docs, tokenizer, end_id, capacity)
    return pieces.groupBy(F.pmod("salt", F.lit(groups)).alias("pack_group")).applyInPandas(_pack_group(capacity), PACKED)
