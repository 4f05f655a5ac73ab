"""Removal of repeated passages: every byte covered by a string of ``length`` bytes that starts anywhere else too.

The corpus is not sorted as one: a hash of each window's content deals windows to tasks such that equal windows
meet, and suffixes.py finds the repeated ones there by a Burrows-Wheeler transform.

1. The key of a window is the least hash of the byte grams in it. Neighbouring windows mostly share it, so a text
   becomes a few spans of window starts, one for each run of equal keys. Keys found once, in one text, are done with.
2. Spans of a key go to the least text that has it, so texts that share much meet in one place; what a text sends
   to one place is cut out as whole pieces, and long ones are cut into overlapping pieces of a bounded size.
3. Places that hold few bytes are packed into sorts of bounded size. A place that holds more is thinned out: its pieces
   are dealt to blocks, and what is repeated in a block is marked there, in all its copies. Only the first of equal
   windows goes on, to be dealt again by keys of longer grams: a window that no other of its block equals is its own
   first, so marking firsts later on loses nothing. With grams as long as the window, a place holds one window, which
   each block leaves once. So no passage, however common, and no run of one byte, however long, makes a task large;
   nothing is dropped, and nothing is joined back to its copies.

Equal texts (by their SHA-256) are one text; if there are two, all of it is repeated. Rows are named by their place in the table.

Defined results: a null text is empty and keeps nothing (remove_passages leaves it null), as does a removed one; texts
shorter than ``length`` are kept; null ids and repeated rows (which are copies of one another) are like others; columns
of any name are left as they are; an empty table gives no rows. The table must read alike twice (a written table does).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import may_hold
from .storage import bounded_batches, written
from .suffixes import runs, window_classes
from .textops import span_hashes, text_chunks
from .workers import tidy

LENGTH = 200
#: Gram lengths of the levels' window keys, as shares of the window.
GRAM_SHARES = (0.16, 0.4, 0.8, 1.0)
#: A place with more bytes than this is thinned out and dealt again.
PLACE_BYTES = 1 << 19
#: Bytes that one sort holds at the most, and a piece of a text.
SORT_BYTES = 1 << 20
PIECE_BYTES = 1 << 18


def _gram(level: int, length: int) -> int:
    return max(1, int(length * GRAM_SHARES[level]))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = np.minimum(values[: len(values) - (width - have)], values[width - have :])
    return values


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    starts = np.arange(len(data) - gram + 1)
    return span_hashes(data, starts, starts + gram, fold=False)


def window_keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The key of each window of ``length`` bytes: the least hash of its grams."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    return _sliding_least(_grams(data, gram), length - gram + 1)


def keys_held_twice(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Marks the windows that hold the gram of their key more than once (or, rarely, others), as periodic text does."""
    if len(data) < length:
        return np.zeros(0, bool)
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(data) - gram + 1, dtype=np.uint64) & low
    hashes, width = _grams(data, gram) & ~low, length - gram + 1
    leftmost, rightmost = _sliding_least(hashes | place, width), _sliding_least(hashes | (low - place), width)
    return (leftmost & low) != low - (rightmost & low)


def key_spans(keys: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal keys: (key, first window, last window); runs also end where ``cuts`` marks a window as first."""
    change = keys[1:] != keys[:-1]
    if cuts is not None:
        change |= cuts[1:]
    first = np.concatenate([[0], np.flatnonzero(change) + 1])[: len(keys)]
    last = np.append(first[1:], len(keys)) - 1
    return keys[first].view(np.int64), first, last[: len(first)]


_SPANS = "key long, tid long, first int, last int"


def _emit_spans(length: int):
    gram = _gram(0, length)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                keys = window_keys(chunk.data, length, gram)
                if not len(keys):
                    continue
                # Windows that reach over the end of their text are none; the others are in rows by their starts.
                room = np.maximum(np.diff(chunk.offsets) - length + 1, 0)
                rows = np.repeat(np.arange(len(room)), room)
                start = np.arange(len(rows)) - np.repeat(np.cumsum(room) - room, room)
                at = chunk.offsets[rows] + start
                key, first, last = key_spans(keys[at], start == 0)
                # A text with a period can repeat a window within one run of equal keys. Such a run gives a second span, so
                # that its key counts as found twice.
                twice = np.concatenate([[0], np.cumsum(keys_held_twice(chunk.data, length, gram)[at])])
                again = np.flatnonzero((twice[last + 1] > twice[first]) | (last - first > length - gram))
                key, first, last = np.append(key, key[again]), np.append(first, first[again]), np.append(last, first[again])
                tid = batch.column("tid").slice(chunk.lo, chunk.hi - chunk.lo).to_numpy()[rows[first]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tid), pa.array(start[first].astype(np.int32)), pa.array(start[last].astype(np.int32))], names=["key", "tid", "first", "last"])

    return run


_PIECES = "place long, row long, first int, bytes binary"
#: Repeated runs of window starts have no bytes; pieces that go on have a place.
_SOLVED = "place long, row long, first int, last int, bytes binary"


def _cut_pieces(length: int):
    """The pieces of each text: spans that go to one place are joined where they touch, and reach length - 1 bytes further."""

    def pieces(spans: list[dict], n: int) -> Iterator[tuple[int, int, int]]:
        """(place, first window, last window) of a text of n windows, cut at the size of a piece."""
        place, first, last = None, 0, -2
        for s in [*sorted((s["place"], s["first"], min(s["last"], n - 1)) for s in spans), None]:
            if s is not None and s[0] == place and s[1] <= last + 1:
                last = max(last, s[2])
                continue
            if place is not None:
                for a in range(first, last + 1, PIECE_BYTES):
                    yield place, a, min(last, a + PIECE_BYTES - 1)
            if s is not None:
                place, first, last = s

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = _Rows(_PIECES), 0
            for row, text, spans in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                for place, first, last in pieces(spans, len(raw) - length + 1):
                    out.add(place, row, first, raw[first : last + length])
                    held += last + length - first
                    if held > 4 << 20:
                        yield out.batch()
                        held = 0
            yield out.batch()

    return run


class _Rows:
    """Columns of a schema of long, int and binary fields, filled row by row."""

    def __init__(self, schema: str):
        fields = [f.split() for f in schema.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        self.schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        self.columns: list[list] = [[] for _ in fields]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        """The rows so far; further ones start anew."""
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.columns]
        return found


def _solve(pieces: list[tuple[int, int, bytes]], length: int, gram: int | None) -> Iterator[pa.RecordBatch]:
    """Repeated runs of pieces (row, first, bytes), all copies included; with a gram, also the first of equal windows, cut
    into parts by its keys."""
    numbers: dict[bytes, int] = {}
    owner = np.array([numbers.setdefault(raw, len(numbers)) for _, _, raw in pieces])
    texts = list(numbers)
    joined, repeated, first = window_classes(texts, length)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    copies = np.bincount(owner)
    for i in np.flatnonzero(copies > 1):
        repeated[ends[i] - sizes[i] : ends[i] - length] = True
    low, high = runs(repeated)  # separators end runs
    text = np.searchsorted(ends, low, side="right")
    begin = (ends - sizes)[text]
    count = np.bincount(text, minlength=len(texts))
    rows, offsets = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    # Each piece has the runs of its text.
    each = count[owner]
    at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(count) - count)[owner], each)
    move = np.repeat(offsets, each) - begin[at]
    found = [pa.nulls(len(at), pa.int64()), pa.array(np.repeat(rows, each)), pa.array((low[at] + move).astype(np.int32)), pa.array((high[at] + move).astype(np.int32)), pa.nulls(len(at), pa.binary())]
    yield pa.RecordBatch.from_arrays(found, names=["place", "row", "first", "last", "bytes"])
    if gram is None:
        return
    _, example = np.unique(owner, return_index=True)
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    keys = window_keys(joined, length, gram)[starts]
    cut = np.concatenate([[True], (np.diff(starts) != 1) | (keys[1:] != keys[:-1])])
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(starts)) - 1
    raw, out = joined.tobytes(), _Rows(_SOLVED)
    text = np.searchsorted(ends, starts[heads], side="right")
    move = offsets[example[text]] - (ends - sizes)[text]
    for key, a, b, row, m in zip(keys[heads].view(np.int64).tolist(), starts[heads].tolist(), starts[tails].tolist(), rows[example[text]].tolist(), move.tolist(), strict=True):
        out.add(key, row, a + m, b + m, raw[a : b + length])
    yield out.batch()


def _sorted_batches(length: int, gram: int | None, alone: bool):
    """Rows come by place. Without a gram, whole places are joined up to the size of one sort; with one, rows are joined as
    they come. Places of one piece are left out unless windows may repeat in it (``alone``)."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, bytes]] = []
        here: list[tuple[int, int, bytes]] = []
        size, own, place = 0, 0, None

        def close() -> None:
            nonlocal done, here, size, own
            if alone or len(here) > 1 or gram is not None:
                done += here
            else:
                size -= own
            here, own = [], 0

        for batch in batches:
            for p, row, first, raw in zip(*(batch.column(c).to_pylist() for c in ("place", "row", "first", "bytes")), strict=True):
                if p != place:
                    close()
                    place = p
                if size + len(raw) + 1 > SORT_BYTES:
                    if gram is not None:
                        close()
                    if done:
                        yield from _solve(done, length, gram)
                        done, size = [], own
                here.append((row, first, raw))
                size, own = size + len(raw) + 1, own + len(raw) + 1
        close()
        if done:
            yield from _solve(done, length, gram)

    return run


def _found_runs(pieces: DataFrame, length: int, place_bytes: int) -> DataFrame:
    """(row, first, last): runs of repeated window starts, from pieces (place, row, first, bytes) of level 0."""
    found, level = None, 0
    while True:
        sizes = pieces.groupBy("place").agg(F.sum(F.octet_length("bytes") + 1).alias("size")).where(F.col("size") > place_bytes)
        large = written(sizes.select("place", F.ceil(F.col("size") / place_bytes).alias("blocks")), "large-places")
        count = large.count()
        small = pieces.join(large, "place", "left_anti") if count else pieces
        shuffled = small.repartition("place").sortWithinPartitions("place")
        solved = shuffled.mapInArrow(_sorted_batches(length, None, level == 0), _SOLVED).select("row", "first", "last")
        found = solved if found is None else found.unionByName(solved)
        if not count:
            return found
        level = min(level + 1, len(GRAM_SHARES) - 1)
        dealt = pieces.join(large, "place").withColumn("block", F.pmod(F.xxhash64("row", "first"), F.col("blocks"))).repartition("place", "block").sortWithinPartitions("place", "block")
        thinned = written(dealt.select("place", "row", "first", "bytes").mapInArrow(_sorted_batches(length, _gram(level, length), True), _SOLVED), "thinned-places")
        found = found.unionByName(thinned.where("bytes is null").select("row", "first", "last"))
        pieces = thinned.where("bytes is not null").select("place", "row", "first", "bytes")


def _texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, tid): rows by their place in the table; a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).withColumn("tid", F.xxhash64("text"))


def text_digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tid, n_bytes, sha) of each row of (doc_id, text), written."""
    return written(_texts(docs).select("row", "doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "text-digests")


def _groups(digests: DataFrame, length: int) -> DataFrame:
    """(sha, tid, row, copies): of each different text that is long enough its first row."""
    return digests.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("tid").alias("tid"), F.min("row").alias("row"), F.count("*").alias("copies"))


def repeated_windows(docs: DataFrame, digests: DataFrame, length: int = LENGTH, place_bytes: int = PLACE_BYTES) -> DataFrame:
    """(row, ranges): of the first row of each text with repeated strings, the runs of their starts (first, last)."""
    bounded_batches(docs.sparkSession)
    rows = _texts(docs)
    spans = written(rows.where(F.octet_length("text") >= length).select("tid", "text").mapInArrow(_emit_spans(length), _SPANS), "window-spans")
    window = F.struct("tid", "first", "last")
    shared = spans.groupBy("key").agg(F.min(window).alias("low"), F.max(window).alias("high")).where(F.col("low") != F.col("high")).select("key", F.col("low.tid").alias("place"))
    placed = spans.join(shared, "key").groupBy("tid").agg(F.collect_set(F.struct("place", "first", "last")).alias("spans"))
    # Different texts of one hash have the spans of both, which is more than they need.
    firsts = written(_groups(digests, length).join(placed, "tid").select("row", "spans"), "placed-spans")
    wanted = may_hold(rows.select("row", "text"), "row", firsts.select(F.col("row").alias("id")), firsts.count())
    pieces = written(wanted.join(firsts, "row").mapInArrow(_cut_pieces(length), _PIECES), "pieces")
    found = _found_runs(pieces, length, place_bytes)
    return written(found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges")), "repeated-ranges")


def removed_runs(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """The byte runs (begin, end) that sorted runs of window starts cover."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        begin, end = r["first"], r["last"] + length
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for begin, end in cut:
        kept.append(raw[at:begin])
        at = end
    return b"".join([*kept, raw[at:]])


def _remove(length: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                cut = removed_runs(ranges, length)
                removed.append(sum(e - b for b, e in cut))
                spans.append(len(cut))
                digests.append(hashlib.sha256(_without(text.encode(), cut)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["row", "n_removed", "n_spans", "cut_sha256"])

    return run


def removal_digests(docs: DataFrame, length: int = LENGTH, place_bytes: int = PLACE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of (doc_id, text)."""
    digests = text_digests(docs)
    ranges = repeated_windows(docs, digests, length, place_bytes)
    copied = written(_groups(digests, length).where("copies > 1").select("sha", "row"), "copied-texts")
    single = written(ranges.join(copied, "row", "left_anti"), "single-ranges")
    wanted = may_hold(_texts(docs).select("row", "text"), "row", single.select(F.col("row").alias("id")), single.count())
    cut = wanted.join(single, "row").mapInArrow(_remove(length), "row long, n_removed long, n_spans long, cut_sha256 string")
    joined = digests.join(copied.select("sha", F.lit(True).alias("copied")), "sha", "left").join(cut, "row", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "sha")).alias("kept_sha256"),
    )


def _cut_texts(length: int):
    """Gives each document (a struct) its text without the ranges' bytes."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column("doc"), []
            names = [f.name for f in docs.type]
            for text, ranges in zip(docs.field("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                texts.append(_without(text.encode(), removed_runs(ranges, length)).decode(errors="ignore") if ranges else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else docs.field(n) for n in names], names=names)

    return run


def remove_passages(docs: DataFrame, length: int = LENGTH, place_bytes: int = PLACE_BYTES) -> DataFrame:
    """The documents with all their columns, their texts without repeated strings (a character that a cut splits goes
    whole) and ``n_chars``, where there is such a column, counted again.

    Only texts that a Bloom filter cannot clear of repetitions are shuffled; equal texts are removed whole."""
    digests = text_digests(docs)
    found = repeated_windows(docs, digests, length, place_bytes)
    copied = _groups(digests, length).where("copies > 1").select("sha")
    whole = digests.join(copied, "sha").select("row", F.array(F.struct(F.lit(0).alias("first"), (F.col("n_bytes") - length).cast("int").alias("last"))).alias("ranges"))
    ranges = written(found.join(whole, "row", "left_anti").unionByName(whole), "cut-ranges")
    ids, count = ranges.select(F.col("row").alias("id")), ranges.count()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    clear = may_hold(rows, "row", ids, count, invert=True).select("doc.*")
    asked = may_hold(rows, "row", ids, count).join(ranges, "row", "left").select("doc", "ranges")
    changed = asked.mapInArrow(_cut_texts(length), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clear.unionByName(changed)
