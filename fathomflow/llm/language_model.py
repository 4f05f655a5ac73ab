"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

The model is p(w | h) = a(h) c(hw)/c(h) + b(h) c(w)/N + d(h)/(V+1), with the three weights of a context h taken
from a bucket of its frequency. A fold of the training documents is deleted, counts are made on the rest, and
expectation-maximisation finds the weights that make the deleted fold likeliest; scores use the counts of all
training documents. All texts are counted and scored whole.

How counts meet tokens at scale: documents are cut into blocks; a block gives each distinct n-gram once, as a
64-bit hash, in sorted arrays dealt over buckets of the hash. A bucket adds up its blocks' arrays and answers
each with totals in the block's own order, so an answer needs no keys (mostly small numbers, packed). Answers
meet their block's documents in a cogroup, where the same arrays are cut again. Frequent words are summed in
their blocks first; no key, text or source can make a bucket or block large.

Defined results: a null text is empty and scores its end alone; a null id counts as training; equal rows
count as often as they stand; other columns are not carried; an empty table gives no rows. The table must read
alike twice (a written table does), since blocks are cut by its partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, written
from .textops import mix64, pair_hashes, span_hashes, text_chunks, word_spans
from .workers import tidy

FOLDS = 5
#: Documents of this fold are not learned from; those of the deleted fold set the weights.
HELD_OUT_FOLD = 1
DELETED_FOLD = 0
BLOCK_BYTES = 6 << 20
#: Input bytes (as Spark estimates them) for one bucket of n-grams.
BUCKET_BYTES = 4 << 20
#: Context buckets are powers of two of the context's count, with one for unseen contexts.
CONTEXT_BUCKETS = 32
#: Estimates enter expectation-maximisation as ratios to the uniform one, in this many steps a doubling.
RATIO_STEPS = 8
EM_ROUNDS = 60

_END, _START = (np.uint64(x) for x in mix64(np.array([11, 13], dtype=np.uint64)))
_ODD = np.uint64(1)


def _assign_blocks(block_bytes: int):
    """Numbers the rows of a partition in blocks of about block_bytes, the same each time. Documents of the deleted fold have
    blocks of their own, with odd numbers."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = [0, 0], [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("part")[0].as_py() << 32
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
            blocks = np.empty(batch.num_rows, np.int64)
            odd = batch.column("fold").to_numpy() == DELETED_FOLD
            for i, (size, k) in enumerate(zip(sizes.tolist(), odd.tolist(), strict=True)):
                if held[k] and held[k] + size > block_bytes:
                    number[k], held[k] = number[k] + 1, 0
                held[k] += size + 1
                blocks[i] = first + 2 * number[k] + k
            kept = [batch.column(c) for c in ("doc_id", "fold", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(blocks)], names=["doc_id", "fold", "text", "block"])

    return run


def _folded(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS
    return docs.select("doc_id", fold.cast("int").alias("fold"), "text", F.spark_partition_id().alias("part"))


@dataclass
class Tokens:
    """The tokens of a block: where each document's begin, and each token's place among the block's distinct n-grams."""

    offsets: np.ndarray
    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    end: int

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def contexts(self) -> np.ndarray:
        """The place of each token's context; a document's start counts as often as its end."""
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.offsets[:-1]] = self.end
        return before


def tokens_of(text: pa.Array) -> Tokens:
    """Words (A-Z lower-cased) and one end a document; unigram keys are even, bigram keys odd."""
    words, pairs, counts = [], [], []
    for chunk in text_chunks(text):
        starts, ends, first = word_spans(chunk)
        rows = len(first) - 1
        found = np.empty(len(starts) + rows, np.uint64)
        found[np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(first))] = span_hashes(chunk.data, starts, ends)
        at_end = first[1:] + np.arange(rows)
        found[at_end] = _END
        before = np.empty_like(found)
        before[1:] = found[:-1]
        before[first[:-1] + np.arange(rows)] = _START
        words.append(found & ~_ODD)
        pairs.append(pair_hashes(before, found) | _ODD)
        counts.append(np.diff(first) + 1)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    both = np.concatenate([*words, *pairs]) if words else np.zeros(0, np.uint64)
    keys, place = np.unique(both, return_inverse=True)
    half = len(both) // 2
    return Tokens(np.concatenate([[0], np.cumsum(n)]), keys, place[:half], place[half:], int(np.searchsorted(keys, _END & ~_ODD)))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that deals sorted keys to buckets, and where each bucket begins."""
    bucket = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: six low bytes as they are, two high ones, mostly zero, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :6].tobytes() + zlib.compress(steps[:, 6:].tobytes(), 1) + len(keys).to_bytes(4, "little")


def _unpack_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[-4:], "little")
    steps = np.empty((n, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(n, 6)
    steps[:, 6:] = np.frombuffer(zlib.decompress(raw[6 * n : -4]), np.uint8).reshape(n, 2)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


_COUNTED = "bucket int, block long, keys binary, kept binary, deleted binary"


def _block_counts(block: int, rows: list[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(rows)
    t = tokens_of(table.column("text").combine_chunks())
    fold = table.column("fold").to_numpy()[t.owner()]
    every = np.concatenate([t.word, t.pair])
    deleted = np.tile(fold == DELETED_FOLD, 2)
    kept = np.tile((fold != HELD_OUT_FOLD) & (fold != DELETED_FOLD), 2)
    counts = [np.bincount(every[m], minlength=len(t.keys)) for m in (kept, deleted)]
    order, begin = _dealt(t.keys, buckets)
    used = np.flatnonzero(np.diff(begin))
    for part in np.array_split(used, max(1, -(-len(used) // 16))):
        slices = [order[begin[b] : begin[b + 1]] for b in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(np.full(len(part), block)), pa.array([_pack_keys(t.keys[s]) for s in slices], pa.binary()), *(pa.array([_pack(c[s]) for s in slices], pa.binary()) for c in counts)],
            names=["bucket", "block", "keys", "kept", "deleted"],
        )


def _count_blocks(buckets: int, block_bytes: int):
    assign = _assign_blocks(block_bytes)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, tuple[int, list[pa.RecordBatch]]] = {}  # one of even and one of odd number
        for batch in assign(batches):
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks).tolist():
                known, rows = open_blocks.get(block & 1, (block, []))
                if known != block:
                    yield from _block_counts(known, rows, buckets)
                    rows = []
                open_blocks[block & 1] = (block, [*rows, batch.filter(pa.array(blocks == block))])
        for block, rows in open_blocks.values():
            yield from _block_counts(block, rows, buckets)

    return run


_ANSWERS = "block long, bucket int, kept binary, total binary, n_kept long, n_total long, v_kept long, v_total long"


def _answer(blocks: list[int], bucket: int, keys: list[np.ndarray], kept: list[np.ndarray], deleted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sum_kept = np.bincount(place, np.concatenate(kept), minlength=len(distinct)).astype(np.int64)
    sum_all = sum_kept + np.bincount(place, np.concatenate(deleted), minlength=len(distinct)).astype(np.int64)
    word = distinct & _ODD == 0
    totals = [int(sum_kept[word].sum()), int(sum_all[word].sum()), int((sum_kept[word] > 0).sum()), int((sum_all[word] > 0).sum())]
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    # Totals of the bucket stand in its first row alone.
    for i, block in enumerate(blocks):
        own = place[cuts[i] : cuts[i + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_pack(sum_kept[own])], pa.binary()), pa.array([_pack(sum_all[own])], pa.binary()), *(pa.array([x if i == 0 else 0], pa.int64()) for x in totals)],
            names=[x.split()[0] for x in _ANSWERS.split(", ")],
        )


@tidy
def _answer_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, blocks, keys, kept, deleted = None, [], [], [], []
    for batch in batches:
        for b, block, k, x, d in zip(*(batch.column(c) for c in ("bucket", "block", "keys", "kept", "deleted")), strict=True):
            if b.as_py() != bucket and blocks:
                yield from _answer(blocks, bucket, keys, kept, deleted)
                blocks, keys, kept, deleted = [], [], [], []
            bucket = b.as_py()
            blocks.append(block.as_py())
            keys.append(_unpack_keys(k.as_py()))
            kept.append(_unpack(x.as_py()))
            deleted.append(_unpack(d.as_py()))
    if blocks:
        yield from _answer(blocks, bucket, keys, kept, deleted)


def _counts_of(t: Tokens, answers: pa.Table, name: str, buckets: int) -> np.ndarray:
    """The corpus counts of a block's distinct n-grams from its answers."""
    order, begin = _dealt(t.keys, buckets)
    found = np.zeros(len(t.keys), np.int64)
    for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column(name), strict=True):
        found[order[begin[bucket] : begin[bucket + 1]]] = _unpack(raw.as_py())
    return found


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), up to the last bucket."""
    return np.where(counts > 0, np.minimum(np.frexp(counts.astype(np.float64))[1], CONTEXT_BUCKETS - 1), 0)


def _estimates(t: Tokens, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the context's bucket, and the bigram and unigram estimates."""
    context = counts[t.contexts()]
    return context_bucket(context), counts[t.pair] / np.maximum(context, 1), counts[t.word] / max(n, 1)


def _quantised(ratio: np.ndarray) -> np.ndarray:
    return np.rint(RATIO_STEPS * np.log2(1 + ratio)).astype(np.int64)


def _histogram(n: int, v: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("context", pa.int64()), ("two", pa.int64()), ("one", pa.int64()), ("n", pa.int64())])
        t = tokens_of(docs.column("text").combine_chunks())
        context, two, one = _estimates(t, _counts_of(t, answers, "kept", buckets), n)
        cells, counts = np.unique(np.stack([context, _quantised(two * (v + 1)), _quantised(one * (v + 1))]), axis=1, return_counts=True)
        return pa.Table.from_arrays([pa.array(x) for x in (*cells, counts)], schema=schema)

    return run


def learn_weights(cells: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket from held-out cells (context, two, one, n).

    Buckets start alike and keep one pseudo-count for each part, so none becomes impossible."""
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    if not len(cells):
        return weights
    context, n = cells[:, 0].astype(np.int64), cells[:, 3].astype(np.float64)
    ratios = np.stack([np.exp2(cells[:, 1] / RATIO_STEPS) - 1, np.exp2(cells[:, 2] / RATIO_STEPS) - 1, np.ones(len(cells))], axis=1)
    for _ in range(rounds):
        joint = weights[context] * ratios
        share = joint / joint.sum(axis=1, keepdims=True) * n[:, None]
        sums = np.stack([np.bincount(context, share[:, j], minlength=CONTEXT_BUCKETS) for j in range(3)], axis=1) + 1
        sums[0, 0] = 0
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, weights: np.ndarray, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        t = tokens_of(docs.column("text").combine_chunks())
        counts = _counts_of(t, answers, "total", buckets)
        context, two, one = _estimates(t, counts, n)
        w = weights[context]
        model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1))
        c = counts[t.word]
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        owner, rows = t.owner(), docs.num_rows
        columns = [
            docs.column("doc_id"),
            pa.array(docs.column("fold").to_numpy() == HELD_OUT_FOLD),
            pa.array(np.diff(t.offsets)),
            pa.array(np.bincount(owner[c > 0], minlength=rows)),
            pa.array(np.full(rows, n)),
            pa.array(np.bincount(owner, base, minlength=rows)),
            pa.array(np.bincount(owner, model, minlength=rows)),
        ]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text)."""
    spark = bounded_batches(docs.sparkSession)
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(spark.sparkContext.defaultParallelism, min(estimate // BUCKET_BYTES, 1 << 20))
    rows = _folded(docs)
    blocks = rows.mapInArrow(_assign_blocks(block_bytes), "doc_id long, fold int, text string, block long")
    counted = rows.mapInArrow(_count_blocks(buckets, block_bytes), _COUNTED)
    answers = written(counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answer_buckets, _ANSWERS), "ngram-counts")
    n_kept, n, v_kept, v = (int(x or 0) for x in answers.agg(*(F.sum(c) for c in ("n_kept", "n_total", "v_kept", "v_total"))).first())

    odd = F.col("block") % 2 == 1
    held = blocks.where(F.col("fold") == DELETED_FOLD).groupBy("block").cogroup(answers.where(odd).groupBy("block")).applyInArrow(_histogram(n_kept, v_kept, buckets), "context long, two long, one long, n long")
    cells = held.groupBy("context", "two", "one").agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64)
    weights = learn_weights(cells[np.lexsort(cells.T[::-1])] if len(cells) else cells)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(n, v, weights, buckets), _SCORES)
