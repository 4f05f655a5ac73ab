"""Token-id files in ORC: ids as run-length encoded integers, in ascending document order.

Every document is one row (ids by the tokenizer, then an end id). Rows are range-partitioned by document id,
so files and stripes hold disjoint id ranges: readers prune files, stripes and row groups by their minima and
maxima, by row indexes (one entry each ``row_index_stride`` rows) and by Bloom filters on the document id,
and split large files at stripes.

Defined results: a null text has the end id alone; rows with a null id come first; rows that share an id are
ordered by their texts' hashes, so equal rows are interchangeable; an empty table gives an empty file set;
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, new_path
from .tokens import DEFAULT_TOKENIZER, crc32, encoded_rows, tokenizer_path
from .workers import keeping, tidy

END_ID = 2
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 2_000
BLOOM_FALSE_POSITIVES = 0.01
#: Input bytes (as Spark estimates them) for one output file.
FILE_BYTES = 64 << 20

_SCHEMA = "doc_id long, part int, seq long, n_tokens long, ids array<int>"


def _tokenise(path: str, end_id: int):
    @keeping("encoders", "powers")
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            docs, ids, sizes, first, held = batch.column("doc_id"), [], [], 0, 0
            for row, found in encoded_rows(batch.column("text"), path, end_id):
                ids.append(found)
                sizes.append(len(found) // 4)
                held += len(found)
                if held > 4 << 20 or row == batch.num_rows - 1:
                    yield _id_rows(docs.slice(first, len(ids)), part, seq, ids, sizes)
                    seq += len(ids)
                    ids, sizes, first, held = [], [], row + 1, 0

    return run


def _id_rows(docs: pa.Array, part: int, seq: int, ids: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    n = len(ids)
    values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    columns = [docs, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "seq", "n_tokens", "ids"])


def write_token_files(docs: DataFrame, path: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID, files: int | None = None) -> str:
    """Writes the ids of all documents (doc_id, text) under path as ORC; returns path.

    ``part`` numbers the files in document order and ``seq`` the rows of a file. Texts, not ids, are
    shuffled: range bounds are sampled from them before anything is encoded."""
    spark = bounded_batches(docs.sparkSession)
    if files is None:
        estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files = max(spark.sparkContext.defaultParallelism * 2, min(estimate // FILE_BYTES + 1, 100_000))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("salt")]
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.rand(7).alias("salt"))
        .repartitionByRange(files, *keys)
        .sortWithinPartitions(*keys[:2])
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    (
        ordered.mapInArrow(_tokenise(tokenizer_path(tokenizer), end_id), _SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FALSE_POSITIVES)
        .orc(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows (doc_id, part, seq, n_tokens, ids) of token files; ``where`` on doc_id is pushed to the ORC
    reader, which skips stripes and row groups by minima, maxima and Bloom filters."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    return rows if where is None else rows.where(where)


@tidy
def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        kept = [batch.column(c) for c in ("doc_id", "part", "seq")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the ids in the files.

    Starts come from three levels: a document's place in its file by a window over that file, a file's place
    by a window over file totals, of which there is one row a file."""
    read = read_token_files(spark, path).select("doc_id", "part", "seq", "ids").mapInArrow(_digests, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long")
    totals = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return read.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, "part").select("doc_id", (F.col("part_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes token files into the session's shared folder and returns their digests, read back from them."""
    spark = docs.sparkSession
    return token_digests(spark, write_token_files(docs, new_path(spark, "token-files"), tokenizer, end_id))
