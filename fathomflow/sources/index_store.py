"""A retrieval index as versioned tables: immutable segments, and manifests of which the newest committed one counts.

A segment holds one batch of chunks under ``segments/<table>/segment=<id>``:

- ``chunks``: the stored columns of each chunk,
- ``lists``: (chunk_id, length, terms, tf), a row a chunk with its distinct terms in a line and their counts packed, with the stored columns and its sparse vector of
  hashed terms (buckets, counts); they are written where the texts stand, in one pass without a shuffle, and scored in scans against all queries. A few rows
  tell the terms of their task's chunks and in how many of these each is,
- ``terms``: (term, df), added up from there,
- ``graphs``: navigable graphs of the chunks' own vectors, where they have a column ``vector``.

An append writes a segment with the chunks that the index lacks, then one manifest file, whose rename is the commit: readers
hold a version's list of segments and never see half of a batch. Of two writers that made the same version the first to be visible wins;
the other raises ``Conflict`` and may append again. What a version needs of the whole index (number of chunks, their length, the mean
weight of terms) is in its manifest.

Defined results: chunks with a null id are left out; of chunks that share an id within a batch one is taken; null texts have no terms but
count as chunks; an empty batch makes a version without a new segment; an index of other dimensions than asked for, or of an earlier layout of lists, reads
as absent, its files staying where they are."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import navigable, retrieval

TABLES = ("chunks", "lists", "terms", "graphs")
#: Of term lists, as this version writes and reads them.
LAYOUT = 2
_MANIFEST = "writer string, segments array<string>, chunks long, total_length long, mean_weight double, dim int, id_type string, vectors boolean, graphs boolean, layout int"


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class Snapshot(NamedTuple):
    version: int
    segments: tuple[str, ...]
    chunks: int
    total_length: int
    mean_weight: float
    dim: int
    id_type: str
    vectors: bool
    graphs: bool


def _distinct(chunks: DataFrame) -> DataFrame:
    """Chunks with an id, one of each. Texts are dealt by id only where ids do repeat."""
    named = chunks.where("chunk_id is not null")
    repeats = named.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    return named.dropDuplicates(["chunk_id"]) if repeats.limit(1).count() else named


class IndexStore:
    """The index under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, dim: int = retrieval.HASH_DIM):
        self.spark, self.root, self.dim = spark, root.rstrip("/"), dim

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """The newest committed version, or the named one; None where there is none, or of other dimensions."""
        try:
            rows = self.spark.read.schema(f"{_MANIFEST}, version int").json(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        asked = rows if version is None else rows.where(F.col("version") == version)
        # Versions are few, and so are writers of one version.
        found = asked.orderBy(F.desc("version"), F.col("_metadata.file_modification_time"), "writer").first()
        if found is None or found.dim != self.dim or found.layout != LAYOUT:
            return None
        return Snapshot(found.version, tuple(found.segments), found.chunks, found.total_length, found.mean_weight, found.dim, found.id_type, found.vectors, found.graphs)

    def table(self, name: str, snapshot: Snapshot) -> DataFrame:
        """A table of all segments of a version; ``packed`` and ``vectors`` (chunk_id, v) are the lists' vectors, as stored and as arrays."""
        if name == "vectors":
            return retrieval.list_vectors(self.table("packed", snapshot), self.dim)
        schemas = {"lists": f"chunk_id {snapshot.id_type}, {retrieval.LISTED}", "packed": f"chunk_id {snapshot.id_type}, {retrieval.PACKED}", "terms": "term string, df long"}
        folder = f"{self.root}/segments/{'lists' if name == 'packed' else name}"
        paths = [f"{folder}/segment={s}" for s in snapshot.segments]
        if not paths:
            return self.spark.createDataFrame([], schemas.get(name, f"chunk_id {snapshot.id_type}"))
        if name in schemas:
            return self.spark.read.schema(schemas[name]).option("basePath", folder).parquet(*paths)
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def index(self, version: int | None = None) -> retrieval.Index:
        """What retrieval reads of a version."""
        found = self.snapshot(version)
        if found is None:
            raise ValueError(f"no version {version or ''} of an index with {self.dim} dimensions in {self.root}")
        return retrieval.Index(self.table("lists", found), self.table("terms", found), self.table("vectors", found) if found.vectors else None, found.chunks, found.total_length, found.mean_weight, self.table("packed", found) if found.vectors else None)

    def graphs(self, version: int | None = None) -> DataFrame:
        """The navigable graphs of a version, for ``navigable.search``; shards of different segments are apart."""
        found = self.snapshot(version)
        if found is None or not found.graphs or not found.segments:
            raise ValueError(f"no graphs in {self.root}")
        parts = [self.spark.read.parquet(f"{self.root}/segments/graphs/segment={s}").withColumn("shard", (F.col("shard") * len(found.segments) + i).cast("int")) for i, s in enumerate(found.segments)]
        return functools.reduce(DataFrame.unionByName, parts)

    def added(self, version: int) -> DataFrame:
        """(chunk_id, version) of the chunks that a version brought."""
        now, before = self.snapshot(version), self.snapshot(version - 1)
        brought = [s for s in now.segments if before is None or s not in before.segments]
        return self.table("chunks", now._replace(segments=tuple(brought))).select("chunk_id", F.lit(version).alias("version"))

    def append(self, chunks: DataFrame, stored: Sequence[str] | None = None, vectors: bool = True) -> Snapshot:
        """A version with the chunks (chunk_id, text and further columns) that the index lacks; ``stored`` names the columns kept besides the id (all, if not given). Without vectors it serves term weights alone."""
        base = self.snapshot()
        fresh = _distinct(chunks)
        if base is not None and base.segments:
            fresh = retrieval.not_indexed(fresh, self.table("chunks", base), "chunk_id")
        return self._commit(base, base.segments if base else (), fresh, stored, vectors)

    def rebuild(self, chunks: DataFrame, stored: Sequence[str] | None = None, vectors: bool = True) -> Snapshot:
        """A version with the given chunks alone; earlier versions stay readable."""
        return self._commit(self.snapshot(), (), _distinct(chunks), stored, vectors)

    def _commit(self, base: Snapshot | None, segments: tuple[str, ...], fresh: DataFrame, stored: Sequence[str] | None, vectors: bool) -> Snapshot:
        segment = uuid.uuid4().hex
        path = {name: f"{self.root}/segments/{name}/segment={segment}" for name in TABLES}
        read = self.spark.read
        kind = fresh.schema["chunk_id"].dataType.simpleString()
        columns = fresh.columns if stored is None else ["chunk_id", *(c for c in stored if c != "chunk_id")]
        # One pass over the texts; the stored columns are kept beside the term lists until the chunks are copied from there.
        carried = [c for c in dict.fromkeys([*columns, *(["vector"] if "vector" in fresh.columns else [])])]
        told = [f"_{i}" for i in range(len(carried))]
        plain = fresh.select(*[F.col(c).alias(a) for c, a in zip(carried, told, strict=True)], "text")
        retrieval.term_lists(plain, told, self.dim if vectors else None).withColumnRenamed(told[carried.index("chunk_id")], "chunk_id").write.parquet(path["lists"])
        whole_lists = read.parquet(path["lists"])
        added = whole_lists.select(*[F.col("chunk_id" if c == "chunk_id" else a).alias(c) for c, a in zip(carried, told, strict=True)])
        added.select(columns).write.parquet(path["chunks"])
        retrieval.frequencies(read.schema(retrieval.TOLD).parquet(path["lists"])).write.parquet(path["terms"])
        if "vector" in fresh.columns:
            navigable.build(added.select("chunk_id", "vector")).write.parquet(path["graphs"])

        n, lengths = whole_lists.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        whole = Snapshot((base.version if base else 0) + 1, (*segments, segment) if n else segments, n, 0, 0.0, self.dim, kind if n or not base else base.id_type, vectors and (not segments or base.vectors), "vector" in fresh.columns and (not segments or base.graphs))
        kept = base.chunks if base and segments else 0
        chunks, length = kept + n, (base.total_length if kept else 0) + lengths
        df = self.table("terms", whole)
        if len(whole.segments) > 1:
            df = df.groupBy("term").agg(F.sum("df").alias("df"))
        mean = df.agg(F.avg(retrieval.term_weight(F.lit(chunks), F.col("df")))).first()[0]
        whole = whole._replace(chunks=chunks, total_length=length, mean_weight=mean or 0.0)
        writer = uuid.uuid4().hex
        row = self.spark.createDataFrame([(writer, list(whole.segments), whole.chunks, whole.total_length, whole.mean_weight, whole.dim, whole.id_type, whole.vectors, whole.graphs, LAYOUT)], _MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.root}/manifest/version={whole.version}")
        if self.snapshot(whole.version) != whole:
            raise Conflict(f"version {whole.version} of {self.root} was committed by another writer")
        return whole
