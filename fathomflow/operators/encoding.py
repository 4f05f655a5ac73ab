"""Dense encoders as plug-ins: batch inference with one model a worker, and a cache by content.

A text is known by the digest of the model's name and the text, so equal texts are encoded once, whoever asks. What a cache table lacks is found by an anti
join, encoded in Arrow batches and appended; the vectors are then joined back. A rerun after a lost executor may append a vector twice; readers
take one a key. Defined results: a null text has a null vector; an empty text is encoded like others."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches
from .retrieval import HASH_DIM, TOKEN

#: Texts that a model sees at once.
BATCH = 64
#: Tokens whose places an encoder remembers.
KNOWN_TOKENS = 200_000
_models: dict[str, Encoder] = {}


class Encoder(Protocol):
    """Rows of numbers for texts, all of one length."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Counts of hashed tokens, scaled to length 1; needs no model."""

    def __init__(self, dim: int = HASH_DIM):
        self.dim, self.token = dim, re.compile(TOKEN)
        self._places: dict[str, int] = {}

    def _place(self, token: str) -> int:
        """The token's component; each is hashed once, as long as no more than KNOWN_TOKENS are held."""
        place = self._places.get(token)
        if place is None:
            if len(self._places) >= KNOWN_TOKENS:
                self._places.clear()
            place = self._places[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return place

    def encode(self, texts: list[str]) -> np.ndarray:
        found = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            found[i] = np.bincount([self._place(t) for t in self.token.findall(text)] or np.zeros(0, np.int64), minlength=self.dim)
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        return found / np.where(norms > 0, norms, 1)


def _encoding(name: str, load: Callable[[], Encoder]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                # A worker serves many tasks; its model is loaded by the first that has a text for it.
                if name not in _models:
                    _models[name] = load()
                rows = np.asarray(_models[name].encode(part.column("text").to_pylist()), np.float64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("digest"), vectors], names=["digest", "vector"])

    return run


def _cached(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("digest binary, vector array<double>").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, vector array<double>")


def encode(texts: DataFrame, name: str, load: Callable[[], Encoder], cache: str) -> DataFrame:
    """Rows (with a column text) and their ``vector``. ``load`` makes the model that ``name`` stands for; ``cache`` is a folder that all executors share."""
    spark = bounded_batches(texts.sparkSession)
    digest = F.unhex(F.sha2(F.concat(F.lit(f"{name}\n"), F.col("text")), 256))
    keyed = texts.withColumn("digest", digest)
    wanted = keyed.where("digest is not null").select("digest", "text")
    lacking = wanted.join(_cached(spark, cache).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    lacking.mapInArrow(_encoding(name, load), "digest binary, vector array<double>").write.mode("append").parquet(cache)
    vectors = _cached(spark, cache).dropDuplicates(["digest"])
    return keyed.join(vectors, "digest", "left").drop("digest")
