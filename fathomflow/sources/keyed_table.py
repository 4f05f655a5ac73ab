"""A table of records by key that is changed by merges: rows live in folders by a hash of the key, and a merge rewrites the folders of
the changed keys alone, by dynamic partition overwrite.

A merge is joined and written aside before it replaces anything, so a failing join changes nothing; rerunning a merge gives the same table. Each
changed record carries the run and the source it came from, and when. Defined results: changes of unknown keys are left out of updates and
counted; of several changes of a key the last by ``order`` counts; null keys are not stored. The columns of the table do not hang on its rows: a file
without rows names them, in a folder that no key falls into, so they are there after a merge that stores no row, and in a table without rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import similarity
from .shared import broadcast_if_small, written

BUCKETS = 16
_BUCKET = "_bucket"
#: The folder of the file that names the columns; keys fall into those from 0 on.
_COLUMNS_BUCKET = -1

#: What a new record has where it says nothing.
RECORD_DEFAULTS: dict[str, object] = {"status": "pending", "modality": "single", "quality_score": 0, "notes": ""}
EVENT_DEFAULTS: dict[str, object] = {"session_id": "", "role": "", "content": "", "topic": "general", "tokens": 0, "source": "hot"}


def with_defaults(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Rows with missing columns and nulls filled in."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def last_by(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")


class KeyedTable:
    """The table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> KeyedTable:
        """Writes the first version; keys are distinct."""
        self._replace(rows.where(F.col(self.key).isNotNull()))
        return self

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path).drop(_BUCKET)

    def _replace(self, rows: DataFrame) -> None:
        """Replaces the folders that rows fall into, and the columns by those of rows, which are the table's and new ones."""
        placed = self._placed(rows).hint("rebalance", _BUCKET)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
        rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/{_BUCKET}={_COLUMNS_BUCKET}")

    def _of(self, changes: DataFrame) -> DataFrame:
        """The records in the folders that changes fall into."""
        touched = [r[0] for r in self._placed(changes.select(self.key)).select(_BUCKET).distinct().collect()]  # as many as there are buckets, at most
        return self.spark.read.option("mergeSchema", True).parquet(self.path).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)

    def update(self, changes: DataFrame, run_id: str, source: str, at: str, order: Sequence[Column] = (), skip_empty: bool = False) -> int:
        """Puts the non-null (or non-empty) values of changes (key and some columns, new ones too) into the records they name, with run_id, source and
        updated_at; the number of records that were found."""
        fields = [c for c in changes.columns if c != self.key]
        one = last_by(changes, self.key, order) if order else changes
        one = written(one.where(F.col(self.key).isNotNull()), "changes")
        held = self._of(one)
        told = {"run_id": run_id, "compute_source": source, "updated_at": at}
        given = one.select(self.key, F.lit(True).alias("_found"), *[(F.when(F.col(c).cast("string") != "", F.col(c)) if skip_empty else F.col(c)).alias(f"_new_{c}") for c in fields])
        joined = held.join(broadcast_if_small(given), self.key, "left")
        kinds = dict(one.dtypes)
        old = lambda c: F.col(c) if c in held.columns else F.lit(None).cast(kinds.get(c, "string"))
        values = {c: F.coalesce(F.col(f"_new_{c}"), old(c)) for c in fields} | {c: F.when(F.col("_found"), F.lit(v)).otherwise(old(c)) for c, v in told.items()}
        merged = written(joined.select(*[values.pop(c).alias(c) if c in values else F.col(c) for c in held.columns], *[v.alias(c) for c, v in list(values.items())], "_found"), "merged")
        self._replace(merged.drop("_found"))
        return merged.where("_found").count()

    def insert(self, rows: DataFrame, at: str, defaults: Mapping[str, object] = RECORD_DEFAULTS, place: str | None = None, definition: str | None = None, threshold: float = similarity.THRESHOLD, within: bool = True) -> int:
        """Adds the rows whose keys are new, of several with a key the first by ``place``, with defaults and times; the number of rows added.

        With a ``definition`` column, rows whose words are known by more than the threshold stay out, too: those of a record of the table or, ``within``
        the rows, of one that comes in before them."""
        fresh = rows.where(F.col(self.key).isNotNull())
        if place:
            fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(place))).where("_n = 1").drop("_n")
        table = self.read()
        fresh = written(fresh.join(table.select(self.key), self.key, "left_anti"), "fresh")
        if definition:
            named = lambda t, *more: t.select(F.col(self.key).alias("id"), F.col(definition).alias("text"), *more)
            known = similarity.overlapping(named(fresh), named(table), threshold).select(F.col("id").alias(self.key))
            fresh = written(fresh.join(known, self.key, "left_anti"), "fresh")
            if within:
                order = F.col(place) if place else F.col(self.key)
                some = similarity.first_of_similar(named(fresh, order.alias("place")), threshold)
                fresh = fresh.join(some.select(F.col("id").alias(self.key)), self.key, "left_semi")
        added = written(with_defaults(fresh, defaults).withColumns({"added_at": F.lit(at), "updated_at": F.lit(at)}), "added")
        self._replace(self._of(added).unionByName(added.drop(*([place] if place and place not in table.columns else [])), allowMissingColumns=True).transform(lambda t: written(t, "merged")))
        return added.count()


def append_records(records: DataFrame, path: str, at: str = "ts", now: str | None = None, defaults: Mapping[str, object] = EVENT_DEFAULTS) -> None:
    """Appends event records with their defaults to a table by month; a record without a time gets ``now``."""
    timed = records.withColumn(at, F.coalesce(F.col(at).cast("timestamp"), F.to_timestamp(F.lit(now))) if at in records.columns else F.to_timestamp(F.lit(now)))
    with_defaults(timed, defaults).withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
