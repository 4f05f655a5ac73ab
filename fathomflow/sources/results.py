"""Result and session files: one JSON document a run or session, in any of the known encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import decoded


def write_results(results: DataFrame, path: str, run: str = "run_id") -> None:
    """One folder a run (run=<id>) with a document a row; runs that are written again replace theirs, others stay."""
    placed = results.hint("rebalance", run)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy(run).json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, run: str = "run_id") -> DataFrame:
    """Rows of all runs with the given fields and the run's name as a string: unknown fields are left out, missing ones are null, documents that
    are broken are left out."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    asked = T.StructType([*fields.fields, T.StructField(run, T.StringType())])
    return spark.read.schema(asked).option("mode", "DROPMALFORMED").json(path)


def read_sessions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, session) of files with one JSON document each (.json) or one a line (.jsonl), whatever their encoding; what is no JSON is left out."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"))
    text = F.regexp_replace("text", "^﻿", "")
    lines = F.when(F.col("file").endswith(".jsonl"), F.split(text, "\n")).otherwise(F.array(text))
    documents = files.where("text is not null").select("file", F.explode(lines).alias("document"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    # A broken document gives a row of nulls; one that is an object has a length.
    whole = F.get_json_object("document", "$").isNotNull() & F.startswith(F.ltrim(F.col("document")), F.lit("{"))
    return documents.where(whole).select("file", F.from_json("document", kind).alias("session")).where("session is not null")
