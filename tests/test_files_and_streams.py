from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomflow.sources import files
from fathomflow.streaming import incremental

PAPER = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_json_documents_take_lists_and_objects_and_skip_broken_files(spark, tmp_path):
    (tmp_path / "papers_1.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    (tmp_path / "papers_2.json").write_text(json.dumps({"papers": [{"id": "c", "n": 3, "x": 0}]}))
    (tmp_path / "papers_3.json").write_text("{broken")
    found = files.read_json_documents(spark, f"{tmp_path}/papers_*.json", PAPER)
    assert {(r.id, r.n) for r in found.collect()} == {("a", 1), ("b", None), ("c", 3)}


def test_json_lines_skip_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b", "n": 2}\n')
    assert {r.id for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), PAPER).collect()} == {"a", "b"}


def test_reports_escape_values(spark):
    df = spark.createDataFrame([("<b>", None), ("x|y", 2)], "a string, n int")
    page = files.html_report("T<", {"rows": df}, {"s": [1.0, 2.0]})
    assert "&lt;b&gt;" in page and "<b>" not in page and "polyline" in page
    assert "x\\|y" in files.markdown_table(df)


def test_csv_has_a_mark_and_a_header(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("a", 1)], "k string, n int"), f"{tmp_path}/out")
    part = next((tmp_path / "out").glob("*.csv"))
    assert part.read_text(encoding="utf-8") == "﻿k,n\na,1\n"


def test_stream_indexes_each_chunk_once(spark, tmp_path):
    source, index, marks = (f"{tmp_path}/{x}" for x in ("in", "index", "marks"))
    schema = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("text", T.StringType())])
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i, str(i)) for i in ids], schema).write.mode("append").parquet(source)
        incremental.index_new(incremental.file_stream(spark, source, schema), index, marks).awaitTermination()
        assert sorted(r.chunk_id for r in spark.read.parquet(index).collect()) == list(range(1, max(ids) + 1))


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = incremental.file_stream(spark, f"{tmp_path}/in", events.schema)
    query = incremental.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert set(map(tuple, spark.table("counts").collect())) == set(map(tuple, batch.collect()))


def test_decoding_tries_encodings_in_order(spark):
    df = spark.createDataFrame([(bytearray("因子".encode("gbk")),), (bytearray("é".encode()),), (None,)], "b binary")
    assert [r.t for r in df.select(files.decoded(F.col("b")).alias("t")).collect()] == ["因子", "é", None]
