"""Streamed call rates against the batch window, event by event."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from fathomflow.operators import records
from fathomflow.streaming import incremental, rate_limit


def test_rates_equal_the_batch_window_with_late_rows(spark, tmp_path):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, f"u{rng.randrange(4)}", start + datetime.timedelta(seconds=rng.randrange(600), microseconds=rng.choice([0, 0, 250_000, 999]))) for i in range(120)]
    events += [(200 + i, "u0", start + datetime.timedelta(seconds=77)) for i in range(5)]  # at one time
    events += [(900, "u1", start + datetime.timedelta(days=1))]  # moves the watermark past all
    schema = "event_id long, user string, ts timestamp"
    # Rows come out of order, two minutes at most, in files of their own.
    late = sorted(events[:-1], key=lambda e: e[2] + datetime.timedelta(seconds=rng.randrange(100)))
    for part in [late[i : i + 40] for i in range(0, len(late), 40)] + [events[-1:]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        calls = rate_limit.calls_in_window(stream, "user", "ts", "event_id", 60, late="2 minutes")
        calls.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    got = {r.event_id: r.recent for r in found.collect()}
    batch = records.calls_in_window(spark.createDataFrame(events, schema), "user", "ts", 60)
    want = {r.event_id: r.recent for r in batch.where("event_id <> 900").collect()}
    assert got == want and found.count() == len(want)
    assert {r.event_id for r in rate_limit.over_limit(found, 8).collect()} == {i for i, n in want.items() if n > 8}
    assert found.where(F.col("at").isNull()).count() == 0
