"""Result and session files, alignment, and the synthetic market's parameters."""

from __future__ import annotations

import datetime
import json
import math

from pyspark.sql import functions as F

from fathomflow.operators import align
from fathomflow.sources import market, results


def test_sessions_in_any_encoding(spark, tmp_path):
    one = {"session_id": "因子", "state": {"n": 1}}
    for name, encoding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "gbk")):
        (tmp_path / f"{name}.json").write_bytes(json.dumps({**one, "extra": name}, ensure_ascii=False).encode(encoding))
    (tmp_path / "d.jsonl").write_text('{"session_id": "x"}\nbroken\n\n{"session_id": "y", "state": null}\n[1]\n')
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.json").write_text("")
    found = results.read_sessions(spark, f"{tmp_path}/*.json*", "session_id string, state struct<n: int>").collect()
    assert sorted(r.session.session_id for r in found) == ["x", "y", "因子", "因子", "因子"]
    assert sorted(r.session.state.n for r in found if r.session.state) == [1, 1, 1]


def test_results_are_read_back_by_run(spark, tmp_path):
    rows = [("r1", "f", 0.1, [1.0, 2.0]), ("r1", "g", None, None), ("2024-01", "f", 0.3, [])]
    table = spark.createDataFrame(rows, "run_id string, factor string, ic double, series array<double>")
    results.write_results(table, f"{tmp_path}/out")
    schema = "factor string, ic double, series array<double>, later string"
    found = {(r.run_id, r.factor): (r.ic, r.series, r.later) for r in results.read_results(spark, f"{tmp_path}/out", schema).collect()}
    assert found == {(r, f): (ic, s, None) for r, f, ic, s in rows}
    results.write_results(table.where("run_id = 'r1' and factor = 'f'").withColumn("ic", F.lit(9.0)), f"{tmp_path}/out")
    again = {(r.run_id, r.factor): r.ic for r in results.read_results(spark, f"{tmp_path}/out", schema).collect()}
    assert again == {("r1", "f"): 9.0, ("2024-01", "f"): 0.3}
    (tmp_path / "out" / "run_id=bad").mkdir()
    (tmp_path / "out" / "run_id=bad" / "x.json").write_text("{broken\n")
    assert results.read_results(spark, f"{tmp_path}/out", schema).count() == 2


def test_alignment(spark):
    day = lambda i: datetime.date(2024, 1, i)
    factor = spark.createDataFrame([(day(1), "a", 1.0), (day(1), "b", float("nan")), (day(2), "a", 2.0), (day(9), "a", 3.0), (day(1), "c", 4.0), (day(1), "d", 5.0), (day(1), "e", 6.0)], "date date, code string, value double")
    market_rows = spark.createDataFrame([(day(i), c, 1.0) for i in (1, 2, 3) for c in "abcde"], "date date, code string, value double")
    on_market = {(r.date.day, r.code): r.value for r in align.reindexed(factor, market_rows).collect()}
    assert len(on_market) == 15 and on_market[2, "a"] == 2.0 and on_market[3, "e"] is None and math.isnan(on_market[1, "b"])
    assert align.reindexed(factor, market_rows, fill=0.0).where("value = 0").count() == 10
    assert {(r.date.day, r.code) for r in align.known_pairs(factor, market_rows).collect()} == {(1, c) for c in "acde"}


def test_synthetic_returns_have_the_asked_parameters(spark):
    spec = market.Synthetic(days=1000, codes=40, drift=0.1, volatility=0.25, ic=0.0, seed=3)
    rows = market.with_returns(market.synthetic_rows(spark, spec)).withColumn("step", F.ln(1 + F.col("ret"))).where("ret <> 0")
    got = rows.agg(F.stddev_samp("step").alias("s"), F.avg("step").alias("m"), F.skewness("step").alias("skew"), F.kurtosis("step").alias("kurt"), F.count("*").alias("n")).first()
    assert abs(got.s * math.sqrt(252) - 0.25) < 0.005 and abs(got.m * 252 - 0.1) < 4 * 0.25 * math.sqrt(252 / got.n)
    assert abs(got["skew"]) < 0.05 and abs(got["kurt"]) < 0.1
    dates = [r.date for r in market.synthetic_rows(spark, market.Synthetic(days=7, codes=1)).orderBy("date").collect()]
    assert [d.isoformat() for d in dates] == ["2023-01-02", "2023-01-03", "2023-01-04", "2023-01-05", "2023-01-06", "2023-01-09", "2023-01-10"]
    # With an exposure, final prices follow it.
    led = market.Synthetic(days=400, codes=60, drift=0.0, volatility=0.01, ic=0.5)
    last = market.synthetic_rows(spark, led).groupBy("code").agg(F.max_by("close", "date").alias("close"))
    exposure = spark.range(60).select(F.concat(F.lit("STK"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("code"), market._normal(led.seed, "exposure", F.col("id")).alias("x"))
    assert last.join(exposure, "code").agg(F.corr(F.ln("close"), "x").alias("c")).first().c > 0.9
    assert market.synthetic_rows(spark, led).exceptAll(market.synthetic_rows(spark, led)).count() == 0
