"""Formula language, rules, providers, chunking, metrics: errors and small cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomflow.functions import formula
from fathomflow.operators import evaluation, factors, metrics, records, retrieval, rules
from fathomflow.sources import market


@pytest.mark.parametrize("text", ["", "  ", "close +", "__import__('os')", "close.x", "close[0]", "close > 1", "[close]", "lambda: 1", "eval(close)", "'a'", "True", "rolling_mean(close, volume)", "rolling_mean()", "cs_rank(close, 2)", "rolling_mean(close, m=2)", "1 + 2", "nothing + close", "1 / 0 + close"])
def test_formulas_that_are_refused(spark, text):
    with pytest.raises(formula.FormulaError):
        formula.compute(market.providers.load("synthetic", spark, spec=market.Synthetic(days=3, codes=2)), text).collect()


def test_equal_parts_of_formulas_share_a_column(spark):
    panel = market.providers.load("synthetic", spark, spec=market.Synthetic(days=30, codes=3))
    both = formula.compute_all(panel, {"a": "cs_rank(rolling_mean(close, 5))", "b": "rolling_mean(close, 5) * 2"})
    assert both.columns == [*panel.columns, "a", "b"]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("avg(") == 1
    assert formula.inputs_of("cs_rank(volume) + close + open") == ["close", "open", "volume"]
    assert formula.missing_inputs("volume + close", ["close"]) == ["volume"]


def test_missing_volume_and_cap_have_defaults(spark):
    panel = market.providers.load("synthetic", spark, spec=market.Synthetic(days=3, codes=2)).drop("volume", "market_cap")
    assert {r.value for r in formula.compute(panel, "cs_rank(close) * 0 + volume + market_cap").collect()} == {1.0}


def test_local_provider_round_trip(spark, tmp_path):
    rows = market.synthetic_rows(spark, market.Synthetic(days=5, codes=3))
    market.write_local(rows, str(tmp_path))
    again = market.providers.load("local", spark, folder=str(tmp_path))
    assert again.count() == 15 and again.where("ret is null").count() == 0
    with pytest.raises(ValueError):
        market.providers.load("absent", spark)


def test_factor_resolution_and_registry(spark):
    panel = market.providers.load("synthetic", spark, spec=market.Synthetic(days=30, codes=3))
    factors.register("twice", lambda m: m.withColumn("value", F.col("close") * 2))
    assert factors.resolve(panel, "twice", None)[1] == "builtin"
    assert factors.resolve(panel, "x", "rolling_mean(close, 3)")[1] == "formula"
    assert factors.resolve(panel, "x", "eval(1)")[1] == "no_compute_path"


def test_perfect_factor_has_a_coefficient_of_one(spark):
    rows = spark.createDataFrame([(d, f"S{c}", float(c), c * 0.01) for d in range(5) for c in range(5)], "date int, code string, factor double, forward double")
    assert all(abs(r.ic - 1) < 1e-9 and abs(r.rank_ic - 1) < 1e-9 for r in evaluation.ic_series(rows).collect())
    constant = rows.withColumn("factor", F.lit(1.0))
    assert all(r.ic is None for r in evaluation.ic_series(constant).collect())
    ts = [0.0, 0.3, -1.96, 2.5, 6.0]
    found = spark.createDataFrame([(t,) for t in ts], "t double").select(evaluation.p_value(F.col("t")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(abs(t) / math.sqrt(2))) < 1e-6 for t, r in zip(ts, found, strict=True))


def test_a_total_loss_stays_total(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, -1.0), (3, 0.1)], "date int, ret double")
    assert [round(r.equity, 9) for r in metrics.equity_curve(rows).orderBy("date").collect()] == [1.1, 0.0, 0.0]
    found = metrics.performance(rows).first()
    assert (found.total_return, found.max_drawdown, found.annual_return) == (-1.0, -1.0, -1.0)
    assert abs(metrics.performance(spark.createDataFrame([(1, -1.5), (2, -1.5)], "date int, ret double")).first().total_return + 0.75) < 1e-9


@pytest.mark.parametrize("rule", ["a >", "(a > 1", "a > b", "1 > a", "a > 1 )", "a ! 1", ""])
def test_rules_that_are_refused(spark, rule):
    with pytest.raises(rules.RuleError):
        rules.compile_rule(rule, ["a"])


def test_rules(spark):
    rows = spark.createDataFrame([(1, True), (5, False), (None, None)], "a int, b boolean")
    found = rows.select(rules.first_match([("not b and a >= 5", "x"), ("a == 1 or missing > 0", "y"), ("(a < 1)", "z")], rows.columns).alias("r")).collect()
    assert [r.r for r in found] == ["x" if i == 1 else "y" if i == 0 else "z" for i in range(3)]


def test_windows_cover_a_text_and_end():
    text = "".join(f"Sentence {i} is here. " for i in range(300)) + "$" * 500
    spans = retrieval.window_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b <= a + 800 for a, b in spans) and all(c <= b for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert retrieval.window_spans("") == []


def test_versions_of_tables(spark):
    table = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "k string, s string, n int")
    changes = spark.createDataFrame([("a", "new"), ("c", "new")], "k string, s string")
    assert {tuple(r) for r in records.update(table, changes, "k").collect()} == {("a", "new", 1), ("b", "old", 2)}
    assert {r.k for r in records.insert_new(table, changes, "k").collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_exact_dense_search_in_blocks(spark, metric):
    """More queries than one matrix holds, copies that tie, and vectors that take no part."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x[50:90] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8)]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    found = retrieval.dense_top_k(table.withColumnRenamed("chunk_id", "query_id"), table, 5, metric=metric, together=150)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()}
    assert len(got) == 400 * 5
    for q in range(400):
        score = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(axis=1)
        for n, i in enumerate(np.lexsort((np.arange(400), -np.round(score, 9)))[:5], 1):
            assert got[q, n][0] == i and abs(got[q, n][1] - score[i]) < 1e-12
