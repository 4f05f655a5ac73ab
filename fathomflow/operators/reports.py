"""Evaluation records, report summaries and chart series: one row, one row, and a long table of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import evaluation, metrics

#: More known coefficients than this make an evaluation valid.
LEAST_POINTS = 10
#: Columns of a record that hold more than one value.
NESTED = ("quantile_returns", "ic_series", "rank_ic_series")


def evaluation_record(rows: DataFrame, name: str, groups: int = evaluation.GROUPS) -> DataFrame:
    """One row that evaluates a factor, from (date, code, close, factor, forward): coefficients, group returns in percent, turnover and decay, the mean
    return of every group, and the series of coefficients with their dates; status is ok from eleven known coefficients on. The rows and the series are
    computed once."""
    rows = written(rows.select("date", "code", "close", "factor", "forward"), "evaluation-rows")
    series = written(evaluation.ic_series(rows), "evaluation-series")
    ranks = evaluation.ic_summary(series, "rank_ic").select(F.col("mean").alias("rank_ic"))
    pick = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("mean_ret"))), F.lit(0.0)) * 100
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("Q"), F.col("group")), F.col("mean_ret")))))
    means = evaluation.quantile_summary(evaluation.quantile_returns(rows, groups)).agg(pick(groups).alias("top_return"), pick(1).alias("bottom_return"), each.alias("quantile_returns"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("date"), F.round(c, 4).alias("value"))))).alias(f"{c}_series")
    lists = series.agg(listed("ic"), listed("rank_ic"))
    turnover = evaluation.top_turnover(rows, groups).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("mean_turnover"))
    horizons = evaluation.decay(rows).agg(*[F.max(F.when(F.col("horizon") == h, F.col("mean_ic"))).alias(f"decay_{h}") for h in evaluation.HORIZONS])
    one = evaluation.ic_summary(series)
    for other in (ranks, means, turnover, horizons, lists):  # each has one row
        one = one.join(F.broadcast(other))
    zero = lambda c, to: F.coalesce(c, F.lit(0.0)).alias(to)
    return one.select(
        F.lit(name).alias("factor_name"), zero("mean", "ic"), zero("icir", "icir"), zero("rank_ic", "rank_ic"), "top_return", "bottom_return", (F.col("top_return") - F.col("bottom_return")).alias("top_minus_bottom"),
        zero("positive_ratio", "win_rate"), zero("t_stat", "t_stat"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.col("n").alias("data_points"), "mean_turnover", *[f"decay_{h}" for h in evaluation.HORIZONS],
        F.when(F.col("n") > LEAST_POINTS, "ok").otherwise("insufficient_data").alias("status"), *NESTED,
    )


def record_details(records: DataFrame) -> DataFrame:
    """(part, key, value): the group returns and series of evaluation records, a row each."""
    groups = records.select(F.explode("quantile_returns").alias("key", "value")).select(F.lit("quantile").alias("part"), "key", "value")
    for kind in ("ic", "rank_ic"):
        points = records.select(F.explode(f"{kind}_series").alias("p"))
        groups = groups.unionByName(points.select(F.lit(kind).alias("part"), F.col("p.date").cast("string").alias("key"), F.col("p.value").alias("value")))
    return groups


def report_summary(records: DataFrame, performance: DataFrame) -> DataFrame:
    """One row: how many factors, the mean coefficient of the valid ones, and the strategy's performance."""
    counts = records.agg(F.count("*").cast("int").alias("n_factors"), F.round(F.avg(F.when(F.col("status") == "ok", F.col("ic"))), 4).alias("mean_ic"))
    return counts.join(F.broadcast(performance))


def chart_series(returns: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(chart, x, series, y): equity and drawdown by date, months in percent by year (missing ones are 0), a factor's coefficients,
    group returns and decay."""
    curve = metrics.equity_curve(returns)
    months = metrics.monthly_matrix(metrics.monthly_returns(returns))
    cells = F.explode(F.array(*[F.struct(F.lit(f"{m:02d}").alias("x"), F.col(f"m{m}").alias("y")) for m in range(1, 13)])).alias("cell")
    value = lambda c, digits: (F.round(c, digits) + F.lit(0.0)).alias("y")
    parts = [
        curve.select(F.lit("equity").alias("chart"), F.col("date").cast("string").alias("x"), F.lit("").alias("series"), value("equity", 6)),
        curve.select(F.lit("drawdown").alias("chart"), F.col("date").cast("string").alias("x"), F.lit("").alias("series"), value("drawdown", 6)),
        months.select(F.col("year").cast("string").alias("series"), cells).select(F.lit("month").alias("chart"), F.col("cell.x").alias("x"), "series", value(F.col("cell.y") * 100, 2)),
        evaluation.ic_series(rows).where("ic is not null").select(F.lit("ic").alias("chart"), F.col("date").cast("string").alias("x"), F.lit(name).alias("series"), value("ic", 4)),
        evaluation.quantile_summary(evaluation.quantile_returns(rows)).select(F.lit("quantile").alias("chart"), F.concat(F.lit("Q"), F.col("group")).alias("x"), F.lit(name).alias("series"), value("mean_ret", 6)),
        evaluation.decay(rows).select(F.lit("decay").alias("chart"), F.col("horizon").cast("string").alias("x"), F.lit(name).alias("series"), value("mean_ic", 6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
