"""Performance of a return series (date, ret): one row a trading day, so its windows run over few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 252


def _past():
    return Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def growth(ret: Column, over=None) -> Column:
    """The product of 1 + ret, as an aggregate or over a window: zero after a total loss, and negative after a larger one."""
    part = (lambda c: c) if over is None else (lambda c: c.over(over))
    x = 1 + ret
    size = F.exp(F.coalesce(part(F.sum(F.when(x != 0, F.ln(F.abs(x))))), F.lit(0.0)))
    sign = F.when(part(F.count_if(x < 0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(part(F.count_if(x == 0)) > 0, 0.0).otherwise(sign * size)


def equity_curve(returns: DataFrame) -> DataFrame:
    """Adds ``equity`` (starting from 1) and ``drawdown`` (at most 0)."""
    curve = returns.withColumn("equity", growth(F.col("ret"), _past()))
    return curve.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(_past()), F.lit(1.0)) - 1)


def performance(returns: DataFrame, periods: int = PERIODS) -> DataFrame:
    """One record: annual return and volatility, Sharpe, Sortino, drawdown with its length, Calmar, win rate, total."""
    r = F.col("ret")
    curve = equity_curve(returns).withColumn("_i", F.row_number().over(Window.orderBy("date")))
    trough = F.min_by("_i", F.struct("drawdown", "_i"))
    totals = curve.agg(
        F.count("*").alias("n"), growth(r).alias("_growth"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.count_if(r < 0).alias("_losses"), F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"), trough.alias("_trough"), F.count_if(r > 0).alias("_wins"),
    )
    after = curve.join(F.broadcast(totals.select("_trough")), F.col("_i") >= F.col("_trough")).agg(F.count("*").alias("_after"), F.count_if(F.col("drawdown") >= 0).alias("_healed"))
    both = totals.join(F.broadcast(after))
    annual = F.when((F.col("n") > 0) & (F.col("_growth") >= 0), F.pow("_growth", F.lit(periods) / F.col("n")) - 1).otherwise(0.0)
    volatility = F.coalesce(F.col("_std"), F.lit(0.0)) * periods**0.5
    sharpe = F.when(volatility < 1e-12, 0.0).otherwise(F.try_divide(F.col("_mean") * periods, volatility))
    no_loss = F.when(F.col("_mean") > 0, F.col("_mean") * periods**0.5 / 1e-8).otherwise(0.0)
    down = F.coalesce(F.col("_down"), F.lit(0.0))
    sortino = F.when(F.col("_losses") == 0, no_loss).when(down == 0, 0.0).otherwise(F.try_divide(F.col("_mean") * periods, down * periods**0.5))
    found = both.select(
        "n", annual.alias("annual_return"), volatility.alias("annual_volatility"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.coalesce(sortino, F.lit(0.0)).alias("sortino"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        F.when(F.col("_healed") > 0, F.col("_after") - F.col("_healed") + 1).otherwise(F.col("_after")).alias("drawdown_days"),
        F.coalesce(F.try_divide(F.col("_wins"), F.col("n")), F.lit(0.0)).alias("win_rate"), (F.coalesce("_growth", F.lit(1.0)) - 1).alias("total_return"),
    )
    return found.withColumn("calmar", F.coalesce(F.try_divide("annual_return", F.abs("max_drawdown")), F.lit(0.0)))


def monthly_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg((growth(F.col("ret")) - 1).alias("ret"))


def monthly_matrix(monthly: DataFrame) -> DataFrame:
    """(year, m1..m12): missing months are 0."""
    split = monthly.select(F.substring("month", 1, 4).cast("int").alias("year"), F.substring("month", 6, 2).cast("int").alias("m"), "ret")
    return split.groupBy("year").agg(*[F.coalesce(F.max(F.when(F.col("m") == m, F.col("ret"))), F.lit(0.0)).alias(f"m{m}") for m in range(1, 13)])


def rolling_performance(returns: DataFrame, window: int = 63, periods: int = PERIODS) -> DataFrame:
    """(date, annual_return, annual_volatility, sharpe) over trailing full windows."""
    trailing = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    grown = growth(F.col("ret"), trailing)
    spread = F.stddev_samp("ret").over(trailing) * periods**0.5
    rows = returns.select("date", F.count("*").over(trailing).alias("_n"), (F.pow(grown, F.lit(periods / window)) - 1).alias("annual_return"), spread.alias("annual_volatility"), (F.avg("ret").over(trailing) * periods / (spread + 1e-8)).alias("sharpe"))
    return rows.where(F.col("_n") >= window).drop("_n")


def rolling_correlation_ic(rows: DataFrame, window: int = 12, least: int = 10) -> DataFrame:
    """(code, date, ic, cumulative): correlation of a code's factor and forward over the ``window`` rows before each row, and its running sum."""
    by_code = Window.partitionBy("code").orderBy("date")
    before = by_code.rowsBetween(-window, -1)
    known = F.when(F.col("factor").isNotNull() & F.col("forward").isNotNull(), F.lit(1))
    f, g = F.when(known == 1, F.col("factor")), F.when(known == 1, F.col("forward"))
    spread = F.stddev_samp(f).over(before) * F.stddev_samp(g).over(before)
    ic = F.when((F.count(known).over(before) >= least) & (spread > 0), F.covar_samp(f, g).over(before) / spread)
    return rows.select("code", "date", ic.alias("ic")).withColumn("cumulative", F.sum(F.coalesce("ic", F.lit(0.0))).over(by_code.rowsBetween(Window.unboundedPreceding, 0)))
