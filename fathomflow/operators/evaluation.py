"""Factor evaluation on long rows (date, code, factor, forward): information coefficients, quantile returns, decay, turnover.

Everything is grouped by date first (one shuffle), then over the dates; factors may be told apart by more keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 5, 10, 21, 63)
MIN_PAIRS = 3
GROUPS = 5


def with_forward(market: DataFrame, horizon: int = 21, name: str = "forward") -> DataFrame:
    """Adds the return from each row to the row ``horizon`` trading days later."""
    by_code = Window.partitionBy("code").orderBy("date")
    return market.withColumn(name, F.try_divide(F.lead("close", horizon).over(by_code), F.col("close")) - 1)


def pairs(rows: DataFrame, factor: str = "factor", forward: str = "forward") -> DataFrame:
    """Rows where both values are known."""
    return rows.where(F.col(factor).isNotNull() & F.col(forward).isNotNull())


def finite_pairs(rows: DataFrame, factor: str = "factor", forward: str = "forward") -> DataFrame:
    """Rows where both values are finite numbers."""
    for c in (factor, forward):
        rows = rows.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return pairs(rows, factor, forward)


def _pearson(x: str, y: str) -> Column:
    """Null where either side is constant. The builtin would fail there under ANSI rules."""
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(spread > 0, F.try_divide(F.covar_samp(x, y), spread))


def _average_rank(x: str, keys: Sequence[str]) -> Column:
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def ic_series(rows: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """(keys, n, ic, rank_ic) of each date with pairs; null under three pairs or for a constant side."""
    known = pairs(rows)
    ranked = known.withColumns({"_rf": _average_rank("factor", keys), "_rr": _average_rank("forward", keys)})
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), _pearson("factor", "forward").alias("ic"), _pearson("_rf", "_rr").alias("rank_ic"))
    enough = F.col("n") >= MIN_PAIRS
    return found.select(*keys, "n", F.when(enough, F.col("ic")).alias("ic"), F.when(enough, F.col("rank_ic")).alias("rank_ic"))


def ic_summary(series: DataFrame, column: str = "ic", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, ratio, t statistic, share above zero and number of the known values."""
    x = F.col(column)
    found = series.where(x.isNotNull()).groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count("*").alias("n"), F.avg((x > 0).cast("double")).alias("positive_ratio"))
    scored = found.withColumn("icir", F.try_divide("mean", "std")).withColumn("t_stat", F.try_divide(F.col("mean"), F.col("std") / F.sqrt("n")))
    return scored.withColumn("p_value", p_value(F.col("t_stat")))


def p_value(t: Column) -> Column:
    """Two-sided, by the normal approximation; the complementary error function by a rational one (to 1.5e-7)."""
    x = F.abs(t) / math.sqrt(2)
    k = 1 / (1 + 0.3275911 * x)
    series = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = (series + c) * k
    return series * F.exp(-x * x)


def with_bins(rows: DataFrame, groups: int, keys: Sequence[str] = ("date",), least: int | None = None) -> DataFrame:
    """Adds ``bin`` (1..): right-closed quantile bins of the factor per date, equal edges counted once; null if all are equal.
    Dates with fewer rows than ``least`` (two a group) are left out."""
    by = Window.partitionBy(*keys)
    points = F.array(*[F.lit(i / groups) for i in range(groups + 1)])
    edges = F.array_distinct(F.percentile("factor", points).over(by))
    with_edges = rows.withColumn("_edges", edges).withColumn("_n", F.count("*").over(by)).where(F.col("_n") >= (2 * groups if least is None else least))
    below = F.size(F.filter("_edges", lambda e: e < F.col("factor")))
    return with_edges.withColumn("bin", F.when(F.size("_edges") > 1, F.greatest(below, F.lit(1)))).drop("_edges", "_n")


def quantile_returns(rows: DataFrame, groups: int = GROUPS, zero_fill: bool = True) -> DataFrame:
    """(date, group, ret): mean forward return of each factor bin; absent bins are 0 (or absent)."""
    binned = with_bins(pairs(rows), groups)
    means = binned.groupBy("date", "bin").agg(F.avg("forward").alias("ret"))
    if not zero_fill:
        return means.where("bin is not null").select("date", F.col("bin").alias("group"), "ret")
    wide = means.groupBy("date").agg(*[F.max(F.when(F.col("bin") == g, F.col("ret"))).alias(f"_{g}") for g in range(1, groups + 1)])
    stacked = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.coalesce(F.col(f"_{g}"), F.lit(0.0)).alias("ret")) for g in range(1, groups + 1)]))
    return wide.select("date", stacked.alias("s")).select("date", "s.group", "s.ret")


def quantile_summary(returns: DataFrame) -> DataFrame:
    return returns.groupBy("group").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n"))


def long_short(returns: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(date, spread): top bin less bottom bin."""
    pick = lambda g: F.max(F.when(F.col("group") == g, F.col("ret")))
    return returns.groupBy("date").agg((pick(groups) - pick(1)).alias("spread"))


def decay(market: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(horizon, mean_ic, n): mean coefficient at each horizon, in one job over (date, code, close, factor)."""
    for h in horizons:
        market = with_forward(market, h, f"_h{h}")
    stacked = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("forward")) for h in horizons]))
    rows = market.select("date", "factor", stacked.alias("s")).select("date", "factor", "s.horizon", "s.forward")
    return ic_series(rows, ("horizon", "date")).where("ic is not null").groupBy("horizon").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n"))


def top_turnover(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(date, turnover): share of the top bin that was not in the last valid date's; 1 after an empty one, 0 on dates that are skipped."""
    known = rows.where(F.col("factor").isNotNull())
    binned = with_bins(known, groups)
    sets = binned.groupBy("date").agg(F.array_sort(F.collect_set(F.when(F.col("bin") == groups, F.col("code")))).alias("_top"))
    before = F.coalesce(F.lag("_top").over(Window.orderBy("date")), F.array().cast("array<string>"))
    kept = F.size(F.array_intersect("_top", "_before"))
    change = F.when(F.size("_before") == 0, 1.0).otherwise(1 - kept / F.greatest(F.size("_top"), F.lit(1)))
    valid = sets.withColumn("_before", before).select("date", change.alias("turnover"))
    return rows.select("date").distinct().join(valid, "date", "left").select("date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def legacy_ic(rows: DataFrame) -> DataFrame:
    """(date, ic, rank_ic) with ten finite pairs, population deviations of 1e-10 at least, and ranks by order (ties by code)."""
    known = finite_pairs(rows)
    rank = lambda c: F.row_number().over(Window.partitionBy("date").orderBy(c, "code")).cast("double")
    ranked = known.withColumns({"_rf": rank("factor"), "_rr": rank("forward")})
    found = ranked.groupBy("date").agg(F.count("*").alias("n"), F.stddev_pop("factor").alias("_s"), F.stddev_pop("forward").alias("_t"), _pearson("factor", "forward").alias("ic"), _pearson("_rf", "_rr").alias("rank_ic"))
    return found.where("n >= 10 and _s >= 1e-10 and _t >= 1e-10").select("date", "ic", "rank_ic")


def legacy_summary(series: DataFrame) -> DataFrame:
    return series.agg(F.avg("ic").alias("mean_ic"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-9)).alias("icir"), F.avg("rank_ic").alias("mean_rank_ic"), F.count("*").alias("n"))


def legacy_groups(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(group, mean_ret): mean of daily bin means, with three rows a group at least and empty bins left out."""
    binned = with_bins(finite_pairs(rows), groups, least=3 * groups).where("bin is not null")
    daily = binned.groupBy("date", "bin").agg(F.avg("forward").alias("ret"))
    return daily.groupBy(F.col("bin").alias("group")).agg(F.avg("ret").alias("mean_ret"))


def rolling_mean_ic(series: DataFrame, window: int = 12) -> DataFrame:
    """(date, rolling_ic): trailing mean over the known dates, with a third of the window (five) at least."""
    trailing = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    least = max(5, window // 3)
    return series.where("ic is not null").select("date", F.when(F.count("ic").over(trailing) >= least, F.avg("ic").over(trailing)).alias("rolling_ic"))
