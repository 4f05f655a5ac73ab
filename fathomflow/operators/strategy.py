"""Rule-based portfolios without a daily loop: weights depend on factors alone, so a strategy is windows and joins.

Weights are set on rebalance dates and held until the next; a rebalance date with too few factors keeps what was
held. Nothing feeds back from equity into weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .evaluation import with_bins


@dataclass(frozen=True)
class StrategyConfig:
    """Rules of a portfolio; weighting is equal, cap or risk_parity, frequency daily, weekly, monthly or quarterly."""

    groups: int = 5
    top_group: int = 0
    long_short: bool = False
    weighting: str = "equal"
    frequency: str = "monthly"
    max_weight: float = 0.0
    cost_bps: float = 10.0
    slippage_bps: float = 5.0

    @property
    def cost_rate(self) -> float:
        return (self.cost_bps + self.slippage_bps) / 1e4


def rebalance_dates(dates: DataFrame, frequency: str = "monthly") -> DataFrame:
    """(date): the first date, and each whose period differs from the date before; unknown frequencies are monthly."""
    period = {"weekly": F.weekofyear, "quarterly": F.quarter}.get(frequency, F.month)
    ordered = dates.select("date").distinct()
    if frequency == "daily":
        return ordered
    before = F.lag(period("date")).over(Window.orderBy("date"))
    return ordered.withColumn("_changed", before.isNull() | (before != period("date"))).where("_changed").select("date")


def expanding_volatility(market: DataFrame) -> DataFrame:
    """Adds ``vol``: deviation of a code's returns so far; 1 on the first date."""
    past = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return market.withColumn("vol", F.coalesce(F.stddev_samp("ret").over(past), F.lit(1.0)))


def _leg_weight(weighting: str, by: Window) -> Column:
    equal = 1 / F.count("*").over(by)
    if weighting == "cap":
        total = F.sum(F.coalesce("market_cap", F.lit(0.0))).over(by)
        return F.when(total > 0, F.coalesce("market_cap", F.lit(0.0)) / total).otherwise(equal)
    if weighting == "risk_parity":
        inverse = 1 / (F.col("vol") + 1e-8)
        return F.coalesce(F.try_divide(inverse, F.sum(inverse).over(by)), equal)
    return equal


def clip_weights(weight: Column, most: float) -> Column:
    """Weights above the limit are cut and the rest stays cash; without a limit they are as given."""
    return F.least(weight, F.lit(float(most))) if most > 0 else weight


def target_weights(market: DataFrame, config: StrategyConfig) -> DataFrame:
    """(date, code, weight) of each rebalance date with factors enough; a date without a top bin has one row without a code."""
    calendar = rebalance_dates(market, config.frequency)
    priced = expanding_volatility(market) if config.weighting == "risk_parity" else market
    chosen = with_bins(priced.join(calendar, "date", "left_semi").where("factor is not null"), config.groups)
    top = config.top_group if config.top_group > 0 else config.groups
    by = Window.partitionBy("date")
    long = chosen.where(F.col("bin") == top).withColumn("weight", clip_weights(_leg_weight(config.weighting, by), config.max_weight)).select("date", "code", "weight")
    legs = long
    if config.long_short:
        kind = "equal" if config.weighting == "risk_parity" else config.weighting
        short = chosen.where(F.col("bin") == 1).withColumn("weight", -clip_weights(_leg_weight(kind, by), config.max_weight)).select("date", "code", "weight")
        legs = long.unionByName(short).groupBy("date", "code").agg(F.sum("weight").alias("weight"))
    empty = chosen.select("date").distinct().join(legs.select("date").distinct(), "date", "left_anti")
    return legs.unionByName(empty.select("date", F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("weight")))


def trades(weights: DataFrame, market: DataFrame, config: StrategyConfig) -> DataFrame:
    """(date, turnover, cost) of each date that sets weights: half and all of the change in weights. The last day sets none."""
    set_dates = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    now = weights.where("code is not null").select("date", "code", F.col("weight").alias("delta"))
    gone = weights.where("code is not null").join(set_dates, "date").where("next is not null").select(F.col("next").alias("date"), "code", (-F.col("weight")).alias("delta"))
    change = now.unionByName(gone).groupBy("date", "code").agg(F.abs(F.sum("delta")).alias("moved")).groupBy("date").agg(F.sum("moved").alias("moved"))
    found = set_dates.select("date").join(change, "date", "left").select("date", F.coalesce("moved", F.lit(0.0)).alias("moved"))
    return found.select("date", (F.col("moved") / 2).alias("turnover"), (F.col("moved") * config.cost_rate).alias("cost"))


def run_strategy(market: DataFrame, config: StrategyConfig = StrategyConfig()) -> DataFrame:
    """(date, ret, turnover, cost, equity, drawdown): each day's weights times the same day's returns, less the cost of a rebalance."""
    from .metrics import equity_curve

    # The panel and the weights are read many times below; each is computed once.
    market = written(market.select("date", "code", "ret", "factor", *(c for c in ("market_cap",) if c in market.columns)), "strategy-panel")
    dates = market.select("date").distinct()
    last = dates.agg(F.max("date").alias("last"))
    weights = target_weights(market, config).join(F.broadcast(last), F.col("date") < F.col("last")).drop("last")
    weights = written(weights, "strategy-weights")
    sets = weights.select("date").distinct()
    marked = dates.join(sets.withColumn("set_date", F.col("date")), "date", "left")
    held = marked.select("date", F.last("set_date", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("set_date"))
    position = market.select("date", "code", "ret").join(held, "date").join(weights.select(F.col("date").alias("set_date"), "code", "weight"), ["set_date", "code"])
    gross = position.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    first = dates.agg(F.min("date").alias("first"))
    costs = trades(weights, market, config).join(F.broadcast(first)).select("date", "turnover", F.when(F.col("date") > F.col("first"), F.col("cost")).otherwise(0.0).alias("cost"))
    daily = dates.join(gross, "date", "left").join(costs, "date", "left").select("date", (F.coalesce("gross", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0))).alias("ret"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    return equity_curve(daily)
