"""Built-in factors by name, and a registry of own ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import FormulaError, _guarded, _trailing, compute as compute_formula

# Trading days of the periods that names end in.
PERIODS = {"1m": 21, "3m": 63, "6m": 126, "1y": 252}

Builder = Callable[[DataFrame], DataFrame]
_registered: dict[str, Builder] = {}


def register(name: str, builder: Builder) -> None:
    """Adds a factor: a function that adds ``value`` to a panel."""
    _registered[name] = builder


def compute(market: DataFrame, name: str, period: int | None = None) -> DataFrame:
    """Adds ``value`` to a panel: a registered factor, return_*, volatility_* or turnover_*; zeros for any other name."""
    if name in _registered:
        return _registered[name](market)
    kind, _, suffix = name.partition("_")
    n = period or PERIODS.get(suffix, 21)
    if kind == "return":
        return compute_formula(market, f"pct_change(close, {n})")
    if kind == "volatility":
        return market.withColumn("value", _guarded(n, F.col("ret"), F.stddev_samp("ret").over(_trailing(n)), n))
    if kind == "turnover":
        volume = F.col("volume") if "volume" in market.columns else F.lit(0.0)
        return market.withColumn("value", _guarded(n, volume, F.avg(volume).over(_trailing(n)), n))
    return market.withColumn("value", F.lit(0.0))


def resolve(market: DataFrame, name: str, formula: str | None) -> tuple[DataFrame | None, str]:
    """(panel with value, source): the formula if it compiles, else a built-in factor with any value but 0, else none."""
    if formula:
        try:
            return compute_formula(market, formula), "formula"
        except FormulaError:
            pass
    built = compute(market, name)
    largest = built.agg(F.max(F.abs("value"))).first()[0]
    return (built, "builtin") if largest else (None, "no_compute_path")
