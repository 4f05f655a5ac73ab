"""Alignment of factor and market panels in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("date", "code")


def reindexed(factor: DataFrame, market: DataFrame, value: str = "value", fill: float | None = None) -> DataFrame:
    """The factor (date, code, value) on the market's dates and codes: one row for each of the market's, null where the factor has none (or ``fill``, which replaces NaN too);
    what the market lacks is left out. Of rows that share a date and a code the largest value counts."""
    one = factor.groupBy(*AXES).agg(F.max(value).alias(value))
    joined = market.select(*AXES).distinct().join(one, list(AXES), "left")
    return joined if fill is None else joined.na.fill(fill, [value])


def inner(*panels: tuple[DataFrame, str], axes: Sequence[str] = AXES) -> DataFrame:
    """(date, code, a column a panel) of the dates and codes that all panels (date, code, value; named) have. All are dealt by the axes once."""
    first, *others = [p.select(*axes, F.col("value").alias(name)) for p, name in panels]
    for other in others:
        first = first.join(other, list(axes))
    return first


def known_pairs(factor: DataFrame, forward: DataFrame, least: int = 3) -> DataFrame:
    """(date, code, factor, forward) of dates that both panels have, with the pairs that are known on both sides, of dates with ``least`` of them."""
    both = inner((factor, "factor"), (forward, "forward")).where("factor is not null and forward is not null and not isnan(factor) and not isnan(forward)")
    enough = both.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return both.join(enough.select("date"), "date", "left_semi")
