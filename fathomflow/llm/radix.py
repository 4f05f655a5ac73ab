"""The first k rows of every group by radix selection, without sorting any group.

A histogram over value bits, pre-aggregated in each task, tells in which bucket of its range a group's kth largest value lies; the range
shrinks to that bucket, DIGIT_BITS at a time, until one value is left: the threshold. Rows tied at the threshold are told apart by the
UTF-8 bytes of their items in the same way, two bytes past their common prefix at a time. A range that holds SORTABLE rows
or fewer needs no further digit: what is above it and in it, k + SORTABLE rows of a group at most, is ranked.

Defined results: values are not null, and those of a group span less than 2^63; rows alike in value and item are ranked in any
order; a group with fewer than k rows is returned whole; an empty table gives no rows.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import broadcast_if_small, written

DIGIT_BITS = 12
SORTABLE = 4096


def _common(low: pd.Series, high: pd.Series) -> pd.Series:
    """Bytes that two byte strings begin with alike."""
    return pd.Series([len(os.path.commonprefix([bytes(a), bytes(b)])) for a, b in zip(low, high, strict=True)], dtype="int32")


def _crossing(counted: DataFrame, by: list[str], digit) -> DataFrame:
    """Of each group's digits, in the given order, the one that holds its row number ``need``; need and open are then those of that digit."""
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    found = counted.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
    return found.withColumn("need", F.col("need") - F.col("before")).withColumn("open", F.col("n"))


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """States with the digit of their range that holds the threshold."""
    digit = F.expr("shiftright(value - low, shift)").alias("digit")
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("high") - F.col("low"))) - DIGIT_BITS).cast("int")
    inside = rows.join(broadcast_if_small(state.withColumn("shift", shift)), by).where("value >= low and value <= high")
    found = _crossing(inside.groupBy(*by, "low", "high", "need", "shift", digit).agg(F.count("*").alias("n")), by, F.desc("digit"))
    low = F.col("low") + F.expr("shiftleft(digit, shift)")
    ends = F.least(F.col("high"), low + F.expr("shiftleft(1L, shift)") - 1)
    return found.select(*by, low.alias("low"), ends.alias("high"), "need", "open", F.lit("").cast("binary").alias("cut"))


def _refined(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """States whose ties are told apart by two bytes more; ``cut`` are the bytes that the last row taken begins with."""
    tied = rows.join(broadcast_if_small(state), by).where((F.col("value") == F.col("low")) & F.startswith(F.col("bytes"), F.col("cut")))
    ends = tied.groupBy(*by, "low", "need", "open").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    ends = written(ends.withColumn("cut", F.substring(F.col("least"), F.lit(1), F.pandas_udf(_common, T.IntegerType())("least", "most"))).drop("least", "most"), "radix-ends")
    again = rows.join(broadcast_if_small(ends), by).where((F.col("value") == F.col("low")) & F.startswith(F.col("bytes"), F.col("cut")))
    digit = F.substring(F.col("bytes"), F.octet_length("cut") + 1, F.lit(2)).alias("digit")
    found = _crossing(again.groupBy(*by, "low", "need", "cut", digit).agg(F.count("*").alias("n")), by, F.asc("digit"))
    return found.select(*by, "low", F.col("low").alias("high"), "need", "open", F.concat("cut", "digit").alias("cut"))


def top_k(rows: DataFrame, by: list[str], value: str, item: str, k: int, sortable: int = SORTABLE) -> DataFrame:
    """(by, item, value, rank) of the k first rows of each group, largest value first, then least item by UTF-8 bytes. ``rows`` is a written table."""
    given = rows.select(*by, F.col(value).alias("value"), F.col(item).alias("item"), F.col(item).cast("binary").alias("bytes"))
    state = given.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.lit(k).cast("long").alias("need"), F.count("*").alias("open"), F.lit("").cast("binary").alias("cut"))
    state = written(state, "radix-ranges")
    wide = (F.col("open") > sortable) & (F.col("open") > F.col("need"))
    while (more := state.where(wide & (F.col("low") < F.col("high")))).limit(1).count():
        state = written(state.where(~(wide & (F.col("low") < F.col("high")))).unionByName(_narrowed(given, more, by)), "radix-ranges")
    # Where a round no longer lengthens the cut, all that is open is one item.
    settled, more = state.where(~wide), state.where(wide)
    while more.limit(1).count():
        refined = written(_refined(given, more, by), "radix-ties")
        done = ~wide | (F.col("cut") == F.col("was"))
        marked = refined.join(more.select(*by, F.col("cut").alias("was")), by)
        settled, more = settled.unionByName(marked.where(done).drop("was")), written(marked.where(~done).drop("was"), "radix-open")
    taken = (F.col("value") > F.col("high")) | (F.col("value") >= F.col("low")) & ((F.col("bytes") < F.col("cut")) | F.startswith(F.col("bytes"), F.col("cut")))
    held = given.join(broadcast_if_small(written(settled, "radix-thresholds")), by).where(taken)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), F.asc("item")))
    return held.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "item", "value", "rank")
