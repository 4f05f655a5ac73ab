"""Record stores without mutation in place: every change is a join that gives the next version of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_any_case(columns: Sequence[str], keyword: str) -> Column:
    """Whether the text of the columns, joined by blanks, holds the keyword in any case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(keyword.lower()))


def keyword_score(text: Column, words: Sequence[str]) -> Column:
    """How many of the words a text holds."""
    lower = F.lower(text)
    return sum((F.when(F.contains(lower, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose keys it lacks."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def add_papers(table: DataFrame, papers: DataFrame, status: str = "new") -> DataFrame:
    """The table of papers with new ones (paper_id, place and further columns) of the given status: known ids stay as they are, and of
    several new rows of an id the first place counts."""
    first = first_by(papers, ["paper_id"], [F.col("place")]).drop("place").withColumn("status", F.lit(status))
    return insert_new(table, first, "paper_id")


def update(table: DataFrame, changes: DataFrame, key: str, skip_empty: bool = False) -> DataFrame:
    """The table with the non-null (or non-empty) values of changes (key and some columns) put in."""
    fields = [c for c in changes.columns if c != key]
    given = changes.select(key, *[(F.when(F.col(c) != "", F.col(c)) if skip_empty else F.col(c)).alias(f"_new_{c}") for c in fields])
    joined = table.join(given, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def counts_by(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n): the rows by each column alone, and in all, in one pass of grouping sets."""
    keyed = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns], F.struct(F.lit("*").alias("field"), F.lit(None).cast("string").alias("value")))).alias("x"))
    return keyed.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def call_cost(prompt: Column, completion: Column, input_price: Column, output_price: Column) -> Column:
    return F.round(prompt / 1e6 * input_price + completion / 1e6 * output_price, 6)


def price_of(usage: DataFrame, prices: Sequence[tuple[str, float, float]], model: str = "model") -> DataFrame:
    """Adds input_price and output_price: of the model itself, else of the first listed name that it starts with or holds."""
    found_in, found_out = F.lit(0.0), F.lit(0.0)
    for name, a, b in reversed(prices):
        fits = F.startswith(F.col(model), F.lit(name)) | F.contains(F.col(model), F.lit(name))
        found_in, found_out = F.when(fits, F.lit(a)).otherwise(found_in), F.when(fits, F.lit(b)).otherwise(found_out)
    for name, a, b in prices:
        found_in, found_out = F.when(F.col(model) == name, F.lit(a)).otherwise(found_in), F.when(F.col(model) == name, F.lit(b)).otherwise(found_out)
    return usage.withColumn("input_price", found_in).withColumn("output_price", found_out)


def nearest_rank(rows: DataFrame, value: str, percents: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, percent, value): the value at place min(int(n * p / 100), n - 1) in order."""
    by = Window.partitionBy(*keys)
    placed = rows.select(*keys, F.col(value).alias("value"), (F.row_number().over(by.orderBy(value)) - 1).alias("_i"), F.count("*").over(by).alias("_n"))
    wanted = F.explode(F.array(*map(F.lit, percents)))
    return placed.withColumn("percent", wanted).where(F.col("_i") == F.least(F.floor(F.col("_n") * F.col("percent") / 100), F.col("_n") - 1)).select(*keys, "percent", "value")


def histogram(rows: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """(bound, n): how many values are at most each bound, and in all (a null bound)."""
    sums = [F.struct(F.lit(float(b)).alias("bound"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    total = F.struct(F.lit(None).cast("double").alias("bound"), F.count(value).alias("n"))
    return rows.agg(F.array(*sums, total).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def calls_in_window(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Adds ``recent``: the calls of a key in the last seconds before each one, itself included."""
    run = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(run))


def split_archive(rows: DataFrame, at: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(archived, kept): rows strictly before the cutoff with their ``month``, and the others."""
    old = F.col(at) < F.to_timestamp(F.lit(cutoff))
    return rows.where(old).withColumn("month", F.date_format(at, "yyyy-MM")), rows.where(~old | F.col(at).isNull())
