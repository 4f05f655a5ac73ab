"""The registry of queries: a name, a function of (spark, sf_dir), and the SQL whose rows it must return, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums does not show; negative zero is zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


PANEL = """raw AS (
  SELECT l_shipdate::DATE AS date, 'S' || lpad((l_suppkey % 20)::VARCHAR, 2, '0') AS code, max(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume, max(l_extendedprice) * 1000 AS market_cap
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT d.date, c.code, r.close, r.volume, r.market_cap
  FROM (SELECT DISTINCT date FROM raw) d CROSS JOIN (SELECT DISTINCT code FROM raw) c LEFT JOIN raw r ON r.date = d.date AND r.code = c.code),
known AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled FROM panel),
market AS (SELECT *, coalesce(filled / lag(filled) OVER (PARTITION BY code ORDER BY date) - 1, 0) AS ret FROM known)"""


def on_panel(select: str, *more: str) -> str:
    """SQL over the derived panel: ``market`` has date, code, close, volume, market_cap, filled, ret."""
    return "WITH " + ",\n".join([PANEL, *more]) + "\n" + select
