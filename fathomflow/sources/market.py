"""Market panels in long form: one row a (date, code), dense over the trading dates of the whole market.

Row position is trading-day position for every shift and rolling window, so a panel is densified once: the
distinct dates times the distinct codes, with nulls where a code has no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes of the panel that is derived from line items.
DERIVED_CODES = 20


def derived_rows(spark: SparkSession, sf_dir: str, codes: int = DERIVED_CODES) -> DataFrame:
    """(date, code, close, volume, market_cap): line items by ship date and supplier group."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % codes).cast("string"), 2, "0"))
    return items.groupBy(F.to_date("l_shipdate").alias("date"), code.alias("code")).agg(
        F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), (F.max("l_extendedprice") * 1000).alias("market_cap")
    )


def densify(rows: DataFrame) -> DataFrame:
    """One row for each date and code of the market. The trading days are one array, so each code brings its own rows and no number of codes is broadcast."""
    days = rows.agg(F.array_sort(F.collect_set("date")).alias("days"))
    spine = rows.select("code").distinct().join(F.broadcast(days)).select(F.explode("days").alias("date"), "code")
    return spine.join(rows, ["date", "code"], "left")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense derived panel."""
    return densify(derived_rows(spark, sf_dir))


def with_returns(market: DataFrame) -> DataFrame:
    """Adds ``ret``: the simple return on the last known close, 0 on the first day."""
    by_code = Window.partitionBy("code").orderBy("date")
    known = F.last("close", ignorenulls=True).over(by_code.rowsBetween(Window.unboundedPreceding, 0))
    filled = market.withColumn("_known", known)
    return filled.withColumn("ret", F.coalesce(F.try_divide(F.col("_known"), F.lag("_known").over(by_code)) - 1, F.lit(0.0))).drop("_known")


def select_codes(market: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Rows of the codes that exist; no codes mean all."""
    return market.where(F.col("code").isin(list(codes))) if codes else market


def select_dates(market: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Rows from start to end, both included; an empty string is unbounded."""
    if start:
        market = market.where(F.col("date") >= F.to_date(F.lit(start)))
    return market.where(F.col("date") <= F.to_date(F.lit(end))) if end else market


def universe(market: DataFrame, top: int) -> DataFrame:
    """The first codes in order."""
    return market.select("code").distinct().orderBy("code").limit(top)


def broadcast_snapshot(market: DataFrame, snapshot: DataFrame, column: str) -> DataFrame:
    """One value a code (code, value) repeated on every date."""
    return market.drop(column).join(snapshot.select("code", F.col("value").alias(column)), "code", "left")


def as_of(left: DataFrame, right: DataFrame, value: str, key: str = "code", at: str = "date") -> DataFrame:
    """Backward as-of join: each left row gets the latest right value at or before it, of its key.

    The two sides are sorted together once; no range join is made."""
    both = left.select(key, at, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")))
    run = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(run)).where("_side = 1").select(key, at, value)


@dataclass(frozen=True)
class Synthetic:
    """Parameters of the generated market."""

    days: int = 252
    codes: int = 20
    drift: float = 0.08
    volatility: float = 0.3
    ic: float = 0.05
    seed: int = 42


def _normal(seed: int, *parts: Column | str) -> Column:
    """A draw from the standard normal distribution that depends on the seed and the parts alone, by two digests (Box and Muller)."""
    text = lambda n: F.concat_ws(":", F.lit(f"{seed}"), F.lit(n), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    even = [(F.conv(F.substring(F.md5(text(n)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for n in ("a", "b")]
    return F.sqrt(-2 * F.ln(even[0])) * F.cos(2 * math.pi * even[1])


def synthetic_rows(spark: SparkSession, spec: Synthetic = Synthetic()) -> DataFrame:
    """A geometric random walk a code on business days from 2023-01-02, with a factor exposure that returns follow. Each row's draws depend on its code and
    day, so rows are made where they are needed, and reruns agree."""
    grid = spark.range(spec.days * spec.codes).select((F.col("id") % spec.codes).alias("c"), F.floor(F.col("id") / spec.codes).cast("int").alias("day"))
    exposure, noise = _normal(spec.seed, "exposure", F.col("c")), _normal(spec.seed, "step", F.col("c"), F.col("day"))
    step = spec.drift / 252 + spec.ic / math.sqrt(spec.days) * exposure + spec.volatility / math.sqrt(252) * noise
    walk = F.sum("step").over(Window.partitionBy("c").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    walked = grid.withColumn("step", step).withColumn("close", 100 * F.exp(walk))
    date = F.date_add(F.to_date(F.lit("2023-01-02")), (F.floor(F.col("day") / 5) * 7 + F.col("day") % 5).cast("int"))
    code = F.concat(F.lit("STK"), F.lpad(F.col("c").cast("string"), 4, "0"))
    return walked.select(date.alias("date"), code.alias("code"), "close", (1e6 * (1 + F.col("c"))).alias("volume"), (1e9 * (1 + F.col("c"))).alias("market_cap"))


def local_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Long Parquet files of a folder: prices (date, code, close) are required, volume and market_cap are optional."""
    rows = spark.read.parquet(f"{folder}/prices.parquet").select("date", "code", "close")
    for name in ("volume", "market_cap"):
        try:
            more = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = rows.withColumn(name, F.lit(None).cast("double"))
        else:
            rows = rows.join(more.select("date", "code", name), ["date", "code"], "left")
    return rows


def write_local(market: DataFrame, folder: str) -> None:
    """Prices, volume and market_cap as Parquet, which local_rows reads."""
    for name, column in (("prices", "close"), ("volume", "volume"), ("market_cap", "market_cap")):
        market.where(F.col(column).isNotNull()).select("date", "code", column).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@dataclass
class Providers:
    """Named sources of market rows; unknown names are refused."""

    makers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, name: str, maker: Callable[..., DataFrame]) -> None:
        self.makers[name] = maker

    def load(self, name: str, spark: SparkSession, **options) -> DataFrame:
        """The dense panel of a provider, with returns."""
        if name not in self.makers:
            raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(self.makers))}")
        return with_returns(densify(self.makers[name](spark, **options)))


def _jdbc_rows(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load().select("date", "code", "close", "volume", "market_cap")


providers = Providers({"synthetic": synthetic_rows, "local": local_rows, "derived": derived_rows, "db": _jdbc_rows})
