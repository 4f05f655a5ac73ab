"""The catalog of known factors, and whether a wished one is among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, category, data source, period in days or column, whether higher is better.
FACTORS = (
    ("return_1m", "momentum", "price", "21", False), ("return_3m", "momentum", "price", "63", False), ("return_6m", "momentum", "price", "126", False), ("return_1y", "momentum", "price", "252", False), ("turnover_1m", "momentum", "price", "21", False),
    ("ROE", "quality", "financial", "净资产收益率(%)", True), ("gross_profit_margin", "quality", "financial", "销售毛利率(%)", True), ("net_profit_margin", "quality", "financial", "销售净利率(%)", True),
    ("asset_turnover", "efficiency", "financial", "总资产周转率(次)", True),
    ("revenue_growth_yoy", "growth", "financial", "营业总收入增长率(%)", True), ("profit_growth_yoy", "growth", "financial", "净利润增长率(%)", True),
)
# Aliases, in the order in which they are tried.
ALIASES = {
    "1月收益": "return_1m", "1个月收益": "return_1m", "近1月": "return_1m", "3月收益": "return_3m", "近3月": "return_3m", "6月收益": "return_6m", "近6月": "return_6m", "1年收益": "return_1y", "近1年": "return_1y",
    "1月换手": "turnover_1m", "近1月换手": "turnover_1m", "月均换手": "turnover_1m", "1月动量": "return_1m", "3月动量": "return_3m", "6月动量": "return_6m", "12月动量": "return_1y", "1年动量": "return_1y", "momentum": "return_1m",
    "roe": "ROE", "净资产收益率": "ROE", "毛利率": "gross_profit_margin", "销售毛利率": "gross_profit_margin", "净利率": "net_profit_margin", "销售净利率": "net_profit_margin", "总资产周转": "asset_turnover", "资产周转率": "asset_turnover",
    "营收同比": "revenue_growth_yoy", "营收增长": "revenue_growth_yoy", "营业总收入": "revenue_growth_yoy", "净利润同比": "profit_growth_yoy", "净利润增长": "profit_growth_yoy", "利润增速": "profit_growth_yoy",
}
#: Aliases of so many letters or fewer are looked for in names alone.
SHORT_ALIAS = 3


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a table of one row a factor."""
    return spark.createDataFrame(FACTORS, "name string, category string, data_source string, measure string, higher_is_better boolean")


def _first(pairs: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(fits, F.lit(name)) for fits, name in pairs])


def match(name: Column, needed: Column, definition: Column) -> Column:
    """The factor meant by a wish, else null: a name within another first (case counts on the catalog's side), then aliases."""
    low, others = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.concat_ws("\n", needed, definition))
    by_name = [((low != "") & (low.contains(f[0]) | F.lit(f[0]).contains(low)), f[0]) for f in FACTORS]
    by_alias = [(low.contains(a) if len(a) <= SHORT_ALIAS else low.contains(a) | others.contains(a), f) for a, f in ALIASES.items()]
    return _first(by_name + by_alias)


def feasibility(wishes: DataFrame) -> DataFrame:
    """Adds matching_factor, feasible, and multimodal (whether the data wished for are news or model scores) to wishes
    (factor_name, data_needed, definition)."""
    needed = F.lower(F.coalesce("data_needed", F.lit("")))
    found = wishes.withColumn("matching_factor", match(F.col("factor_name"), F.col("data_needed"), F.col("definition")))
    return found.withColumn("feasible", F.col("matching_factor").isNotNull()).withColumn("multimodal", needed.rlike("新闻|news|llm"))
