"""Queries on the market panel: sources, formula functions, built-in factors, evaluation, metrics, strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula
from ..operators import evaluation, factors, metrics, reports, strategy
from ..sources import market
from .registry import on_panel, query, rounded


def _market(spark, sf_dir) -> DataFrame:
    return market.with_returns(market.panel(spark, sf_dir))


# Sources.

query("S01_market_rows", on_panel("SELECT date, code, round(close, 6) AS close, round(volume, 6) AS volume, round(market_cap, 6) AS market_cap FROM raw"))(lambda s, d: rounded(market.derived_rows(s, d)))
query("S02_select_codes", on_panel("SELECT date, code, round(close, 6) AS close FROM panel WHERE code IN ('S01', 'S07')"))(lambda s, d: rounded(market.select_codes(market.panel(s, d), ["S01", "S07", "absent"]).select("date", "code", "close")))
query("S03_select_dates", on_panel("SELECT date, code, round(close, 6) AS close FROM panel WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"))(lambda s, d: rounded(market.select_dates(market.panel(s, d), "1997-01-01", "1997-12-31").select("date", "code", "close")))
query("S04_universe", on_panel("SELECT DISTINCT code FROM raw ORDER BY code LIMIT 5"))(lambda s, d: market.universe(market.panel(s, d), 5))


@query("S05_cap_snapshot", on_panel("SELECT date, p.code, round(v, 6) AS market_cap FROM panel p JOIN (SELECT code, max(market_cap) AS v FROM raw GROUP BY code) USING (code)"))
def s05(spark, sf_dir):
    rows = market.derived_rows(spark, sf_dir)
    snapshot = rows.groupBy("code").agg(F.max("market_cap").alias("value"))
    return rounded(market.broadcast_snapshot(market.densify(rows), snapshot, "market_cap").select("date", "code", "market_cap"))


query("S07_load_panel", on_panel("SELECT date, code, round(close, 6) AS close, round(volume, 6) AS volume, round(market_cap, 6) AS market_cap, round(ret, 6) + 0.0 AS ret FROM market"))(lambda s, d: rounded(market.providers.load("derived", s, sf_dir=d).select("date", "code", "close", "volume", "market_cap", "ret")))


@query(
    "S10_as_of_fill",
    on_panel(
        "SELECT m.date, m.code, round(q.value, 6) AS value FROM panel m ASOF LEFT JOIN quarters q ON m.code = q.code AND m.date >= q.date",
        "quarters AS (SELECT code, max(date) AS date, max_by(market_cap, date) AS value FROM raw GROUP BY code, year(date), quarter(date))",
    ),
)
def s10(spark, sf_dir):
    rows = market.derived_rows(spark, sf_dir)
    quarters = rows.groupBy("code", F.year("date").alias("y"), F.quarter("date").alias("q")).agg(F.max("date").alias("last"), F.max_by("market_cap", "date").alias("value")).select("code", F.col("last").alias("date"), "value")
    return rounded(market.as_of(market.densify(rows), quarters, "value").select("date", "code", "value"))


# Formula functions. {w} is the trailing window of n rows.

_WINDOW = "PARTITION BY code ORDER BY date ROWS BETWEEN {0} PRECEDING AND CURRENT ROW"


def _formula(name: str, text: str, sql: str, *more: str, digits: int = 6) -> None:
    def run(spark, sf_dir):
        return rounded(formula.compute(_market(spark, sf_dir), text).select("date", "code", "value"), digits)

    query(name, on_panel(f"SELECT date, code, round({sql}, {digits}) + 0.0 AS value FROM {'staged' if more else 'market'}", *more))(run)


def _over(f: str, n: int, x: str = "close", least: int | None = None) -> str:
    w = _WINDOW.format(n - 1)
    return f"CASE WHEN count({x}) OVER ({w}) >= {max(1, n // 2) if least is None else least} THEN {f}({x}) OVER ({w}) END"


def _lag(n: int, x: str = "close") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY code ORDER BY date)"


_formula("F01_pct_change", "pct_change(close, 5)", f"filled / {_lag(5, 'filled')} - 1")
_formula("F02_rolling_mean", "rolling_mean(close, 20)", _over("avg", 20))
_formula("F03_rolling_std", "rolling_std(close, n=10)", _over("stddev_samp", 10))
_formula("F04_rolling_sum", "rolling_sum(volume, 20)", _over("sum", 20, "volume"))
_formula("F05_delay", "delay(close, 3)", _lag(3))
_RANKED = f"staged AS (SELECT *, list(close) FILTER (close IS NOT NULL) OVER ({_WINDOW.format(9)}) AS seen FROM market)"
_formula("F06_ts_rank", "ts_rank(close, 10)", "CASE WHEN close IS NOT NULL AND len(seen) >= 5 THEN (len(list_filter(seen, lambda v: v < close)) + (len(list_filter(seen, lambda v: v = close)) + 1) / 2) / len(seen) END", _RANKED)
_formula("F07_ts_zscore", "ts_zscore(close, 20)", f"(close - {_over('avg', 20)}) / ({_over('stddev_samp', 20)} + 1e-12)")
_formula("F08_ts_delta", "ts_delta(volume, 2)", f"volume - {_lag(2, 'volume')}")
_formula("F09_cs_rank", "cs_rank(volume)", "CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY volume NULLS LAST) + (count(volume) OVER (PARTITION BY date, volume) - 1) / 2) / count(volume) OVER (PARTITION BY date) END")
_formula("F10_cs_zscore", "cs_zscore(close)", "(close - avg(close) OVER (PARTITION BY date)) / (stddev_samp(close) OVER (PARTITION BY date) + 1e-12)")
_formula("F11_winsorize", "winsorize(close, 0.1)", "CASE WHEN close IS NOT NULL THEN least(greatest(close, quantile_cont(close, 0.1) OVER (PARTITION BY date)), quantile_cont(close, 0.9) OVER (PARTITION BY date)) END", digits=9)
_formula("F12_log", "log(volume)", "ln(abs(volume) + 1e-12)")
_formula("F13_abs", "abs(ts_delta(close, 1))", f"abs(close - {_lag(1)})")
_formula("F14_sign", "sign(ts_delta(volume))", f"sign(volume - {_lag(1, 'volume')})::DOUBLE")
_formula("F15_clip", "clip(ts_delta(volume, 1), -20, 20)", f"CASE WHEN volume - {_lag(1, 'volume')} IS NOT NULL THEN least(greatest(volume - {_lag(1, 'volume')}, -20), 20) END")
_formula("F16_where", "where(sign(volume - 30) + 1, close, -close)", "CASE WHEN volume IS NULL OR sign(volume - 30) + 1 <> 0 THEN close ELSE -close END")
_formula("F18_compiled_formula", "cs_rank(pct_change(close, 21)) - cs_rank(rolling_std(returns, 20)) * 0.5 + -(close ** 2) / 1e9",
         "(CASE WHEN p IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY p NULLS LAST) + (count(p) OVER (PARTITION BY date, p) - 1) / 2) / count(p) OVER (PARTITION BY date) END) - 0.5 * (CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY s NULLS LAST) + (count(s) OVER (PARTITION BY date, s) - 1) / 2) / count(s) OVER (PARTITION BY date) END) - power(close, 2) / 1e9",
         f"staged AS (SELECT *, filled / {_lag(21, 'filled')} - 1 AS p, {_over('stddev_samp', 20, 'ret')} AS s FROM market)")
_formula("P01_arithmetic", "(close + volume * 2 - 3) / (volume - 30) + +volume", "(close + volume * 2 - 3) / nullif(volume - 30, 0) + volume", digits=9)

# Built-in factors.

for _name, _sql in (
    ("return_1m", f"filled / {_lag(21, 'filled')} - 1"),
    ("return_1y", f"filled / {_lag(252, 'filled')} - 1"),
    ("volatility_3m", _over("stddev_samp", 63, "ret", 63)),
    ("turnover_1m", _over("avg", 21, "volume", 21)),
    ("unknown_factor", "0.0"),
):
    def _run(spark, sf_dir, _name=_name):
        return rounded(factors.compute(_market(spark, sf_dir), _name).select("date", "code", "value"))

    query(f"B0{1 if _name.startswith('return') else 2 if _name.startswith('vol') else 3 if _name.startswith('turn') else 4}_{_name}", on_panel(f"SELECT date, code, round({_sql}, 6) + 0.0 AS value FROM market"))(_run)

# Evaluation: the factor is the 21-day change, forward returns are over five days.

_FACTOR = f"rows AS (SELECT date, code, close, market_cap, ret, filled / {_lag(21, 'filled')} - 1 AS factor, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / close - 1 AS forward FROM market)"
_PAIRS = "pairs AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2 AS rf, rank() OVER (PARTITION BY date ORDER BY forward) + (count(*) OVER (PARTITION BY date, forward) - 1) / 2 AS rr FROM rows WHERE factor IS NOT NULL AND forward IS NOT NULL)"
_IC = """series AS (SELECT date, count(*) AS n,
  CASE WHEN count(*) >= 3 AND stddev_samp(factor) * stddev_samp(forward) > 0 THEN covar_samp(factor, forward) / (stddev_samp(factor) * stddev_samp(forward)) END AS ic,
  CASE WHEN count(*) >= 3 AND stddev_samp(rf) * stddev_samp(rr) > 0 THEN covar_samp(rf, rr) / (stddev_samp(rf) * stddev_samp(rr)) END AS rank_ic
  FROM pairs GROUP BY date)"""
_BINNED = """edges AS (SELECT date, list_sort(list_distinct(quantile_cont(factor, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM {0} WHERE factor IS NOT NULL GROUP BY date HAVING count(*) >= {1}),
binned AS (SELECT p.*, CASE WHEN len(e) > 1 THEN greatest(len(list_filter(e, lambda x: x < factor)), 1) END AS bin FROM {0} p JOIN edges USING (date) WHERE factor IS NOT NULL)"""
_GROUPS = """daily AS (SELECT date, bin, avg(forward) AS ret FROM binned GROUP BY date, bin),
returns AS (SELECT d.date, g AS "group", coalesce(max(ret) FILTER (bin = g), 0) AS ret FROM daily d CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS g) GROUP BY d.date, g)"""

#: The two-sided p-value of a t statistic, by a rational approximation of the complementary error function.
_K = "(1 / (1 + 0.3275911 * abs({0}) / sqrt(2)))"
_P = f"({_K} * (0.254829592 + {_K} * (-0.284496736 + {_K} * (1.421413741 + {_K} * (-1.453152027 + {_K} * 1.061405429)))) * exp(-abs({{0}}) * abs({{0}}) / 2))"


def _rows(spark, sf_dir) -> DataFrame:
    changed = formula.compute(_market(spark, sf_dir), "pct_change(close, 21)", "factor")
    return evaluation.with_forward(changed, 5).select("date", "code", "close", "market_cap", "ret", "factor", "forward")


query("W01_forward_return", on_panel("SELECT date, code, round(lead(close, 21) OVER (PARTITION BY code ORDER BY date) / close - 1, 6) + 0.0 AS forward FROM market"))(lambda s, d: rounded(evaluation.with_forward(_market(s, d)).select("date", "code", "forward")))
query("W02_simple_return", on_panel("SELECT date, code, round(ret, 6) + 0.0 AS ret FROM market"))(lambda s, d: rounded(_market(s, d).select("date", "code", "ret")))
query("W04_expanding_std", on_panel("SELECT date, code, round(coalesce(stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0), 6) AS vol FROM market"))(lambda s, d: rounded(strategy.expanding_volatility(_market(s, d)).select("date", "code", "vol")))
query("P04_pair_drop", on_panel("SELECT date, code, round(factor, 6) + 0.0 AS factor, round(forward, 6) + 0.0 AS forward FROM pairs", _FACTOR, _PAIRS))(lambda s, d: rounded(evaluation.pairs(_rows(s, d)).select("date", "code", "factor", "forward")))
query("A01_ic_series", on_panel("SELECT date, n, round(ic, 6) + 0.0 AS ic FROM series", _FACTOR, _PAIRS, _IC))(lambda s, d: rounded(evaluation.ic_series(_rows(s, d)).select("date", "n", "ic")))
query("A02_rank_ic", on_panel("SELECT date, round(rank_ic, 6) + 0.0 AS rank_ic FROM series", _FACTOR, _PAIRS, _IC))(lambda s, d: rounded(evaluation.ic_series(_rows(s, d)).select("date", "rank_ic")))
query("A03_ic_summary", on_panel("SELECT round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, count(*) AS n, round(avg((ic > 0)::INT), 6) AS positive_ratio, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 6) AS t_stat, round(" + _P.format("avg(ic) / (stddev_samp(ic) / sqrt(count(*)))") + ", 6) AS p_value FROM series WHERE ic IS NOT NULL", _FACTOR, _PAIRS, _IC))(lambda s, d: rounded(evaluation.ic_summary(evaluation.ic_series(_rows(s, d)))))
query("A04_quantile_returns", on_panel('SELECT date, "group", round(ret, 6) + 0.0 AS ret FROM returns', _FACTOR, _PAIRS, _BINNED.format("pairs", 10), _GROUPS))(lambda s, d: rounded(evaluation.quantile_returns(_rows(s, d))))
query("A05_quantile_summary", on_panel('SELECT "group", round(avg(ret), 6) + 0.0 AS mean_ret, count(*) AS n FROM returns GROUP BY 1', _FACTOR, _PAIRS, _BINNED.format("pairs", 10), _GROUPS))(lambda s, d: rounded(evaluation.quantile_summary(evaluation.quantile_returns(_rows(s, d)))))
query("A06_long_short", on_panel('SELECT date, round(max(ret) FILTER ("group" = 5) - max(ret) FILTER ("group" = 1), 6) + 0.0 AS spread FROM returns GROUP BY date', _FACTOR, _PAIRS, _BINNED.format("pairs", 10), _GROUPS))(lambda s, d: rounded(evaluation.long_short(evaluation.quantile_returns(_rows(s, d)))))
query("A07_decay", on_panel("SELECT horizon, round(avg(ic), 6) + 0.0 AS mean_ic, count(ic) AS n FROM by_date WHERE ic IS NOT NULL GROUP BY horizon", _FACTOR,
      "ahead AS (" + " UNION ALL ".join(f"SELECT date, factor, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY code ORDER BY date) / close - 1 AS forward FROM rows" for h in evaluation.HORIZONS) + ")",
      "by_date AS (SELECT horizon, date, CASE WHEN count(*) >= 3 AND stddev_samp(factor) * stddev_samp(forward) > 0 THEN covar_samp(factor, forward) / (stddev_samp(factor) * stddev_samp(forward)) END AS ic FROM ahead WHERE factor IS NOT NULL AND forward IS NOT NULL GROUP BY 1, 2)"))(lambda s, d: rounded(evaluation.decay(_rows(s, d))))
query("A08_top_turnover", on_panel("""SELECT d.date, round(coalesce(t.turnover, 0), 6) + 0.0 AS turnover FROM (SELECT DISTINCT date FROM rows) d LEFT JOIN (
  SELECT date, CASE WHEN len(coalesce(before, [])) = 0 THEN 1.0 ELSE 1 - len(list_intersect(top, before)) / greatest(len(top), 1) END AS turnover FROM (SELECT date, top, lag(top) OVER (ORDER BY date) AS before FROM tops)) t USING (date)""",
      _FACTOR, _BINNED.format("rows", 10), "tops AS (SELECT date, coalesce(list(code) FILTER (bin = 5), []) AS top FROM binned GROUP BY date)"))(lambda s, d: rounded(evaluation.top_turnover(_rows(s, d))))
_LEGACY = """ordered AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, code)::DOUBLE AS rf2, row_number() OVER (PARTITION BY date ORDER BY forward, code)::DOUBLE AS rr2 FROM pairs),
legacy AS (SELECT date, covar_samp(factor, forward) / (stddev_samp(factor) * stddev_samp(forward)) AS ic, covar_samp(rf2, rr2) / (stddev_samp(rf2) * stddev_samp(rr2)) AS rank_ic FROM ordered GROUP BY date HAVING count(*) >= 10 AND stddev_pop(factor) >= 1e-10 AND stddev_pop(forward) >= 1e-10)"""
query("A09_legacy_ic", on_panel("SELECT round(avg(ic), 6) AS mean_ic, round(avg(ic) / (stddev_pop(ic) + 1e-9), 6) AS icir, round(avg(rank_ic), 6) AS mean_rank_ic, count(*) AS n FROM legacy", _FACTOR, _PAIRS, _LEGACY))(lambda s, d: rounded(evaluation.legacy_summary(evaluation.legacy_ic(_rows(s, d)))))
query("A10_legacy_groups", on_panel('SELECT bin::INTEGER AS "group", round(avg(ret), 6) + 0.0 AS mean_ret FROM (SELECT date, bin, avg(forward) AS ret FROM binned WHERE bin IS NOT NULL GROUP BY 1, 2) GROUP BY 1', _FACTOR, _PAIRS, _BINNED.format("pairs", 15)))(lambda s, d: rounded(evaluation.legacy_groups(_rows(s, d))))
query("W06_rolling_ic", on_panel("SELECT date, CASE WHEN count(ic) OVER w >= 5 THEN round(avg(ic) OVER w, 6) + 0.0 END AS rolling_ic FROM series WHERE ic IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", _FACTOR, _PAIRS, _IC))(lambda s, d: rounded(evaluation.rolling_mean_ic(evaluation.ic_series(_rows(s, d)))))

_DRAW = lambda *parts: "sqrt(-2 * ln({0})) * cos(2 * pi() * {1})".format(*[f"((('0x' || substr(md5(concat_ws(':', '42', '{n}', {', '.join(parts)})), 1, 13))::BIGINT + 0.5) / 4503599627370496)" for n in ("a", "b")])


@query(
    "S06_synthetic_market",
    on_panel(
        f"""SELECT DATE '2023-01-02' + ((day // 5) * 7 + day % 5)::INTEGER AS date, 'STK' || lpad(c::VARCHAR, 4, '0') AS code, round(100 * exp(sum(0.08 / 252 + 0.05 / sqrt(days) * {_DRAW("'exposure'", "c")} + volatility / sqrt(252) * {_DRAW("'step'", "c", "day")}) OVER (PARTITION BY c ORDER BY day)), 6) AS close, 1e6 * (1 + c) AS volume, 1e9 * (1 + c) AS market_cap
FROM (SELECT days, volatility, unnest(range(codes)) AS c FROM size_) JOIN (SELECT unnest(range(days)) AS day FROM size_) ON true""",
        "size_ AS (SELECT count(DISTINCT date) AS days, count(DISTINCT code) AS codes, round(stddev_samp(ret) / 10, 4) AS volatility FROM market)",
    ),
)
def s06(spark, sf_dir):
    """A market of as many days and codes as the derived one has, and a volatility taken from it."""
    size = _market(spark, sf_dir).agg(F.count_distinct("date").alias("days"), F.count_distinct("code").alias("codes"), F.round(F.stddev_samp("ret") / 10, 4).alias("volatility")).first()
    return rounded(market.synthetic_rows(spark, market.Synthetic(days=size.days, codes=size.codes, volatility=size.volatility)))


# Metrics: the series is the mean return of the market.

_SERIES = "series AS (SELECT date, avg(ret) / 10 AS ret FROM market GROUP BY date)"
_CURVE = "curve AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS drawdown, row_number() OVER (ORDER BY date) AS i FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM series))"


def _series(spark, sf_dir) -> DataFrame:
    return _market(spark, sf_dir).groupBy("date").agg((F.avg("ret") / 10).alias("ret"))


query("W11_equity_drawdown", on_panel("SELECT date, round(equity, 6) AS equity, round(drawdown, 6) + 0.0 AS drawdown FROM curve", _SERIES, _CURVE))(lambda s, d: rounded(metrics.equity_curve(_series(s, d)).select("date", "equity", "drawdown")))
_PERFORMANCE = """SELECT n, round(power(g, 252.0 / n) - 1, 6) AS annual_return, round(sd * sqrt(252), 6) AS annual_volatility, round(m * 252 / (sd * sqrt(252)), 6) AS sharpe, round(m * 252 / (down * sqrt(252)), 6) AS sortino, round(mdd, 6) AS max_drawdown,
  CASE WHEN healed > 0 THEN after_n - healed + 1 ELSE after_n END AS drawdown_days, round(wins / n, 6) AS win_rate, round(g - 1, 6) AS total_return, round((power(g, 252.0 / n) - 1) / abs(mdd), 6) AS calmar
  FROM (SELECT count(*) AS n, exp(sum(ln(1 + ret))) AS g, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS down, min(drawdown) AS mdd, count(*) FILTER (ret > 0) AS wins FROM curve),
  (SELECT count(*) AS after_n, count(*) FILTER (drawdown >= 0) AS healed FROM curve WHERE i >= (SELECT min(i) FROM curve WHERE drawdown = (SELECT min(drawdown) FROM curve)))"""
query("A20_performance", on_panel(_PERFORMANCE, _SERIES, _CURVE))(lambda s, d: rounded(metrics.performance(_series(s, d))))
query("A18_monthly_returns", on_panel("SELECT strftime(date, '%Y-%m') AS month, round(exp(sum(ln(1 + ret))) - 1, 6) + 0.0 AS ret FROM series GROUP BY 1", _SERIES))(lambda s, d: rounded(metrics.monthly_returns(_series(s, d))))
query("A19_monthly_matrix", on_panel("SELECT year(date)::INTEGER AS year, " + ", ".join(f"coalesce(round(exp(sum(ln(1 + ret)) FILTER (month(date) = {m})) - 1, 6), 0) + 0.0 AS m{m}" for m in range(1, 13)) + " FROM series GROUP BY 1", _SERIES))(lambda s, d: rounded(metrics.monthly_matrix(metrics.monthly_returns(_series(s, d)))))
query("W07_rolling_performance", on_panel("SELECT date, round(power(g, 4.0) - 1, 6) + 0.0 AS annual_return, round(sd * sqrt(252), 6) AS annual_volatility, round(m * 252 / (sd * sqrt(252) + 1e-8), 6) + 0.0 AS sharpe FROM (SELECT date, count(*) OVER w AS n, exp(sum(ln(1 + ret)) OVER w) AS g, stddev_samp(ret) OVER w AS sd, avg(ret) OVER w AS m FROM series WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE n >= 63", _SERIES))(lambda s, d: rounded(metrics.rolling_performance(_series(s, d))))


@query("W08_rolling_correlation", on_panel("SELECT code, date, round(ic, 5) + 0.0 AS ic, round(sum(coalesce(ic, 0)) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS cumulative FROM (SELECT code, date, CASE WHEN count(k) OVER w >= 10 AND stddev_samp(f) OVER w * stddev_samp(g) OVER w > 0 THEN covar_samp(f, g) OVER w / (stddev_samp(f) OVER w * stddev_samp(g) OVER w) END AS ic FROM (SELECT code, date, CASE WHEN factor IS NOT NULL AND forward IS NOT NULL THEN factor END AS f, CASE WHEN factor IS NOT NULL AND forward IS NOT NULL THEN forward END AS g, CASE WHEN factor IS NOT NULL AND forward IS NOT NULL THEN 1 END AS k FROM rows) WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))", _FACTOR))
def w08(spark, sf_dir):
    return rounded(metrics.rolling_correlation_ic(_rows(spark, sf_dir)), 5)


# Strategies.

_REBALANCE = "calendar AS (SELECT date FROM (SELECT date, {0}(date) AS p, lag({0}(date)) OVER (ORDER BY date) AS b FROM (SELECT DISTINCT date FROM rows)) WHERE b IS NULL OR b <> p)"
for _frequency, _f in (("weekly", "weekofyear"), ("monthly", "month"), ("quarterly", "quarter")):
    query(f"W10_rebalance_{_frequency}", on_panel("SELECT date FROM calendar", _FACTOR, _REBALANCE.format(_f)))(lambda s, d, _x=_frequency: strategy.rebalance_dates(market.panel(s, d), _x))

_CHOSEN = "edges AS (SELECT date, list_sort(list_distinct(quantile_cont(factor, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM rows SEMI JOIN calendar USING (date) WHERE factor IS NOT NULL GROUP BY date HAVING count(*) >= 10), binned AS (SELECT r.*, CASE WHEN len(e) > 1 THEN greatest(len(list_filter(e, lambda x: x < factor)), 1) END AS bin FROM rows r JOIN edges USING (date) WHERE factor IS NOT NULL)"
_EQUAL = "1.0 / count(*) OVER (PARTITION BY date)"
_CAP = f"CASE WHEN sum(coalesce(market_cap, 0)) OVER (PARTITION BY date) > 0 THEN coalesce(market_cap, 0) / sum(coalesce(market_cap, 0)) OVER (PARTITION BY date) ELSE {_EQUAL} END"
_VOLS = _FACTOR.replace("SELECT date, code,", "SELECT coalesce(stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) AS vol, date, code,")
_PARITY = "(1 / (vol + 1e-8)) / sum(1 / (vol + 1e-8)) OVER (PARTITION BY date)"
for _kind, _weight, _base in (("equal", _EQUAL, _FACTOR), ("cap", _CAP, _FACTOR), ("risk_parity", _PARITY, _VOLS)):
    def _weights(spark, sf_dir, _kind=_kind):
        return rounded(strategy.target_weights(_rows(spark, sf_dir), strategy.StrategyConfig(weighting=_kind)))

    query(f"G0{2 if _kind == 'equal' else 3 if _kind == 'cap' else 4}_{_kind}_weights", on_panel(f"SELECT date, code, round({_weight}, 6) + 0.0 AS weight FROM binned WHERE bin = 5", _base, _REBALANCE.format("month"), _CHOSEN))(_weights)
query("G05_max_weight", on_panel(f"SELECT date, code, round(least({_CAP}, 0.3), 6) + 0.0 AS weight FROM binned WHERE bin = 5", _FACTOR, _REBALANCE.format("month"), _CHOSEN))(lambda s, d: rounded(strategy.target_weights(_rows(s, d), strategy.StrategyConfig(weighting="cap", max_weight=0.3))))
query("G06_long_short_weights", on_panel(f"SELECT date, code, round({_EQUAL}, 6) + 0.0 AS weight FROM binned WHERE bin = 5 UNION ALL SELECT date, code, round(-({_EQUAL}), 6) + 0.0 FROM binned WHERE bin = 1", _FACTOR, _REBALANCE.format("month"), _CHOSEN))(lambda s, d: rounded(strategy.target_weights(_rows(s, d), strategy.StrategyConfig(long_short=True))))
_HELD = f"""weights AS (SELECT date, code, {_EQUAL} AS w FROM binned WHERE bin = 5 AND date < (SELECT max(date) FROM rows)),
sets AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM weights)),
moved AS (SELECT date, sum(abs(x)) AS m FROM (SELECT date, code, sum(x) AS x FROM (SELECT date, code, w AS x FROM weights UNION ALL SELECT next, code, -w FROM weights JOIN sets USING (date) WHERE next IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
gross AS (SELECT r.date, sum(w.w * r.ret) AS g FROM rows r JOIN sets s ON r.date >= s.date AND (s.next IS NULL OR r.date < s.next) JOIN weights w ON w.date = s.date AND w.code = r.code GROUP BY 1)"""
query("G07_trades", on_panel("SELECT date, round(m / 2, 6) AS turnover, round(m * 15 / 1e4, 6) AS cost FROM moved", _FACTOR, _REBALANCE.format("month"), _CHOSEN, _HELD))(
    lambda s, d: rounded(strategy.trades((lambda r: strategy.target_weights(r, strategy.StrategyConfig()).join(F.broadcast(r.agg(F.max("date").alias("last"))), F.col("date") < F.col("last")).drop("last"))(_rows(s, d)), None, strategy.StrategyConfig()))
)
query("G10_strategy", on_panel("SELECT date, round(ret, 6) + 0.0 AS ret, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(equity, 6) AS equity, round(equity / greatest(max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) - 1, 6) + 0.0 AS drawdown FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM (SELECT d.date, coalesce(g, 0) - coalesce(m * 15 / 1e4, 0) AS ret, coalesce(m / 2, 0) AS turnover, coalesce(m * 15 / 1e4, 0) AS cost FROM (SELECT DISTINCT date FROM rows) d LEFT JOIN gross USING (date) LEFT JOIN moved USING (date)))", _FACTOR, _REBALANCE.format("month"), _CHOSEN, _HELD))(lambda s, d: rounded(strategy.run_strategy(_rows(s, d))))


# Reports.

_RECORD = """ahead AS (""" + " UNION ALL ".join(f"SELECT date, factor, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY code ORDER BY date) / close - 1 AS forward FROM rows" for h in evaluation.HORIZONS) + """),
by_date AS (SELECT horizon, date, CASE WHEN count(*) >= 3 AND stddev_samp(factor) * stddev_samp(forward) > 0 THEN covar_samp(factor, forward) / (stddev_samp(factor) * stddev_samp(forward)) END AS ic FROM ahead WHERE factor IS NOT NULL AND forward IS NOT NULL GROUP BY 1, 2)"""
_TURN = """tb AS (SELECT p.date, p.code, CASE WHEN len(e) > 1 THEN greatest(len(list_filter(e, lambda x: x < factor)), 1) END AS bin FROM rows p JOIN (SELECT date, list_sort(list_distinct(quantile_cont(factor, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM rows WHERE factor IS NOT NULL GROUP BY date HAVING count(*) >= 10) USING (date) WHERE factor IS NOT NULL),
tops AS (SELECT date, coalesce(list(code) FILTER (bin = 5), []) AS top FROM tb GROUP BY date),
turns AS (SELECT d.date, coalesce(t.turnover, 0) AS turnover FROM (SELECT DISTINCT date FROM rows) d LEFT JOIN (
  SELECT date, CASE WHEN len(coalesce(before, [])) = 0 THEN 1.0 ELSE 1 - len(list_intersect(top, before)) / greatest(len(top), 1) END AS turnover FROM (SELECT date, top, lag(top) OVER (ORDER BY date) AS before FROM tops)) t USING (date))"""
_STATS = "stats AS (SELECT avg(ic) AS m, stddev_samp(ic) AS sd, count(ic) AS n, avg((ic > 0)::INT) AS win, avg(rank_ic) AS rank_ic FROM series WHERE ic IS NOT NULL)"
_MEANS = 'means AS (SELECT coalesce(avg(ret) FILTER ("group" = 1), 0) * 100 AS low, coalesce(avg(ret) FILTER ("group" = 5), 0) * 100 AS high FROM returns)'

query(
    "A34_evaluation_record",
    on_panel(
        "SELECT 'momentum' AS factor_name, round(m, 6) AS ic, round(m / sd, 6) AS icir, round(rank_ic, 6) AS rank_ic, round(high, 6) AS top_return, round(low, 6) AS bottom_return, round(high - low, 6) AS top_minus_bottom, round(win, 6) AS win_rate, round(m / (sd / sqrt(n)), 6) AS t_stat, round("
        + _P.format("m / (sd / sqrt(n))")
        + ", 6) AS p_value, n AS data_points, (SELECT round(avg(turnover), 6) FROM turns) AS mean_turnover, "
        + ", ".join(f"(SELECT round(avg(ic), 6) FROM by_date WHERE horizon = {h}) AS decay_{h}" for h in evaluation.HORIZONS)
        + ", CASE WHEN n > 10 THEN 'ok' ELSE 'insufficient_data' END AS status FROM stats, means",
        _FACTOR, _PAIRS, _IC, _BINNED.format("pairs", 10), _GROUPS, _RECORD, _TURN, _STATS, _MEANS,
    ),
)(lambda s, d: rounded(reports.evaluation_record(_rows(s, d), "momentum").drop(*reports.NESTED)))
query("A34_record_details", on_panel('SELECT \'quantile\' AS part, \'Q\' || "group" AS key, round(avg(ret), 6) + 0.0 AS value FROM returns GROUP BY 2 UNION ALL SELECT \'ic\', date::VARCHAR, round(ic, 4) + 0.0 FROM series WHERE ic IS NOT NULL UNION ALL SELECT \'rank_ic\', date::VARCHAR, round(rank_ic, 4) + 0.0 FROM series WHERE rank_ic IS NOT NULL', _FACTOR, _PAIRS, _IC, _BINNED.format("pairs", 10), _GROUPS))(lambda s, d: rounded(reports.record_details(reports.evaluation_record(_rows(s, d), "momentum"))))


@query(
    "A35_report_summary",
    on_panel(
        "SELECT 2 AS n_factors, round((SELECT avg(m) FROM (SELECT avg(ic) AS m FROM series HAVING count(ic) > 10 UNION ALL SELECT avg(ic) FROM series5 HAVING count(ic) > 10)), 4) AS mean_ic, p.* FROM (" + _PERFORMANCE + ") p",
        _FACTOR, _PAIRS, _IC, *[x.replace("rows", "rows5").replace("pairs", "pairs5").replace("series AS", "series5 AS").replace("21", "5") for x in (_FACTOR, _PAIRS, _IC)], _SERIES.replace("series AS", "daily_ret AS"), _CURVE.replace("FROM series", "FROM daily_ret"),
    ),
)
def a35(spark, sf_dir):
    short = evaluation.with_forward(formula.compute(_market(spark, sf_dir), "pct_change(close, 5)", "factor"), 5).select("date", "code", "close", "factor", "forward")
    records = reports.evaluation_record(_rows(spark, sf_dir), "momentum").unionByName(reports.evaluation_record(short, "short momentum"))
    return rounded(reports.report_summary(records, metrics.performance(_series(spark, sf_dir))))


_CHARTS = """SELECT 'equity' AS chart, date::VARCHAR AS x, '' AS series, round(equity, 6) AS y FROM curve UNION ALL SELECT 'drawdown', date::VARCHAR, '', round(drawdown, 6) + 0.0 FROM curve
UNION ALL SELECT 'month', lpad(m::VARCHAR, 2, '0'), yr::VARCHAR, round(coalesce(r, 0) * 100, 2) + 0.0 FROM (SELECT DISTINCT year(date) AS yr FROM curve) CROSS JOIN (SELECT unnest(range(1, 13)) AS m) LEFT JOIN (SELECT year(date) AS yr, month(date) AS m, exp(sum(ln(1 + ret))) - 1 AS r FROM curve GROUP BY 1, 2) USING (yr, m)
UNION ALL SELECT 'ic', date::VARCHAR, 'momentum', round(ic, 4) + 0.0 FROM fseries WHERE ic IS NOT NULL UNION ALL SELECT 'quantile', 'Q' || "group", 'momentum', round(avg(ret), 6) + 0.0 FROM returns GROUP BY 2
UNION ALL SELECT 'decay', horizon::VARCHAR, 'momentum', round(avg(ic), 6) + 0.0 FROM by_date WHERE ic IS NOT NULL GROUP BY 2"""
query("A36_chart_series", on_panel(_CHARTS, _SERIES, _CURVE, _FACTOR, _PAIRS, _IC.replace("series AS", "fseries AS"), _BINNED.format("pairs", 10), _GROUPS, _RECORD))(lambda s, d: reports.chart_series(_series(s, d), _rows(s, d), "momentum"))
