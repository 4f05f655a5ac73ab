"""A safe formula language over panels, compiled to Spark columns.

A formula is parsed to a syntax tree, checked against whitelists, and compiled bottom up: each time-series or
cross-section call becomes a column of its own, equal subtrees share one (by structure), and windows with the same
partitioning and order end up in one Window operator and one shuffle. Nothing is ever evaluated as Python.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
#: Inputs and the panel column that each reads.
INPUTS = {"close": "close", "open": "close", "high": "close", "low": "close", "volume": "volume", "returns": "ret", "market_cap": "market_cap"}
#: What an input is where the panel has no such column.
DEFAULTS = {"volume": 0.0, "market_cap": 1.0}


class FormulaError(ValueError):
    """A formula that is empty, malformed, forbidden, or no panel."""


def _by_code():
    return Window.partitionBy("code").orderBy("date")


def _by_date():
    return Window.partitionBy("date")


def _trailing(n: int):
    return _by_code().rowsBetween(-(n - 1), 0)


def _guarded(n: int, x: Column, value: Column, least: int | None = None) -> Column:
    """The value where at least half of the window (or ``least``) is known."""
    return F.when(F.count(x).over(_trailing(n)) >= (max(1, n // 2) if least is None else least), value)


def forward_filled(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(_by_code().rowsBetween(Window.unboundedPreceding, 0))


def rolling_mean(x: Column, n: int = 20) -> Column:
    return _guarded(n, x, F.avg(x).over(_trailing(n)))


def rolling_std(x: Column, n: int = 20) -> Column:
    return _guarded(n, x, F.stddev_samp(x).over(_trailing(n)))


def rolling_sum(x: Column, n: int = 20) -> Column:
    return _guarded(n, x, F.sum(x).over(_trailing(n)))


def delay(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(_by_code()) if n >= 0 else F.lead(x, -n).over(_by_code())


def ts_rank(x: Column, n: int = 20) -> Column:
    """Average rank of the current value among the known ones of its window, as a share of them."""
    known = F.collect_list(x).over(_trailing(n))
    less, equal = F.size(F.filter(known, lambda v: v < x)), F.size(F.filter(known, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(known) >= max(1, n // 2)), (less + (equal + 1) / 2) / F.size(known))


def cs_rank(x: Column) -> Column:
    ties = F.count(x).over(Window.partitionBy("date", x))
    return F.when(x.isNotNull(), (F.rank().over(_by_date().orderBy(x.asc_nulls_last())) + (ties - 1) / 2) / F.count(x).over(_by_date()))


def clip(x: Column, lo: float = -3.0, hi: float = 3.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def _winsorized(x: Column, q: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, q).over(_by_date())), F.percentile(x, 1 - q).over(_by_date())))


@dataclass(frozen=True)
class Function:
    """How a call becomes columns: stages before the last are columns of their own, since windows don't nest."""

    stages: tuple[Callable[..., Column], ...]
    parameters: tuple[tuple[str, float], ...] = ()
    panels: int = 1


def _n(default: int) -> tuple[tuple[str, float], ...]:
    return (("n", default),)


FUNCTIONS: dict[str, Function] = {
    "pct_change": Function((lambda x, n: forward_filled(x), lambda x, n: F.try_divide(x, delay(x, n)) - 1), _n(1)),
    "rolling_mean": Function((rolling_mean,), _n(20)),
    "rolling_std": Function((rolling_std,), _n(20)),
    "rolling_sum": Function((rolling_sum,), _n(20)),
    "delay": Function((delay,), _n(1)),
    "ts_rank": Function((ts_rank,), _n(20)),
    "ts_zscore": Function((lambda x, n: (x - rolling_mean(x, n)) / (rolling_std(x, n) + EPSILON),), _n(20)),
    "ts_delta": Function((lambda x, n: x - delay(x, n),), _n(1)),
    "cs_rank": Function((cs_rank,)),
    "cs_zscore": Function((lambda x: (x - F.avg(x).over(_by_date())) / (F.stddev_samp(x).over(_by_date()) + EPSILON),)),
    "winsorize": Function((_winsorized,), (("q", 0.01),)),
    "log": Function((lambda x: F.ln(F.abs(x) + EPSILON),)),
    "abs": Function((F.abs,)),
    "sign": Function((F.signum,)),
    "clip": Function((clip,), (("lo", -3.0), ("hi", 3.0))),
    "where": Function((lambda cond, a, b: F.when(cond.isNull() | (cond != 0), a).otherwise(b),), panels=3),
}
_ALLOWED = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant, ast.keyword, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.UAdd, ast.USub)


def parse(formula: str) -> ast.Expression:
    """The checked syntax tree of a formula."""
    if not formula or not formula.strip():
        raise FormulaError("the formula is empty")
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"syntax error: {e.msg}") from e
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED):
            raise FormulaError(f"forbidden element {type(node).__name__}")
        if isinstance(node, ast.Call):
            if not isinstance(node.func, ast.Name):
                raise FormulaError("only plain function calls are allowed")
            if node.func.id not in FUNCTIONS:
                raise FormulaError(f"unknown function {node.func.id}")
        if isinstance(node, ast.Constant) and (isinstance(node.value, bool) or not isinstance(node.value, int | float)):
            raise FormulaError("only numbers are constants")
    return tree


def inputs_of(formula: str) -> list[str]:
    """The inputs that a formula names, in order."""
    tree = parse(formula)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called and n.id in INPUTS})


def missing_inputs(formula: str, columns: list[str]) -> list[str]:
    """Inputs that a panel with these columns does not give."""
    return [x for x in inputs_of(formula) if INPUTS[x] not in columns]


class _Compiler:
    def __init__(self, market: DataFrame):
        self.market = market
        self.made: dict[str, str] = {}

    def _stage(self, key: str, column: Column) -> Column:
        if key not in self.made:
            name = f"_f{len(self.made)}"
            self.market = self.market.withColumn(name, column)
            self.made[key] = name
        return F.col(self.made[key])

    def _input(self, name: str) -> Column:
        if name not in INPUTS:
            raise FormulaError(f"unknown name {name}")
        column = INPUTS[name]
        if column in self.market.columns:
            return F.col(column)
        if name in DEFAULTS:
            return F.lit(DEFAULTS[name])
        raise FormulaError(f"the panel has no {column}")

    def number(self, node: ast.AST) -> float:
        value = self.compile(node)
        if isinstance(value, Column):
            raise FormulaError("a parameter is no number")
        return value

    def compile(self, node: ast.AST) -> Column | float:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return self._input(node.id)
        if isinstance(node, ast.UnaryOp):
            value = self.compile(node.operand)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.BinOp):
            return self._arithmetic(node.op, self.compile(node.left), self.compile(node.right))
        return self._call(node)

    def _arithmetic(self, op: ast.operator, a: Column | float, b: Column | float) -> Column | float:
        if not isinstance(a, Column) and not isinstance(b, Column):
            try:
                return {ast.Add: a.__add__, ast.Sub: a.__sub__, ast.Mult: a.__mul__, ast.Div: a.__truediv__, ast.Pow: a.__pow__}[type(op)](b)
            except ZeroDivisionError as e:
                raise FormulaError("division by zero") from e
        a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
        if isinstance(op, ast.Div):
            return F.try_divide(a, b)
        return F.pow(a, b) if isinstance(op, ast.Pow) else a + b if isinstance(op, ast.Add) else a - b if isinstance(op, ast.Sub) else a * b

    def _call(self, node: ast.Call) -> Column:
        name, function = node.func.id, FUNCTIONS[node.func.id]
        if len(node.args) < function.panels or len(node.args) > function.panels + len(function.parameters):
            raise FormulaError(f"{name} takes {function.panels} panels and up to {len(function.parameters)} parameters")
        values = dict(function.parameters)
        for (parameter, _), given in zip(function.parameters, node.args[function.panels :], strict=False):
            values[parameter] = self.number(given)
        for k in node.keywords:
            if k.arg not in values:
                raise FormulaError(f"{name} has no parameter {k.arg}")
            values[k.arg] = self.number(k.value)
        if "n" in values:
            values["n"] = int(values["n"])
            if values["n"] < 1 and name.startswith(("rolling", "ts_")):
                raise FormulaError(f"{name} needs a window of a row at least")
        panels = [self.compile(a) for a in node.args[: function.panels]]
        keys = [ast.dump(a) for a in node.args[: function.panels]]
        columns = [self._stage(k, p) if isinstance(p, Column) else F.lit(float(p)) for k, p in zip(keys, panels, strict=True)]
        for i, stage in enumerate(function.stages):
            key = f"{name} {i} {keys} {sorted(values.items()) if i + 1 == len(function.stages) else ''}"
            columns = [self._stage(key, stage(*columns, **values))]
        return columns[0]


def compute(market: DataFrame, formula: str, name: str = "value") -> DataFrame:
    """Adds a column with the formula's value to a panel (date, code, inputs)."""
    compiler = _Compiler(market)
    result = compiler.compile(parse(formula).body)
    if not isinstance(result, Column):
        raise FormulaError("the formula gives a number, no panel")
    return compiler.market.withColumn(name, result).drop(*compiler.made.values())


def compute_all(market: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Adds a column for each named formula; equal parts of different formulas are computed once."""
    compiler = _Compiler(market)
    for name, formula in formulas.items():
        result = compiler.compile(parse(formula).body)
        if not isinstance(result, Column):
            raise FormulaError(f"{name} gives a number, no panel")
        compiler.market = compiler.market.withColumn(name, result)
    return compiler.market.drop(*compiler.made.values())
