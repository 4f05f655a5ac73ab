"""Boolean rules and result checks, compiled to columns.

A rule is comparisons of names with whole numbers, or bare names, joined by and, or, not and brackets. The first
rule that fits decides.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\()|(\))|(>=|<=|==|!=|>|<)|(-?\d+)|([A-Za-z_]\w*))")


class RuleError(ValueError):
    """A rule that cannot be read."""


def _read(rule: str) -> list[str]:
    found, at = [], 0
    while rule[at:].strip():
        m = _TOKEN.match(rule, at)
        if not m:
            raise RuleError(f"unexpected text at {at}: {rule[at:]!r}")
        found.append(m[0].strip())
        at = m.end()
    return found


class _Parser:
    """Recursive descent: or binds weakest, then and, then not."""

    def __init__(self, rule: str, columns: Sequence[str]):
        self.left, self.columns = _read(rule)[::-1], set(columns)

    def next(self, *wanted: str) -> str | None:
        if self.left and (not wanted or self.left[-1] in wanted):
            return self.left.pop()
        return None

    def any_of(self) -> Column:
        found = self.all_of()
        while self.next("or"):
            found = found | self.all_of()
        return found

    def all_of(self) -> Column:
        found = self.one()
        while self.next("and"):
            found = found & self.one()
        return found

    def one(self) -> Column:
        if self.next("not"):
            return ~self.one()
        if self.next("("):
            found = self.any_of()
            if not self.next(")"):
                raise RuleError("a bracket is not closed")
            return found
        name = self.next()
        if name is None or not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise RuleError(f"a name is expected instead of {name!r}")
        value = F.col(name) if name in self.columns else F.lit(None).cast("long")
        sign = self.next(">=", "<=", "==", "!=", ">", "<")
        if sign is None:
            return F.coalesce(value.cast("boolean"), F.lit(False))
        number = self.next()
        if number is None or not re.fullmatch(r"-?\d+", number):
            raise RuleError(f"a number is expected instead of {number!r}")
        x, y = F.coalesce(value.cast("long"), F.lit(0)), F.lit(int(number))
        return {">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y, ">": x > y, "<": x < y}[sign]


def compile_rule(rule: str, columns: Sequence[str]) -> Column:
    """The rule as a column that is never null: unknown names and nulls are 0 or false."""
    parser = _Parser(rule, columns)
    found = parser.any_of()
    if parser.left:
        raise RuleError(f"unexpected {parser.left[-1]!r}")
    return found


def first_match(rules: Sequence[tuple[str, str]], columns: Sequence[str]) -> Column:
    """The action of the first (rule, action) that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, action in reversed(rules):
        found = F.when(compile_rule(rule, columns), F.lit(action)).otherwise(found)
    return found


def override(chosen: Column, action: Column, fallback: str) -> Column:
    """The matching action in place of the chosen one, unless the fallback was chosen."""
    return F.when(action.isNotNull() & (chosen != fallback), action).otherwise(chosen)


def decide(ic: Column, icir: Column, approve_ic: float = 0.03, approve_icir: float = 0.3, reject_ic: float = 0.01) -> Column:
    """approve or reject by thresholds; approve where neither applies."""
    return F.when((F.abs(ic) >= approve_ic) & (F.abs(icir) >= approve_icir), "approve").when(F.abs(ic) < reject_ic, "reject").otherwise("approve")


def issues(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that fail (a null check fails not), in order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in checks]))


def backtest_issues(ic: Column, icir: Column, mean_ret: Column, n_dates: Column) -> Column:
    """What speaks against a backtest record."""
    return issues(
        (ic.isNull() | F.isnan(ic), "missing_ic"), (F.abs(ic) > 1, "ic_out_of_range"), (n_dates < 20, "too_few_dates"), (F.abs(icir) > 10, "icir_out_of_range"), ((ic * mean_ret) < 0, "sign_disagreement")
    )
