"""Two spellings of the few functions on which engines differ.

Operators of this library are SQL over DataFrames.  The same text, spelt for another engine, is the oracle that checks it.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    @staticmethod
    def pct(x: str, p: float) -> str:
        return f"percentile({x}, {p}D)"

    @staticmethod
    def corr(a: str, b: str) -> str:
        """Where one of them doesn't vary, NaN, as in the other engine, and no division by zero."""
        return f"case when regr_count({a}, {b}) > 0 then coalesce(regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0D), double('NaN')) end"

    @staticmethod
    def rint(x: str) -> str:
        return f"rint({x})"

    @staticmethod
    def rx(text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    @staticmethod
    def rlike(text: str, pattern: str) -> str:
        return f"({text} rlike r'{pattern}')"

    @staticmethod
    def series(first: str, last: str, column: str) -> str:
        """Suffix of a FROM clause: one row an integer from first to last (none if last < first)."""
        return f"lateral view explode(case when {last} >= {first} then sequence(cast({first} as int), cast({last} as int)) else cast(array() as array<int>) end) t_{column} as {column}"

    @staticmethod
    def elements(table: str, array: str, keep: str, index: str, value: str) -> str:
        return f"(select {keep}, {index}, {value} from {table} lateral view posexplode({array}) t_e as {index}, {value})"

    @staticmethod
    def num(x: str) -> str:
        return f"try_cast({x} as double)"

    @staticmethod
    def epoch(x: str) -> str:
        return f"(cast(unix_micros(cast({x} as timestamp)) as double) / 1000000D)"

    @staticmethod
    def notes(*parts: str) -> str:
        return f"concat_ws('; ', {', '.join(parts)})"

    @staticmethod
    def dbl(x: float) -> str:
        return f"{x!r}D"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def pct(x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    @staticmethod
    def corr(a: str, b: str) -> str:
        return f"corr({a}, {b})"

    @staticmethod
    def rint(x: str) -> str:
        return f"round_even({x}, 0)"

    @staticmethod
    def rx(text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    @staticmethod
    def rlike(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    @staticmethod
    def series(first: str, last: str, column: str) -> str:
        return f", unnest(generate_series(cast({first} as bigint), cast({last} as bigint))) t_{column}({column})"

    @staticmethod
    def elements(table: str, array: str, keep: str, index: str, value: str) -> str:
        return f"(select {keep}, cast(generate_subscripts({array}, 1) - 1 as int) {index}, unnest({array}) {value} from {table})"

    @staticmethod
    def epoch(x: str) -> str:
        return f"(cast(epoch_us({x}) as double) / 1000000)"

    @staticmethod
    def dbl(x: float) -> str:
        return f"cast({x!r} as double)"


SPARK, DUCK = Spark(), Duck()
