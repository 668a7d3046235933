"""Aggregates by name as Spark SQL text, so that one text serves groups and windows alike."""

from __future__ import annotations

from collections.abc import Callable

from tessera.errors import InvalidInputException


def _q(q: float | list) -> str:
    def one(x: object) -> str:
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            raise InvalidInputException("a quantile is a number or a list of numbers")
        return repr(float(x))

    return "array(" + ", ".join(map(one, q)) + ")" if isinstance(q, list) else one(q)


def _text(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Stands in a text where its window goes, if that isn't at the end.
OVER = "{over}"
#: Name to text of one column c.
SIMPLE: dict[str, Callable[[str], str]] = {
    "any_value": lambda c: f"first({c}, true)",
    "avg": lambda c: f"avg({c})",
    "bit_and": lambda c: f"bit_and({c})",
    "bit_or": lambda c: f"bit_or({c})",
    "bit_xor": lambda c: f"bit_xor({c})",
    "bool_and": lambda c: f"bool_and({c})",
    "bool_or": lambda c: f"bool_or({c})",
    "count": lambda c: f"count({c})",
    "favg": lambda c: f"avg(cast({c} as double))",
    "fsum": lambda c: f"sum(cast({c} as double))",
    "first": lambda c: f"first({c})",
    "last": lambda c: f"last({c})",
    "geomean": lambda c: f"exp(avg(ln({c})){OVER})",
    "list": lambda c: f"transform(collect_list(struct({c} as v)){OVER}, s -> s.v)",
    "max": lambda c: f"max({c})",
    "min": lambda c: f"min({c})",
    "sum": lambda c: f"sum({c})",
    "median": lambda c: f"percentile({c}, 0.5)",
    "mode": lambda c: f"mode() within group (order by {c})",
    "stddev_pop": lambda c: f"stddev_pop({c})",
    "stddev_samp": lambda c: f"stddev_samp({c})",
    "var_pop": lambda c: f"var_pop({c})",
    "var_samp": lambda c: f"var_samp({c})",
    "corr": lambda c: f"corr({c})",
}
#: Other names of the same.
ALIASES = {"mean": "avg", "stddev": "stddev_samp", "std": "stddev_samp", "variance": "var_samp", "var": "var_samp", "quantile": "quantile_disc"}


def product(c: str) -> str:
    """Product of a column's values in a window, multiplied in order. (Groups take `functions.product`, which keeps one number.)"""
    return f"aggregate(collect_list(cast({c} as double)){OVER}, 1D, (a, x) -> a * x)"


def quantile_cont(c: str, q: float | list) -> str:
    return f"percentile({c}, {_q(q)})"


def quantile_disc(c: str, q: float | list, kind: str) -> str:
    """The least value that so large a share of the values doesn't exceed, in the column's own type."""
    text = f"percentile_disc({_q(q)}) within group (order by {c})"
    return f"cast({text} as {f'array<{kind}>' if isinstance(q, list) else kind})"


def string_agg(c: str, separator: str) -> str:
    return f"array_join(collect_list(cast({c} as string)){OVER}, {_text(separator)})"


def histogram(c: str) -> str:
    """Value to count, in order of values: from one sort, by the places where a new value begins."""
    starts = "filter(sequence(0, size(s)), i -> i < size(s) and (i = 0 or get(s, i) <> get(s, i - 1)))"
    counts = "map_from_entries(transform(b, (p, k) -> struct(get(s, p) as key, coalesce(get(b, k + 1), size(s)) - p as value)))"
    return f"get(transform(array(array_sort(collect_list({c}){OVER})), s -> get(transform(array({starts}), b -> {counts}), 0)), 0)"


def bitstring(c: str, low: int, high: int) -> str:
    """A 1 for each value from low to high that occurs: the zeros before each value of the sorted set, and those after the last."""
    if not (isinstance(low, int) and isinstance(high, int)) or low > high:
        raise InvalidInputException("bitstring_agg needs whole numbers min <= max")
    values = f"array_sort(collect_set(case when cast({c} as bigint) between {low} and {high} then cast({c} as bigint) end){OVER})"
    ones = f"array_join(transform(s, (x, k) -> concat(repeat('0', cast(x - coalesce(get(s, k - 1), {low - 1}) - 1 as int)), '1')), '')"
    return f"get(transform(array({values}), s -> concat({ones}, repeat('0', cast({high} - coalesce(get(s, size(s) - 1), {low - 1}) as int)))), 0)"
