"""Expressions: what relations project, filter, join and sort by. Each is a Spark column with its name."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import sql_text
from tessera.errors import InvalidInputException
from tessera.types import sqltype


def to_column(value: Any) -> Column:
    """Text is a column's name; an expression or column is itself; anything else is a constant."""
    if isinstance(value, Expression):
        return value.column
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return constant(value)


def constant(value: Any) -> Column:
    if isinstance(value, dict):
        return F.create_map(*[constant(x) for kv in value.items() for x in kv]) if value else F.create_map()
    if isinstance(value, (list, tuple)):
        return F.array(*[constant(v) for v in value])
    return F.lit(value)


def _sql(column: Column) -> str:
    """The SQL text of a column."""
    return re.sub(r"(?<![\w`)'])([-+*/%=<>&|^~!]+|and|or|not|in)\((?=[^)])", r"`\1`(", column._jc.node().sql())


class Expression:
    """A lazy value of a row."""

    def __init__(self, column: Column, name: str | None = None, order: tuple[str | None, str | None] = (None, None), cases: bool = False) -> None:
        self._column, self.name, self._order, self._cases = column, name, order, cases

    @property
    def column(self) -> Column:
        return self._column.alias(self.name) if self.name else self._column

    @property
    def bare(self) -> Column:
        return self._column

    @property
    def sort_column(self) -> Column:
        """The column with its order; nulls come last unless it says otherwise."""
        way, nulls = self._order
        return getattr(self._column, f"{way or 'asc'}_nulls_{nulls or 'last'}")()

    def _with(self, f: Callable[..., Column], *others: Any) -> Expression:
        return Expression(f(self._column, *[o.bare if isinstance(o, Expression) else to_column(o) for o in others]))

    def __add__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a + b, other)

    def __radd__(self, other: Any) -> Expression:
        return self._with(lambda a, b: b + a, other)

    def __sub__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a - b, other)

    def __rsub__(self, other: Any) -> Expression:
        return self._with(lambda a, b: b - a, other)

    def __mul__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a * b, other)

    def __rmul__(self, other: Any) -> Expression:
        return self._with(lambda a, b: b * a, other)

    def __truediv__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a / b, other)

    def __rtruediv__(self, other: Any) -> Expression:
        return self._with(lambda a, b: b / a, other)

    def __floordiv__(self, other: Any) -> Expression:
        return self._with(lambda a, b: F.call_function("div", a, b), other)

    def __rfloordiv__(self, other: Any) -> Expression:
        return self._with(lambda a, b: F.call_function("div", b, a), other)

    def __mod__(self, other: Any) -> Expression:
        return self._with(F.try_mod, other)

    def __rmod__(self, other: Any) -> Expression:
        return self._with(lambda a, b: F.try_mod(b, a), other)

    def __pow__(self, other: Any) -> Expression:
        return self._with(F.pow, other)

    def __rpow__(self, other: Any) -> Expression:
        return self._with(lambda a, b: F.pow(b, a), other)

    def __neg__(self) -> Expression:
        return Expression(-self._column)

    def __invert__(self) -> Expression:
        return Expression(~self._column)

    def __and__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a & b, other)

    def __rand__(self, other: Any) -> Expression:
        return self._with(lambda a, b: b & a, other)

    def __or__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a | b, other)

    def __ror__(self, other: Any) -> Expression:
        return self._with(lambda a, b: b | a, other)

    def __eq__(self, other: Any) -> Expression:  # type: ignore[override]
        return self._with(lambda a, b: a == b, other)

    def __ne__(self, other: Any) -> Expression:  # type: ignore[override]
        return self._with(lambda a, b: a != b, other)

    def __lt__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a < b, other)

    def __le__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a <= b, other)

    def __gt__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a > b, other)

    def __ge__(self, other: Any) -> Expression:
        return self._with(lambda a, b: a >= b, other)

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise InvalidInputException("an expression has no truth value; combine expressions with &, | and ~")

    def __repr__(self) -> str:
        return _sql(self.column)

    def show(self) -> None:
        print(repr(self))

    def alias(self, name: str) -> Expression:
        return Expression(self._column, name, self._order, self._cases)

    def get_name(self) -> str:
        text = self.name or repr(self)
        return text[1:-1] if re.fullmatch(r"`[^`]+`", text) else text

    def cast(self, kind: Any) -> Expression:
        return Expression(self._column.cast(sqltype(kind)), self.name)

    def try_cast(self, kind: Any) -> Expression:
        return Expression(self._column.try_cast(sqltype(kind)), self.name)

    def collate(self, collation: str) -> Expression:
        names = {"nocase": "UTF8_LCASE", "binary": "UTF8_BINARY", "noaccent": "UNICODE_AI"}
        return Expression(F.collate(self._column, names.get(collation.lower(), collation)))

    def isnull(self) -> Expression:
        return Expression(self._column.isNull())

    def isnotnull(self) -> Expression:
        return Expression(self._column.isNotNull())

    def isin(self, *values: Any) -> Expression:
        if not values:
            raise InvalidInputException("isin needs a value")
        return Expression(self._column.isin(*[to_column(v) for v in values]))

    def isnotin(self, *values: Any) -> Expression:
        if not values:
            raise InvalidInputException("isnotin needs a value")
        return ~self.isin(*values)

    def between(self, lower: Any, upper: Any) -> Expression:
        return self._with(lambda a, b, c: a.between(b, c), lower, upper)

    def asc(self) -> Expression:
        return Expression(self._column, self.name, ("asc", self._order[1]))

    def desc(self) -> Expression:
        return Expression(self._column, self.name, ("desc", self._order[1]))

    def nulls_first(self) -> Expression:
        return Expression(self._column, self.name, (self._order[0], "first"))

    def nulls_last(self) -> Expression:
        return Expression(self._column, self.name, (self._order[0], "last"))

    def when(self, condition: Expression, value: Any) -> Expression:
        if not self._cases:
            raise InvalidInputException("when follows a CASE expression only")
        return Expression(self._column.when(to_column(condition), to_column(value)), cases=True)

    def otherwise(self, value: Any) -> Expression:
        if not self._cases:
            raise InvalidInputException("otherwise follows a CASE expression only")
        return Expression(self._column.otherwise(to_column(value)))


class Star(Expression):
    """All columns but the excluded ones, known once a relation gives its own."""

    def __init__(self, exclude: list | None = None) -> None:
        super().__init__(F.col("*"))
        self.exclude = {(e.get_name() if isinstance(e, Expression) else str(e)).lower() for e in exclude or []}

    def columns(self, names: list[str]) -> list[Column]:
        if missing := self.exclude - {n.lower() for n in names}:
            raise InvalidInputException(f"no such columns to exclude: {', '.join(sorted(missing))}")
        return [F.col(sql_text.quoted(n)) for n in names if n.lower() not in self.exclude]


class Default:
    """DEFAULT, in the values of an update or insert."""


def ConstantExpression(value: Any) -> Expression:
    return Expression(constant(value))


def ColumnExpression(*names: str) -> Expression:
    if names == ("*",):
        return Star()
    return Expression(F.col(".".join(sql_text.quoted(p) for n in names for p in n.split("."))), None)


def DefaultExpression() -> Default:
    return Default()


def CaseExpression(condition: Expression, value: Any) -> Expression:
    return Expression(F.when(to_column(condition), to_column(value)), cases=True)


def StarExpression(*, exclude: list | None = None) -> Star:
    return Star(exclude)


#: Operators that go by a function's name.
_OPERATORS: dict[str, Callable[..., Column]] = {
    "~~": lambda a, b: F.call_function("like", a, b),
    "!~~": lambda a, b: ~F.call_function("like", a, b),
    "~~*": lambda a, b: F.call_function("ilike", a, b),
    "!~~*": lambda a, b: ~F.call_function("ilike", a, b),
    "+": lambda a, b: a + b,
    "-": lambda a, *b: a - b[0] if b else -a,
    "*": lambda a, b: a * b,
    "/": lambda a, b: a / b,
    "//": lambda a, b: F.call_function("div", a, b),
    "%": F.try_mod,
    "**": F.pow,
    "||": lambda a, b: F.concat(a, b),
    "list": lambda a: F.transform(F.collect_list(F.struct(a.alias("v"))), lambda s: s["v"]),
    "count_star": lambda: F.count("*"),
    "geomean": lambda a: F.exp(F.avg(F.ln(a))),
}


def FunctionExpression(name: str, *args: Any) -> Expression:
    columns = [a.bare if isinstance(a, Expression) else to_column(a) for a in args]
    if isinstance(args[-1:] and args[-1], Lambda):
        if name in ("list_reduce", "reduce"):
            values = columns[0]
            return Expression(F.call_function("reduce", F.slice(values, F.lit(2), F.size(values)), F.element_at(values, 1), *columns[1:]))
    if name in _OPERATORS:
        return Expression(_OPERATORS[name](*columns))
    return Expression(F.call_function(sql_text.FUNCTIONS.get(name.lower(), name), *columns))


def CoalesceOperator(*args: Any) -> Expression:
    if not args:
        raise InvalidInputException("coalesce needs a value")
    return Expression(F.coalesce(*[to_column(a) for a in args]))


class Lambda(Expression):
    """A function of the elements of a list."""

    def __init__(self, names: tuple[str, ...], body: Any) -> None:
        text = repr(body) if isinstance(body, Expression) else str(body)
        own = names[0] if len(names) == 1 else f"({', '.join(names)})"
        super().__init__(F.expr(f"{own} -> {sql_text.expression(text)}"))


def LambdaExpression(names: str | tuple, body: Any) -> Lambda:
    own = (names,) if isinstance(names, (str, Expression)) else tuple(names)
    return Lambda(tuple(n.get_name() if isinstance(n, Expression) else str(n) for n in own), body)


def SQLExpression(text: str) -> Expression:
    from tessera.types import split_top

    if len(split_top(text)) != 1:
        raise InvalidInputException("one expression is needed")
    return Expression(F.expr(sql_text.expression(text)))
