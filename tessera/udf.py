"""Python functions in SQL and expressions: row by row or by Arrow arrays, with null and error handling."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.errors import CatalogException, InvalidInputException
from tessera.types import sqltype


def _signature(function: Callable, parameters: list | None, return_type: Any) -> tuple[int | None, Any]:
    """How many arguments (None: any number), and the type of the result."""
    sign = inspect.signature(function)
    varied = any(p.kind is p.VAR_POSITIONAL for p in sign.parameters.values())
    if return_type is None:
        if sign.return_annotation is inspect.Signature.empty:
            raise InvalidInputException("the function's return type can't be told; give return_type")
        return_type = sign.return_annotation
        if isinstance(return_type, str):
            return_type = inspect.get_annotations(function, eval_str=True)["return"]
    count = None if varied and parameters is None else len(parameters) if parameters is not None else len(sign.parameters)
    return count, sqltype(return_type)


def native(function: Callable, kind: Any, special_nulls: bool, return_null: bool):
    @functools.wraps(function)
    def call(*args: Any) -> Any:
        if not special_nulls and any(a is None for a in args):
            return None
        try:
            out = function(*args)
        except Exception:
            if return_null:
                return None
            raise
        if out is None and not special_nulls:
            raise ValueError("the function returned None; null_handling='special' allows that")
        return out

    call.__signature__ = inspect.Signature([inspect.Parameter("args", inspect.Parameter.VAR_POSITIONAL)])
    call.__annotations__ = {}
    return F.udf(call, kind)


def arrow(function: Callable, kind: Any, special_nulls: bool, return_null: bool):
    import pyarrow as pa
    import pyarrow.compute as pc

    def call(*args: Any) -> Any:
        n = len(args[0]) if args else 0
        gone = None
        if not special_nulls and args:
            gone = functools.reduce(pc.or_, [a.is_null() for a in args])
            if pc.any(gone).as_py():
                keep = pc.invert(gone)
                args = tuple(a.filter(keep) for a in args)
            else:
                gone = None
        try:
            out = function(*args)
        except Exception:
            if return_null:
                return pa.nulls(n)
            raise
        out = out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out if isinstance(out, pa.Array) else pa.array(out)
        if len(out) != (n if gone is None else n - pc.sum(gone).as_py()):
            raise ValueError("the function returned another number of rows than it got")
        if gone is None:
            return out
        at = pc.subtract(pc.cumulative_sum(pc.cast(pc.invert(gone), pa.int64())), 1)
        return out.take(pc.if_else(gone, pa.scalar(None, pa.int64()), at))

    def typed(*args: pa.Array) -> pa.Array:
        return call(*args)

    from pyspark.sql.pandas.types import to_arrow_type

    wanted = to_arrow_type(kind)

    def cast(*args: pa.Array) -> pa.Array:
        out = typed(*args)
        return out if out.type == wanted else out.cast(wanted)

    from pyspark.sql.functions import ArrowUDFType

    return F.arrow_udf(cast, kind, ArrowUDFType.SCALAR)


class Functions:
    """The functions that a connection has registered."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._own = spark, {}

    def create(
        self, name: str, function: Callable, parameters: list | None = None, return_type: Any = None, *, type: str = "native", null_handling: str = "default", exception_handling: str = "default", side_effects: bool = False,  # noqa: A002
    ) -> Any:
        if name.lower() in self._own:
            raise CatalogException(f"a function {name} is registered already")
        for value, allowed in ((type, ("native", "arrow")), (null_handling, ("default", "special")), (exception_handling, ("default", "return_null"))):
            if value not in allowed:
                raise InvalidInputException(f"{value} is none of {', '.join(allowed)}")
        _, kind = _signature(function, parameters, return_type)
        make = arrow if type == "arrow" else native
        made = make(function, kind, null_handling == "special", exception_handling == "return_null")
        if side_effects:
            made = made.asNondeterministic()
        self._spark.udf.register(name, made)
        self._own[name.lower()] = made
        return made

    def remove(self, name: str) -> None:
        if name.lower() not in self._own:
            raise CatalogException(f"no function {name} is registered")
        self._spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        del self._own[name.lower()]
