"""Type text of the SQL dialect, type factories, and their Spark types."""

from __future__ import annotations

import re
import typing
from types import UnionType

from pyspark.sql import types as T

from tessera.errors import InvalidInputException

# Names of simple types and the Spark types that hold them.
_SIMPLE: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "logical": T.BooleanType(),
    "tinyint": T.ByteType(), "int1": T.ByteType(), "smallint": T.ShortType(), "int2": T.ShortType(), "short": T.ShortType(),
    "integer": T.IntegerType(), "int": T.IntegerType(), "int4": T.IntegerType(), "signed": T.IntegerType(),
    "bigint": T.LongType(), "int8": T.LongType(), "long": T.LongType(),
    "utinyint": T.ShortType(), "usmallint": T.IntegerType(), "uinteger": T.LongType(), "ubigint": T.DecimalType(20, 0),
    "hugeint": T.DecimalType(38, 0), "uhugeint": T.DecimalType(38, 0), "int128": T.DecimalType(38, 0),
    "float": T.FloatType(), "float4": T.FloatType(), "real": T.FloatType(), "double": T.DoubleType(), "float8": T.DoubleType(),
    "varchar": T.StringType(), "text": T.StringType(), "string": T.StringType(), "char": T.StringType(), "bpchar": T.StringType(),
    "uuid": T.StringType(), "bit": T.StringType(), "bitstring": T.StringType(), "json": T.StringType(), "bignum": T.StringType(),
    "blob": T.BinaryType(), "bytea": T.BinaryType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "geometry": T.BinaryType(),
    "date": T.DateType(), "time": T.TimeType(), "time_ns": T.TimeType(),
    "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "timestamp_s": T.TimestampNTZType(), "timestamp_ms": T.TimestampNTZType(), "timestamp_ns": T.TimestampNTZType(), "timestamp_us": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(),
    "timetz": T.StructType([T.StructField("time", T.TimeType()), T.StructField("offset", T.IntegerType())]),
    "time with time zone": T.StructType([T.StructField("time", T.TimeType()), T.StructField("offset", T.IntegerType())]),
    "interval": T.CalendarIntervalType(), "variant": T.VariantType(), "sqlnull": T.NullType(), "null": T.NullType(),
}
_PYTHON = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), bytearray: T.BinaryType()}


def split_top(text: str, separator: str = ",") -> list[str]:
    """Split at separators that stand in no bracket and no quote."""
    parts, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == quote:
                if text[i + 1 : i + 2] == quote:
                    i += 1
                else:
                    quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == separator and depth == 0:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def _member(text: str) -> tuple[str, T.DataType]:
    found = re.fullmatch(r'\s*("(?:[^"]|"")+"|\w+)\s+(.+)', text, re.S)
    if not found:
        raise InvalidInputException(f"not a field: {text}")
    return found[1].strip('"').replace('""', '"'), sqltype(found[2])


def sqltype(text: str | T.DataType | type) -> T.DataType:
    """The Spark type of type text such as INTEGER[], DECIMAL(10, 2), STRUCT(a INT) or MAP(VARCHAR, INT), or of a Python type."""
    if isinstance(text, T.DataType):
        return text
    if not isinstance(text, str):
        return python_type(text)
    plain = " ".join(text.split())
    if found := re.fullmatch(r"(.+?)\s*\[(\d*)\]", plain):
        return array_type(sqltype(found[1]), int(found[2])) if found[2] else list_type(sqltype(found[1]))
    low = plain.lower()
    if low in _SIMPLE:
        return _SIMPLE[low]
    found = re.fullmatch(r"(\w+)\s*\((.*)\)", plain, re.S)
    if not found:
        raise InvalidInputException(f"unknown type: {text}")
    name, inner = found[1].lower(), split_top(found[2])
    if name in ("decimal", "numeric", "dec"):
        return decimal_type(int(inner[0]), int(inner[1]) if len(inner) > 1 else 0)
    if name in ("varchar", "char", "text", "string", "bpchar", "timestamp", "float", "bit"):
        return _SIMPLE[name]
    if name in ("struct", "row"):
        return struct_type(dict(map(_member, inner)))
    if name == "map":
        return map_type(sqltype(inner[0]), sqltype(inner[1]))
    if name == "union":
        return union_type(dict(map(_member, inner)))
    if name == "enum":
        return T.StringType()
    raise InvalidInputException(f"unknown type: {text}")


dtype = type_ = sqltype


def python_type(kind: typing.Any) -> T.DataType:
    """The Spark type of a Python annotation."""
    if kind in _PYTHON:
        return _PYTHON[kind]
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is list:
        return list_type(sqltype(args[0]))
    if origin is dict:
        return map_type(sqltype(args[0]), sqltype(args[1]))
    if origin in (typing.Union, UnionType):
        own = [a for a in args if a is not type(None)]
        return sqltype(own[0]) if len(own) == 1 else union_type({f"u{i + 1}": a for i, a in enumerate(own)})
    if isinstance(kind, dict):
        return struct_type(kind)
    if hasattr(kind, "dtype") or type(kind).__module__ == "numpy" or getattr(kind, "__module__", "") == "numpy":
        import numpy as np

        from pyspark.sql.pandas.types import from_arrow_type
        import pyarrow as pa

        return from_arrow_type(pa.from_numpy_dtype(np.dtype(kind)))
    raise InvalidInputException(f"no type stands for {kind!r}")


def list_type(child: T.DataType | str) -> T.ArrayType:
    return T.ArrayType(sqltype(child))


def array_type(child: T.DataType | str, size: int) -> T.ArrayType:
    """A list of fixed size; the size is checked by check_size."""
    if size < 1:
        raise InvalidInputException("an array has one element at least")
    out = T.ArrayType(sqltype(child))
    out.fixed_size = size
    return out


def check_size(column, size: int):
    """The array itself; an error where its size differs."""
    from pyspark.sql import functions as F

    return F.when(column.isNull() | (F.size(column) == size), column).otherwise(F.raise_error(F.lit(f"array of another size than {size}")))


def map_type(key: T.DataType | str, value: T.DataType | str) -> T.MapType:
    return T.MapType(sqltype(key), sqltype(value))


def struct_type(fields: dict | list) -> T.StructType:
    named = fields.items() if isinstance(fields, dict) else ((f"v{i + 1}", f) for i, f in enumerate(fields))
    return T.StructType([T.StructField(n, sqltype(t)) for n, t in named])


row_type = struct_type


def union_type(members: dict | list) -> T.StructType:
    """A tagged union as a struct: the tag, then each member, null but for the tagged one."""
    own = struct_type(members)
    return T.StructType([T.StructField("tag", T.StringType()), *own.fields])


def union_value(tag: str, value, kind: T.StructType):
    from pyspark.sql import functions as F

    return F.struct(F.lit(tag).alias("tag"), *[(value if f.name == tag else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields[1:]])


def enum_type(name: str, values: list[str]) -> T.StructField:
    """A string field that names its allowed values in order."""
    return T.StructField(name, T.StringType(), True, {"enum": list(values)})


def enum_position(column, values: list[str]):
    """Place of an enum's value in its order, for comparing and sorting; an error for other values."""
    from pyspark.sql import functions as F

    at = F.array_position(F.lit(list(values)), column)
    return F.when(at > 0, at).otherwise(F.when(column.isNotNull(), F.raise_error(F.lit("not a value of the enum")).cast("long")))


def decimal_type(width: int, scale: int) -> T.DecimalType:
    if not 1 <= width <= 38 or not 0 <= scale <= width:
        raise InvalidInputException(f"no decimal has {width} digits, {scale} of them after the point")
    return T.DecimalType(width, scale)


def string_type(collation: str | None = None) -> T.StringType:
    names = {None: None, "": None, "nocase": "UTF8_LCASE", "binary": None}
    own = names.get(collation.lower() if collation else None, collation)
    return T.StringType(own) if own else T.StringType()


def _name(text: str) -> str:
    """A member's name, quoted where it isn't a plain word."""
    return text if re.fullmatch(r"[A-Za-z_]\w*", text, re.A) else '"' + text.replace('"', '""') + '"'


def type_name(kind: T.DataType) -> str:
    """A Spark type as text of this dialect."""
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{_name(f.name)} {type_name(f.dataType)}" for f in kind.fields) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({type_name(kind.keyType)}, {type_name(kind.valueType)})"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    # Canonical names.
    names = {
        T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
        T.StringType: "VARCHAR", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.NullType: '"NULL"', T.CalendarIntervalType: "INTERVAL", T.VariantType: "VARIANT",
    }
    return names.get(type(kind), kind.simpleString().upper())
