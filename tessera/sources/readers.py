"""JSON and Parquet readers, and frames from Python objects."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidInputException
from tessera.sources.csv import java_pattern
from tessera.sources.files import gather, with_file_options
from tessera.types import sqltype


def read_json(
    spark: SparkSession, path_or_buffer: Any, *, columns: dict | None = None, sample_size: int | None = None, maximum_depth: int | None = None, records: str | bool | None = None, format: str | None = None,  # noqa: A002
    date_format: str | None = None, timestamp_format: str | None = None, compression: str | None = None, maximum_object_size: int | None = None, ignore_errors: bool | None = None, convert_strings_to_integers: bool | None = None,
    field_appearance_threshold: float | None = None, map_inference_threshold: int | None = None, maximum_sample_files: int | None = None, filename: Any = None, hive_partitioning: bool | None = None, union_by_name: bool | None = None,
    hive_types: dict | None = None, hive_types_autocast: bool | None = None,
) -> DataFrame:
    """JSON files: an object a line (newline_delimited), arrays of objects (array), or either (auto)."""
    if format not in (None, "auto", "newline_delimited", "nd", "unstructured", "array"):
        raise InvalidInputException(f"format is auto, newline_delimited, unstructured or array, not {format}")
    paths = gather(spark, path_or_buffer, ".json")
    reader = spark.read
    whole = format in ("array", "unstructured")
    if format in (None, "auto"):
        first = spark.read.text(paths).filter("trim(value) <> ''").limit(1).collect()
        whole = bool(first) and not (first[0][0].strip().startswith("{") and first[0][0].strip().endswith("}"))
    reader = reader.option("multiLine", whole)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(n, sqltype(t)) for n, t in columns.items()]))
    if date_format:
        reader = reader.option("dateFormat", java_pattern(date_format))
    if timestamp_format:
        reader = reader.option("timestampFormat", java_pattern(timestamp_format)).option("timestampNTZFormat", java_pattern(timestamp_format))
    reader = reader.option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST")
    df = reader.json(paths)
    if maximum_depth == 0 or str(records).lower() == "false":
        names = df.columns
        df = df.select(F.to_json(F.struct(*[f"`{n}`" for n in names])).alias("json"))
    elif maximum_depth == 1:
        df = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields])
    if convert_strings_to_integers:
        texts = [f.name for f in df.schema.fields if f.dataType == T.StringType()]
        if texts:
            fits = df.agg(*[F.every(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("bigint").isNotNull()).alias(c) for c in texts]).first()
            df = df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if c in texts and fits[c] else F.col(f"`{c}`") for c in df.columns])
    return with_file_options(df, filename)


def read_parquet(
    spark: SparkSession, path_or_buffer: Any, binary_as_string: bool = False, *, file_row_number: bool = False, filename: Any = False, hive_partitioning: bool | None = None, union_by_name: bool = False, compression: str | None = None,
) -> DataFrame:
    """Parquet files; filters and columns reach the scan."""
    reader = spark.read.option("mergeSchema", union_by_name)
    if hive_partitioning is False:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.parquet(*gather(spark, path_or_buffer, ".parquet"))
    if binary_as_string:
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType == T.BinaryType() else F.col(f"`{f.name}`") for f in df.schema.fields])
    return with_file_options(df, filename, file_row_number)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """name and type of a Parquet file's columns."""
    schema = spark.read.parquet(path).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in schema], "name string, type string, nullable boolean")


def is_table_like(value: Any) -> bool:
    """Whether from_object can make a frame of a value."""
    kinds = {"DataFrame", "LazyFrame", "Table", "RecordBatch", "RecordBatchReader", "Dataset", "FileSystemDataset", "InMemoryDataset", "Scanner", "ndarray", "Relation"}
    return any(k.__name__ in kinds for k in type(value).__mro__) or isinstance(value, dict) and bool(value) and all(hasattr(v, "__len__") for v in value.values()) or isinstance(value, list) and bool(value) and all(hasattr(v, "dtype") for v in value)


def from_object(spark: SparkSession, value: Any, sample: int = 1000) -> DataFrame:
    """A frame of a pandas or Polars frame, an Arrow object, numpy arrays (2-D: a row is a column) or a dictionary of them, or a relation."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    if isinstance(value, DataFrame):
        return value
    if hasattr(value, "dataframe") and isinstance(value.dataframe, DataFrame):
        return value.dataframe
    if hasattr(value, "collect") and type(value).__name__ == "LazyFrame":
        value = value.collect()
    if type(value).__module__.startswith("polars"):
        value = value.to_arrow()
    if isinstance(value, np.ndarray):
        value = pd.DataFrame({f"column{i}": c for i, c in enumerate(np.atleast_2d(value))})
    elif isinstance(value, list) and value and isinstance(value[0], np.ndarray):
        value = pd.DataFrame({f"column{i}": c for i, c in enumerate(value)})
    elif isinstance(value, dict):
        value = pd.DataFrame(value)
    if isinstance(value, pd.DataFrame):
        return spark.createDataFrame(_arrow(value, sample))
    if isinstance(value, pa.RecordBatch):
        value = pa.Table.from_batches([value])
    elif hasattr(value, "read_all"):
        value = value.read_all()
    elif hasattr(value, "to_table"):
        value = value.to_table()
    elif not isinstance(value, pa.Table) and hasattr(value, "__arrow_c_stream__"):
        value = pa.table(value)
    if isinstance(value, pa.Table):
        return spark.createDataFrame(value)
    raise InvalidInputException(f"no relation can be made of {type(value).__name__}")


def _arrow(frame: Any, sample: int) -> Any:
    """A pandas frame in Arrow: categories as text, objects by a common type of a sample, else as text."""
    import pandas as pd
    import pyarrow as pa

    columns = {}
    for name in frame.columns:
        values = frame[name]
        if isinstance(values.dtype, pd.CategoricalDtype):
            values = values.astype(object)
        try:
            kind = pa.infer_type(values.head(sample), from_pandas=True) if values.dtype == object and sample else None
            columns[str(name)] = pa.Array.from_pandas(values, type=None if kind is None or pa.types.is_null(kind) else kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            columns[str(name)] = pa.array([None if v is None or v is pd.NaT or isinstance(v, float) and v != v else str(v) for v in values], pa.string())
    return pa.table(columns)
