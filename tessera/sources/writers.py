"""Parquet and CSV sinks, options by their own names."""

from __future__ import annotations

import csv
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidInputException
from tessera.sources.csv import java_pattern


def _partitioned(df: DataFrame, partition_by: list[str] | None, keep: bool) -> tuple[DataFrame, list[str]]:
    """The frame and its partitioning columns; those to be kept in the files too are copied."""
    names = list(partition_by or [])
    if unknown := [n for n in names if n.lower() not in map(str.lower, df.columns)]:
        raise InvalidInputException(f"no columns to partition by: {', '.join(unknown)}")
    if keep and names:
        for n in names:
            df = df.withColumn(f"{n}_value", F.col(f"`{n}`"))
    return df, names


def write_parquet(
    df: DataFrame, file_name: str, *, compression: str | None = None, field_ids: Any = None, row_group_size_bytes: int | str | None = None, row_group_size: int | None = None, overwrite: bool | None = None, per_thread_output: bool | None = None,
    use_tmp_file: bool | None = None, partition_by: list[str] | None = None, write_partition_columns: bool | None = None, append: bool | None = None, filename_pattern: str | None = None, file_size_bytes: int | str | None = None,
) -> None:
    """A directory of Parquet files."""
    df, names = _partitioned(df, partition_by, bool(write_partition_columns))
    if field_ids:
        df = df.select(*[F.col(f"`{c}`").alias(c, metadata={"parquet.field.id": field_ids[c]}) if c in field_ids else F.col(f"`{c}`") for c in df.columns])
    writer = df.write.mode("overwrite" if overwrite else "append" if append else "errorifexists").option("compression", compression or "snappy")
    if row_group_size_bytes:
        writer = writer.option("parquet.block.size", int(row_group_size_bytes))
    if row_group_size:
        writer = writer.option("parquet.block.row.count.limit", int(row_group_size))
    if file_size_bytes:
        width = max(1, sum(32 if f.dataType.simpleString() == "string" else 8 for f in df.schema.fields))  # an estimate of a row's bytes
        writer = writer.option("maxRecordsPerFile", max(1, int(file_size_bytes) // width))
    (writer.partitionBy(*names) if names else writer).parquet(file_name)


def write_csv(
    df: DataFrame, file_name: str, *, sep: str | None = None, na_rep: str | None = None, header: bool | None = None, quotechar: str | None = None, escapechar: str | None = None, date_format: str | None = None, timestamp_format: str | None = None,
    quoting: Any = None, encoding: str | None = None, compression: str | None = None, overwrite: bool | None = None, per_thread_output: bool | None = None, use_tmp_file: bool | None = None, partition_by: list[str] | None = None, write_partition_columns: bool | None = None,
) -> None:
    """A directory of CSV files."""
    if quoting is not None and quoting not in ("force", "all", csv.QUOTE_ALL):
        raise InvalidInputException("quoting is 'force', 'all' or csv.QUOTE_ALL")
    if encoding is not None and encoding.lower().replace("-", "") != "utf8":
        raise InvalidInputException("files are written in UTF-8 only")
    df, names = _partitioned(df, partition_by, bool(write_partition_columns))
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("header", header is not False).option("nullValue", na_rep or "").option("emptyValue", '""' if not na_rep else "")
    options = {"sep": sep, "quote": quotechar, "escape": escapechar, "compression": compression, "dateFormat": date_format and java_pattern(date_format), "timestampFormat": timestamp_format and java_pattern(timestamp_format), "timestampNTZFormat": timestamp_format and java_pattern(timestamp_format)}
    for k, v in options.items():
        if v is not None:
            writer = writer.option(k, v)
    if quoting is not None:
        writer = writer.option("quoteAll", True)
    (writer.partitionBy(*names) if names else writer).csv(file_name)
