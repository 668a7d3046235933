"""Paths, file objects and options that all file readers share."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InvalidInputException

_filesystems: dict[str, Any] = {}


def register_filesystem(fs: Any) -> None:
    """Make the paths of an fsspec filesystem readable."""
    names = [fs.protocol] if isinstance(fs.protocol, str) else list(fs.protocol)
    _filesystems.update(dict.fromkeys(names, fs))


def unregister_filesystem(name: str) -> None:
    if name not in _filesystems:
        raise InvalidInputException(f"no filesystem is registered as {name}")
    del _filesystems[name]


def list_filesystems() -> list[str]:
    return sorted(_filesystems)


def filesystem_is_registered(name: str) -> bool:
    return name in _filesystems


def gather(spark: SparkSession, path_or_buffer: Any, suffix: str) -> list[str]:
    """Paths that Spark can read. File objects, and paths of fsspec filesystems, are spooled to the shared folder first."""
    given = path_or_buffer if isinstance(path_or_buffer, (list, tuple)) else [path_or_buffer]
    if not given:
        raise InvalidInputException("no file is named")
    out = []
    for one in given:
        if hasattr(one, "read"):
            out.append(_spool(spark, one.read(), suffix))
            continue
        path = os.fspath(one)
        scheme = path.split("://", 1)[0] if "://" in path else ""
        if scheme in _filesystems:
            with _filesystems[scheme].open(path, "rb") as f:
                out.append(_spool(spark, f.read(), suffix))
        else:
            out.append(path)
    return out


def _spool(spark: SparkSession, data: str | bytes, suffix: str) -> str:
    """Write a file object's content where driver and executors can read it."""
    name = work_folder(spark) + suffix
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        out.close()
    return name


def with_file_options(df: DataFrame, filename: Any = None, file_row_number: bool = False) -> DataFrame:
    if file_row_number:
        df = df.withColumn("file_row_number", F.col("_metadata.row_index"))
    if filename:
        df = df.withColumn(filename if isinstance(filename, str) else "filename", F.col("_metadata.file_path"))
    return df


def work_folder(spark: SparkSession) -> str:
    """A folder for intermediate files that driver and executors share: under spark.checkpoint.dir, or a temporary one where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or tempfile.mkdtemp(prefix="tessera-")
    return f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"
