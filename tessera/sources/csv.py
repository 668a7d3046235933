"""CSV files: the reader's options by their own names, each translated to Spark or refused."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidInputException, NotImplementedException
from tessera.sources.files import gather, with_file_options
from tessera.types import sqltype

#: Options that change speed only.
_IGNORED = {"parallel", "buffer_size", "files_to_sniff"}
#: Lines that separator and header are told from, unless sample_size says otherwise.
_SNIFFED = 20480
# Suffixes of compressed files, by which Spark knows them.
_SUFFIXES = {"gzip": (".gz",), "zstd": (".zst", ".zstd"), "bzip2": (".bz2",), "snappy": (".snappy",), "lz4": (".lz4",)}
_KNOWN = _IGNORED | {
    "header", "sep", "delimiter", "delim", "dtype", "dtypes", "types", "column_types", "columns", "names", "column_names", "na_values", "nullstr", "skiprows", "skip", "quotechar", "quote", "escapechar", "escape", "comment", "thousands", "decimal", "decimal_separator",
    "encoding", "date_format", "dateformat", "timestamp_format", "timestampformat", "auto_detect", "all_varchar", "normalize_names", "null_padding", "new_line", "lineterminator", "ignore_errors", "store_rejects", "rejects_table", "rejects_scan", "force_not_null", "allow_quoted_nulls", "strict_mode",
    "filename", "hive_partitioning", "union_by_name", "hive_types", "hive_types_autocast",
    "sample_size", "max_line_size", "maximum_line_size", "auto_type_candidates", "compression", "encoding_errors", "rejects_limit",
}
# strptime's directives and Java's patterns.
_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%-m": "M", "%d": "dd", "%-d": "d", "%H": "HH", "%-H": "H", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%g": "SSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%Z": "VV", "%%": "%"}


def java_pattern(text: str) -> str:
    """A strptime format as a Java pattern."""
    out, i = "", 0
    while i < len(text):
        key = text[i : i + 3] if text[i : i + 2] == "%-" else text[i : i + 2]
        if text[i] == "%":
            if key not in _DIRECTIVES:
                raise InvalidInputException(f"no such format: {key}")
            out, i = out + _DIRECTIVES[key], i + len(key)
        else:
            out, i = out + (f"'{text[i]}'" if text[i].isalpha() else text[i]), i + 1
    return out


def read_csv(spark: SparkSession, path_or_buffer: Any, **options: Any) -> DataFrame:
    own = {k: v for k, v in options.items() if v is not None}
    for name in own.keys() - _KNOWN:
        near = difflib.get_close_matches(name, sorted(_KNOWN), 3, 0)
        raise InvalidInputException(f"read_csv has no option {name}; near it are {', '.join(near)}")

    def get(*names: str, default: Any = None) -> Any:
        given = [n for n in names if n in own]
        if len(given) > 1:
            raise InvalidInputException(f"{' and '.join(given)} are the same option")
        return own[given[0]] if given else default

    paths = gather(spark, path_or_buffer, ".csv")
    if (compression := get("compression", default="auto")) not in ("auto", "none", "uncompressed") and not all(p.endswith(_SUFFIXES.get(compression, ())) for p in paths):
        raise NotImplementedException(f"files of compression {compression} are known by their suffix: {', '.join(_SUFFIXES.get(compression, ('none',)))}")
    if get("encoding_errors", default="replace") not in ("replace",):
        raise NotImplementedException("bytes that aren't of the encoding are replaced")
    if get("hive_types_autocast", default=True) is False:
        raise NotImplementedException("types of partitions are inferred unless spark.sql.sources.partitionColumnTypeInference.enabled is false")
    reader = spark.read
    if get("hive_partitioning") is False:
        reader = reader.option("recursiveFileLookup", True)
    if (longest := get("max_line_size", "maximum_line_size")) is not None:
        reader = reader.option("maxCharsPerColumn", int(longest))
    header = get("header")
    if isinstance(header, int) and not isinstance(header, bool):
        if header != 0:
            raise InvalidInputException("header is true, false or 0")
        header = True
    separator = get("sep", "delimiter", "delim")
    sample = None
    if (separator is None or header is None) and get("auto_detect", default=True):
        lines = int(get("sample_size", default=_SNIFFED))
        lines = lines if lines > 0 else _SNIFFED
        sample = [r[0] for r in spark.read.text(paths).limit(lines + int(get("skiprows", "skip", default=0))).collect()][int(get("skiprows", "skip", default=0)) :]
        separator = separator or _sniff_separator(sample)
        header = _sniff_header(sample, separator) if header is None else header
    reader = reader.option("sep", separator or ",").option("header", bool(header)).option("quote", get("quotechar", "quote", default='"')).option("escape", get("escapechar", "escape", default='"'))
    reader = reader.option("encoding", get("encoding", default="utf-8")).option("enforceSchema", True)
    for name, names in (("comment", ("comment",)), ("lineSep", ("new_line", "lineterminator"))):
        if (value := get(*names)) is not None:
            reader = reader.option(name, value.replace("\\n", "\n").replace("\\r", "\r"))
    date, stamp = get("date_format", "dateformat"), get("timestamp_format", "timestampformat")
    if date:
        reader = reader.option("dateFormat", java_pattern(date)).option("prefersDate", True)
    if stamp:
        reader = reader.option("timestampFormat", java_pattern(stamp)).option("timestampNTZFormat", java_pattern(stamp))
    nulls = get("na_values", "nullstr", default="")
    nulls = [nulls] if isinstance(nulls, str) else list(nulls)
    reader = reader.option("nullValue", nulls[0])
    if get("allow_quoted_nulls") is False:
        raise NotImplementedException("Spark reads quoted nulls as nulls")
    thousands, decimal = get("thousands"), get("decimal", "decimal_separator", default=".")
    candidates = get("auto_type_candidates")
    plain = bool(get("all_varchar", default=False)) or thousands or decimal != "." or len(nulls) > 1 or candidates is not None
    infer = bool(get("auto_detect", default=True)) and not plain
    reader = reader.option("inferSchema", infer)
    rejecting = bool(get("store_rejects") or own.keys() & {"rejects_table", "rejects_scan", "rejects_limit"})
    if get("ignore_errors"):
        reader = reader.option("mode", "DROPMALFORMED")
    elif not rejecting and get("strict_mode") and not get("null_padding"):
        reader = reader.option("mode", "FAILFAST")
    if get("union_by_name"):
        parts = [reader.csv(p) for p in paths]
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part, allowMissingColumns=True)
    else:
        skip = int(get("skiprows", "skip", default=0))
        if skip:
            df = reader.csv(_without_first(spark, paths, skip))
        else:
            df = reader.csv(paths)
    columns = get("columns")
    names = get("names", "column_names")
    if columns:
        names = list(columns)
    elif not header and not names:
        names = [f"column{i}" for i in range(len(df.columns))]
    if names:
        if len(names) > len(df.columns):
            raise InvalidInputException("there are more names than columns")
        if len(set(map(str.lower, names))) < len(names):
            raise InvalidInputException("names repeat")
        df = df.toDF(*names, *df.columns[len(names) :])
    if len(nulls) > 1:
        df = df.select(*[F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if get("normalize_names"):
        df = df.toDF(*["_" + c if c[:1].isdigit() else c for c in ("".join(x if x.isalnum() else "_" for x in c.strip().lower()).strip("_") or "_" for c in df.columns)])
    wanted = columns or get("dtype", "dtypes", "types", "column_types") or {}
    wanted = wanted if isinstance(wanted, list) else dict(wanted) | (get("hive_types") or {})
    if isinstance(wanted, list):
        wanted = dict(zip(df.columns, wanted))
    if unknown := {w.lower() for w in wanted} - {c.lower() for c in df.columns}:
        raise InvalidInputException(f"types are given for columns that aren't there: {', '.join(sorted(unknown))}")
    kinds = {k.lower(): sqltype(v) for k, v in wanted.items()}
    if plain and not get("all_varchar") and get("auto_detect", default=True):
        kinds = (_inferred(df, thousands, decimal) if candidates is None else _first_fitting(df, [sqltype(c) for c in candidates])) | kinds
    if rejecting or get("ignore_errors") and kinds:
        df = _without_rejects(spark, paths, df, kinds, int(get("skiprows", "skip", default=0)) + bool(header), separator or ",", own, rejecting)
        own.pop("filename", None)
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    df = df.select(*[_cast(c, kinds.get(c.lower()), thousands, decimal, date if c in texts else None) for c in df.columns])
    must = {c.lower() for c in get("force_not_null", default=[])}
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c.lower() in must else F.col(f"`{c}`") for c in df.columns])
    return with_file_options(df, own.get("filename"))


def _cast(name: str, kind: Any, thousands: str | None, decimal: str, date: str | None):
    column = F.col(f"`{name}`")
    if kind is None:
        return column
    if kind.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        text = column.cast("string")
        text = F.replace(text, F.lit(thousands), F.lit("")) if thousands else text
        text = F.replace(text, F.lit(decimal), F.lit(".")) if decimal != "." else text
        return text.cast(kind).alias(name)
    if date and kind.typeName() == "date":
        return F.to_date(column, java_pattern(date)).alias(name)
    return column.cast(kind).alias(name)


def _inferred(df: DataFrame, thousands: str | None, decimal: str) -> dict:
    """Number types of text columns, by one pass of aggregates."""

    def number(c: str):
        text = F.trim(F.col(f"`{c}`"))
        text = F.replace(text, F.lit(thousands), F.lit("")) if thousands else text
        return F.replace(text, F.lit(decimal), F.lit(".")) if decimal != "." else text

    checks = [F.struct(F.every(number(c).try_cast("bigint").isNotNull() | F.col(f"`{c}`").isNull()).alias("i"), F.every(number(c).try_cast("double").isNotNull() | F.col(f"`{c}`").isNull()).alias("d")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*checks).first()
    return {c.lower(): sqltype("bigint" if row[i]["i"] else "double") for i, c in enumerate(df.columns) if row[i]["d"]}


def _first_fitting(df: DataFrame, candidates: list) -> dict:
    """For each column the first of the types that all its values can be cast to; others stay text. One pass."""
    narrow = [k for k in candidates if k.typeName() != "string"]
    checks = [F.struct(*[F.every(F.col(f"`{c}`").try_cast(k).isNotNull() | F.col(f"`{c}`").isNull()).alias(f"k{j}") for j, k in enumerate(narrow)]).alias(f"c{i}") for i, c in enumerate(df.columns)]
    if not narrow:
        return {}
    row = df.agg(*checks).first()
    return {c.lower(): next(k for j, k in enumerate(narrow) if row[i][j]) for i, c in enumerate(df.columns) if any(row[i])}


def _without_rejects(spark: SparkSession, paths: list[str], df: DataFrame, kinds: dict, first: int, separator: str, own: dict, keep: bool) -> DataFrame:
    """The good lines as rows; where they are kept, the lines that don't parse become a view (file_path, line), the files that were read another."""
    fields = [T.StructField(f.name, kinds.get(f.name.lower(), f.dataType)) for f in df.schema.fields]
    options = {"sep": separator, "quote": own.get("quotechar", own.get("quote", '"')), "escape": own.get("escapechar", own.get("escape", '"')), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = _lines_after(spark, paths, first)
    ddl = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())]).toDDL()
    parsed = lines.filter("length(value) > 0").select("file_path", "value", F.from_csv("value", ddl, options).alias("r"))
    if keep:
        bad = parsed.filter("r._corrupt_record is not null").select("file_path", F.col("value").alias("line"))
        if (most := own.get("rejects_limit")) and int(most) > 0:
            bad = bad.limit(int(most))
        bad.createOrReplaceTempView(own.get("rejects_table") or "reject_errors")
        spark.createDataFrame([(p, separator) for p in paths], "file_path string, delimiter string").createOrReplaceTempView(own.get("rejects_scan") or "reject_scans")
    name = own.get("filename")
    return parsed.filter("r._corrupt_record is null").select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in fields], *([F.col("file_path").alias(name if isinstance(name, str) else "filename")] if name else []))


def _sniff_separator(lines: list[str]) -> str:
    """The separator that gives most columns, the same number in most lines."""
    best, score = ",", 0
    for s in (",", "|", ";", "\t"):
        counts = [line.count(s) for line in lines if line]
        usual = max(set(counts), key=counts.count, default=0)
        if (now := usual * counts.count(usual)) > score:
            best, score = s, now
    return best


def _sniff_header(lines: list[str], separator: str) -> bool:
    """Whether the first line is of words above values of another kind."""

    def is_value(x: str) -> bool:
        x = x.strip().strip('"')
        try:
            float(x)
            return True
        except ValueError:
            return x == "" or (len(x) >= 8 and x[:4].isdigit() and x[4] == "-") or x.lower() in ("true", "false")

    if not lines:
        return False
    first = lines[0].split(separator)
    if any(is_value(x) for x in first):
        return False
    rest = [line.split(separator) for line in lines[1:] if line]
    return not rest or any(is_value(x) for row in rest for x in row)


def _without_first(spark: SparkSession, paths: list[str], n: int):
    """Lines of files but the first n of each."""
    return _lines_after(spark, paths, n).select("value").rdd.map(lambda r: r[0])


def _lines_after(spark: SparkSession, paths: list[str], n: int) -> DataFrame:
    """Lines of files but the first n of each, in their order: value, file_path."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("begin"))
    if not n:
        return lines.select("value", "file_path")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}  # a task reads a file's block from its begin on
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            first = pc.equal(batch.column(2), 0)
            for path in pc.unique(batch.column(1).filter(first)).to_pylist():
                at = np.flatnonzero(pc.and_(pc.equal(batch.column(1), path), first))
                keep[at[: max(0, n - seen.get(path, 0))]] = False
                seen[path] = seen.get(path, 0) + len(at)
            yield batch.select(["value", "file_path"]).filter(pa.array(keep))

    return lines.mapInArrow(drop, "value string, file_path string")
