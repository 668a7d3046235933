"""A query for each option of the CSV reader: the nations as text of some form, read back."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.connection import Connection
from tessera.errors import InvalidInputException
from tessera.plans import Query
from tessera.plans.tables import frame
from tessera.sources.files import work_folder

QUERIES: dict[str, tuple[Query, str | None]] = {}


def _read(name: str, line: Callable[[Row], str], sql: str, head: str = "k,name,region\n", end: str = "\n", tail: str = "", **options: Any) -> None:
    """A line for each nation after a head, read with options."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = frame(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
        text = head + "".join(line(r) + end for r in rows) + tail
        return Connection(spark).read_csv(io.StringIO(text, newline=""), **options).dataframe

    QUERIES[f"csv_{name}"] = (run, sql)


def _plain(r: Row) -> str:
    return f"{r.n_nationkey},{r.n_name},{r.n_regionkey}"


_ALL = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation"
_read("sep", lambda r: _plain(r).replace(",", "|"), _ALL, "k|name|region\n", sep="|", header=True)
_read("names", _plain, "SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation", "", names=["a", "b", "c"], header=False)
_read("nullstr", lambda r: _plain(r) if r.n_regionkey != 1 else f"{r.n_nationkey},{r.n_name},NA", "SELECT n_nationkey AS k, n_name AS name, nullif(n_regionkey, 1) AS region FROM nation", nullstr="NA", header=True)
_read("na_values", lambda r: f"{r.n_nationkey},{r.n_name},{('NA', '-', r.n_regionkey)[min(r.n_regionkey, 2)]}", "SELECT n_nationkey::BIGINT AS k, n_name AS name, CASE WHEN n_regionkey > 1 THEN n_regionkey::BIGINT END AS region FROM nation", na_values=["NA", "-"], header=True)
_read("skip", _plain, _ALL, "some junk\nand more, of it\nk,name,region\n", skiprows=2, header=True)
_read("quote", lambda r: f"{r.n_nationkey},'{r.n_name}, the',{r.n_regionkey}", "SELECT n_nationkey AS k, n_name || ', the' AS name, n_regionkey AS region FROM nation", quotechar="'", header=True)
_read("escape", lambda r: f'{r.n_nationkey},"a \\"{r.n_name}\\"",{r.n_regionkey}', "SELECT n_nationkey AS k, 'a \"' || n_name || '\"' AS name, n_regionkey AS region FROM nation", escapechar="\\", header=True)
_read("comment", lambda r: f"#{_plain(r)}\n{_plain(r)}", _ALL, comment="#", header=True)
_read("thousands", lambda r: f"{(r.n_nationkey + 1) * 123456:,};{r.n_name}", "SELECT (n_nationkey + 1)::BIGINT * 123456 AS k, n_name AS name FROM nation", "k;name\n", sep=";", thousands=",", header=True)
_read("decimal", lambda r: f"{r.n_nationkey},25;{r.n_name}", "SELECT n_nationkey + 0.25::DOUBLE AS k, n_name AS name FROM nation", "k;name\n", sep=";", decimal=",", header=True)
_read("date_format", lambda r: f"{r.n_nationkey},{r.n_nationkey + 1:02}/03/2021", "SELECT n_nationkey AS k, DATE '2021-03-01' + n_nationkey AS d FROM nation", "k,d\n", date_format="%d/%m/%Y", dtype={"d": "DATE"}, header=True)
_read("timestamp_format", lambda r: f"{r.n_nationkey},2021.03.{r.n_nationkey + 1:02} 04h", "SELECT n_nationkey AS k, TIMESTAMP '2021-03-01 04:00:00' + INTERVAL 1 DAY * n_nationkey AS t FROM nation", "k,t\n", timestamp_format="%Y.%m.%d %Hh", dtype={"t": "TIMESTAMP"}, header=True)
_read("sample_size", lambda r: _plain(r).replace(",", "\t"), _ALL, "k\tname\tregion\n", sample_size=5)
_read("files_to_sniff_parallel_buffer", _plain, _ALL, files_to_sniff=1, parallel=True, buffer_size=1 << 20, header=True)
_read("all_varchar", _plain, "SELECT n_nationkey::VARCHAR AS k, n_name AS name, n_regionkey::VARCHAR AS region FROM nation", all_varchar=True, header=True)
_read("normalize_names", _plain, "SELECT n_nationkey AS the_key, n_name AS _2nd_name, n_regionkey AS region FROM nation", "The Key,2nd name, Region \n", normalize_names=True, header=True)
_read("null_padding", lambda r: _plain(r) if r.n_regionkey != 2 else f"{r.n_nationkey},{r.n_name}", "SELECT n_nationkey AS k, n_name AS name, nullif(n_regionkey, 2) AS region FROM nation", null_padding=True, header=True)
_read("new_line", _plain, _ALL, "k,name,region\r\n", "\r\n", new_line="\\r\\n", header=True)
_read("max_line_size", _plain, _ALL, max_line_size=1000, header=True)
_read("auto_type_candidates", lambda r: f"{r.n_nationkey},{r.n_nationkey}.5", "SELECT n_nationkey::BIGINT AS k, n_nationkey || '.5' AS half FROM nation", "k,half\n", auto_type_candidates=["BIGINT", "VARCHAR"], header=True)
_BAD = "x7,bad,1\n"
_read("ignore_errors", _plain, _ALL.replace("n_nationkey AS", "n_nationkey::BIGINT AS"), tail=_BAD, ignore_errors=True, dtype={"k": "BIGINT"}, header=True)
_read("store_rejects", _plain, _ALL.replace("n_nationkey AS", "n_nationkey::BIGINT AS"), tail=_BAD + "8,ragged\n", store_rejects=True, dtype={"k": "BIGINT"}, header=True)
_read("force_not_null", lambda r: f"{r.n_nationkey},,{r.n_regionkey}", "SELECT n_nationkey AS k, '' AS name, n_regionkey AS region FROM nation", force_not_null=["name"], dtype={"name": "VARCHAR"}, header=True)
_read("columns", _plain, "SELECT n_nationkey::BIGINT AS a, n_name AS b, n_regionkey::DOUBLE AS c FROM nation", columns={"a": "BIGINT", "b": "VARCHAR", "c": "DOUBLE"}, header=True)
_read("dtype_list", _plain, "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::VARCHAR AS region FROM nation", dtype=["BIGINT", "VARCHAR", "VARCHAR"], header=True)


def _rejects(options: dict, query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = Connection(spark.newSession())
        rows = frame(own.spark, sf_dir, "nation").collect()
        text = "k,name,region\n" + "".join(f"{'bad' if r.n_regionkey == 1 else ''}{_plain(r)}\n" for r in rows)
        own.read_csv(io.StringIO(text), header=True, dtype={"k": "BIGINT"}, **options)
        return own.sql(query).dataframe

    return run


def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        Connection(spark).read_csv(io.StringIO("a\n1\n"), headr=True)
    except InvalidInputException as e:
        return spark.createDataFrame([("header" in str(e),)], "near boolean")
    raise AssertionError("an unknown option passed")


def _folder(way: str) -> Query:
    """The nations by region in folders, read with an option of several files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
        own, con = frame(spark, sf_dir, "nation"), Connection(spark)
        own.write.partitionBy("n_regionkey").option("header", True).option("compression", "gzip").csv(path)
        kinds = {"n_nationkey": "INTEGER"}
        if way == "hive":
            return con.read_csv(path, header=True, dtype=kinds, hive_partitioning=True, hive_types={"n_regionkey": "BIGINT"}).dataframe
        if way == "flat":
            return con.read_csv(path, header=True, dtype=kinds, hive_partitioning=False, compression="auto").dataframe
        if way == "filename":
            return con.read_csv(path, header=True, dtype=kinds, filename="f").project("n_nationkey, f like '%n_regionkey=%' as named").dataframe
        return con.read_csv([f"{path}/n_regionkey=0", f"{path}/n_regionkey=1"], header=True, dtype=kinds, union_by_name=True).dataframe

    return run


QUERIES |= {
    "csv_rejects_table": (_rejects({"rejects_table": "my_rejects", "store_rejects": True}, "SELECT line FROM my_rejects"), "SELECT 'bad' || n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation WHERE n_regionkey = 1"),
    "csv_rejects_scan": (_rejects({"rejects_scan": "my_scans"}, "SELECT count(*) AS files, max(delimiter) AS d FROM my_scans"), "SELECT 1::BIGINT AS files, ',' AS d"),
    "csv_rejects_limit": (_rejects({"rejects_limit": 2}, "SELECT count(*) AS n FROM reject_errors"), "SELECT 2::BIGINT AS n"),
    "csv_unknown_option": (_unknown, "SELECT true AS near"),
    "csv_hive_types": (_folder("hive"), "SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "csv_hive_partitioning_off": (_folder("flat"), "SELECT n_nationkey, n_name FROM nation"),
    "csv_filename": (_folder("filename"), "SELECT n_nationkey, true AS named FROM nation"),
    "csv_union_by_name": (_folder("union"), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2"),
}
