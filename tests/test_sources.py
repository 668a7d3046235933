import datetime
import io

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.connection import Connection
from tessera.errors import InvalidInputException, NotImplementedException
from tessera.sources.csv import java_pattern


@pytest.fixture(scope="module")
def con(spark):
    return Connection(spark)


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv(con, tmp_path):
    assert con.read_csv(put(tmp_path / "a.csv", "1;2;3\n4;5;6\n")).fetchall() == [(1, 2, 3), (4, 5, 6)]
    own = con.read_csv(put(tmp_path / "b.csv", "ID|NAME|WHEN\n1|a|2006-02-15 04:46:27\n2|NA|2006-02-15 04:46:28\n"), na_values="NA")
    assert own.columns == ["ID", "NAME", "WHEN"] and own.fetchall()[1][:2] == (2, None)
    assert con.read_csv(put(tmp_path / "c.csv", "junk\na,b\n1,x\n"), skiprows=1, header=True).fetchall() == [(1, "x")]
    assert con.read_csv(put(tmp_path / "d.csv", "a;b\n1.234,5;x\n"), header=True, sep=";", thousands=".", decimal=",").fetchall() == [(1234.5, "x")]
    assert con.read_csv(put(tmp_path / "e.csv", "a,b\n1,2\n"), header=True, all_varchar=True).fetchall() == [("1", "2")]
    assert con.read_csv(put(tmp_path / "f.csv", "d,v\n15/02/2006,1\n"), header=True, date_format="%d/%m/%Y", dtype={"d": "DATE"}).fetchall() == [(datetime.date(2006, 2, 15), 1)]
    assert con.read_csv(put(tmp_path / "g.csv", "a,b\n1,x\nq,y\n"), header=True, columns={"a": "INTEGER", "b": "VARCHAR"}, ignore_errors=True).columns == ["a", "b"]
    assert con.read_csv(io.StringIO("a,b\n7,8\n"), header=True).fetchall() == [(7, 8)]
    assert con.read_csv(put(tmp_path / "h.csv", "1,2\n"), header=False, names=["x"]).columns[0] == "x"
    assert con.read_csv(put(tmp_path / "i.csv", "A b,1C\n1,2\n"), header=True, normalize_names=True).columns == ["a_b", "_1c"]
    for bad in ({"headers": True}, {"sep": ",", "delimiter": ","}, {"names": ["a", "a"]}, {"dtype": {"zz": "INT"}}):
        with pytest.raises(InvalidInputException):
            con.read_csv(str(tmp_path / "a.csv"), **bad)
    assert java_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


def test_json(con, tmp_path):
    lines = put(tmp_path / "a.json", '{"id": 1, "name": "x"}\n{"id": 2, "name": null}\n')
    assert sorted(con.read_json(lines).fetchall()) == [(1, "x"), (2, None)]
    array = put(tmp_path / "b.json", '[{"id": 1, "t": {"a": 1}},\n {"id": 2, "t": {"a": 2}}]')
    assert len(con.read_json(array)) == 2
    assert con.read_json(array, format="array", maximum_depth=1).project("t").fetchall()[0] == ('{"a":1}',)
    assert con.read_json(lines, columns={"id": "VARCHAR"}).fetchall()[0] == ("1",)
    with pytest.raises(InvalidInputException):
        con.read_json(lines, format="odd")


def test_parquet(con, tmp_path, spark):
    path = str(tmp_path / "p")
    spark.range(10).write.parquet(path)
    own = con.read_parquet([path], file_row_number=True, filename="f")
    assert own.columns == ["id", "file_row_number", "f"]
    plan = con.read_parquet(path).filter("id > 5").explain()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan


def test_objects(con):
    frame = pd.DataFrame({"a": [1, 2], "b": ["x", None], "c": pd.Categorical(["u", "v"]), "d": [1, "mixed"]})
    assert con.from_df(frame).fetchall() == [(1, "x", "u", "1"), (2, None, "v", "mixed")]
    table = pa.table({"k": [1, 2]})
    assert con.from_arrow(table).fetchall() == con.from_arrow(table.to_reader()).fetchall() == [(1,), (2,)]
    assert con.from_df(np.array([[1, 2], [3, 4]])).fetchall() == [(1, 3), (2, 4)]
    assert con.from_df({"z": np.array([5])}).fetchall() == [(5,)]
    con.register("things", frame)
    assert con.sql("select count(*) from things").fetchall() == [(2,)]
    con.unregister("things")
    local_frame = pd.DataFrame({"q": [4]})
    assert len(local_frame) and con.sql("select q from local_frame").fetchall() == [(4,)]
    with pytest.raises(InvalidInputException):
        con.from_df(object())


def test_filesystems(con):
    class Memory:
        protocol = "memo"

        def open(self, path, mode):
            return io.BytesIO(b"a,b\n1,2\n")

    con.register_filesystem(Memory())
    assert con.filesystem_is_registered("memo") and con.list_filesystems() == ["memo"]
    assert con.read_csv("memo://x.csv", header=True).fetchall() == [(1, 2)]
    con.unregister_filesystem("memo")
    with pytest.raises(InvalidInputException):
        con.unregister_filesystem("memo")


def test_csv_rejects(con, tmp_path, spark):
    path = put(tmp_path / "r.csv", "a,b\n1,x\nq,y\n3\n4,z,more\n5,w\n")
    own = con.read_csv(path, header=True, dtype={"a": "INTEGER", "b": "VARCHAR"}, rejects_table="bad_lines", rejects_scan="scanned")
    assert own.fetchall() == [(1, "x"), (5, "w")]
    assert sorted(r.line for r in spark.table("bad_lines").collect()) == ["3", "4,z,more", "q,y"]
    assert spark.table("scanned").collect()[0].file_path == path
    assert con.read_csv(path, header=True, dtype={"a": "INTEGER"}, ignore_errors=True).fetchall() == [(1, "x"), (5, "w")]
    for refused in ({"encoding_errors": "strict"}, {"compression": "gzip"}, {"hive_types_autocast": False}):
        with pytest.raises(NotImplementedException):
            con.read_csv(path, **refused)


def test_skipped_lines_of_many_files(con, tmp_path):
    for i in range(3):
        put(tmp_path / f"{i}.csv", "junk\n" * 2 + f"{i},x\n" * 3)
    assert sorted(con.read_csv(str(tmp_path), skiprows=2, header=False, sep=",").fetchall()) == [(i, "x") for i in range(3) for _ in range(3)]
