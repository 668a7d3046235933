import uuid

import pytest

import tessera
from tessera.connection import Connection
from tessera.errors import CatalogException, ConnectionException, ConversionException, InvalidInputException, ParserException, TransactionException
from tessera.expression import ColumnExpression, ConstantExpression, DefaultExpression


@pytest.fixture
def con(spark):
    return Connection(spark)


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex[:10]}"


def test_statements(con, name):
    assert con.execute(f"CREATE TABLE {name} (a INTEGER, b VARCHAR, l INTEGER[]); INSERT INTO {name} VALUES (1, 'x', array(1)); SELECT a FROM {name}").fetchall() == [(1,)]
    assert con.description[0][0] == "a" and con.rowcount == -1
    con.executemany(f"INSERT INTO {name} (a, b, l) VALUES (?, ?, array(?))", [[2, "y", 5], [3, None, 6]])
    assert con.sql(f"select sum(a) from {name}").fetchone() == (6,)
    con.execute(f"UPDATE {name} SET b = ? WHERE a > 2", ["z"])
    con.execute(f"DELETE FROM {name} WHERE a = $k", {"k": 1})
    assert sorted(con.table(name).project("a, b").fetchall()) == [(2, "y"), (3, "z")]
    con.table(name).update({"b": DefaultExpression()}, condition=ColumnExpression("a") == ConstantExpression(2))
    assert sorted(con.table(name).project("a, b").fetchall()) == [(2, None), (3, "z")]
    assert con.sql(f"INSERT INTO {name} SELECT 9, 'n', NULL RETURNING a + 1 AS b").fetchall() == [(10,)]
    assert con.get_table_names(f"with q as (select 1) select * from {name} join q join s.other") == {name, "other"}
    assert con.get_table_names("select * from s.other", qualified=True) == {"s.other"}
    con.execute(f"PREPARE p AS SELECT a FROM {name} WHERE a > ?")
    assert sorted(con.execute("EXECUTE p(2)").fetchall()) == [(3,), (9,)]
    assert [s.type for s in con.extract_statements("select 1; drop table x")] == ["SELECT", "DROP"]
    con.execute(f"DROP TABLE {name}")


def test_pivot_copy_and_export(con, name, tmp_path):
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM VALUES ('u', 'x', 1), ('v', 'y', 2), ('w', 'z', 3) AS t(a, b, c)")
    out = con.sql(f"PIVOT {name} ON b USING sum(c) GROUP BY a ORDER BY a")
    assert out.columns == ["a", "x", "y", "z"] and out.fetchall() == [("u", 1, None, None), ("v", None, 2, None), ("w", None, None, 3)]
    con.execute(f"COPY {name} TO '{tmp_path}/c' (FORMAT csv, HEADER true)")
    con.execute(f"COPY {name} FROM '{tmp_path}/c' (FORMAT csv, HEADER true)")
    assert len(con.table(name)) == 6
    con.execute(f"EXPORT DATABASE '{tmp_path}/db'")
    con.execute(f"DROP TABLE {name}")
    for t in con.spark.catalog.listTables():
        if not t.isTemporary:
            con.execute(f"DROP TABLE {t.name}")
    con.execute(f"IMPORT DATABASE '{tmp_path}/db'")
    assert len(con.table(name)) == 6


def test_errors(con):
    with pytest.raises(ParserException):
        con.sql("selec 1")
    with pytest.raises(CatalogException):
        con.sql("select * from nowhere_at_all").fetchall()
    with pytest.raises(ConversionException):
        con.sql("select cast('x' as int)").fetchall()
    with pytest.raises(InvalidInputException):
        con.fetchall()
    with pytest.raises(TransactionException):
        con.begin().rollback()
    own = Connection(con.spark)
    own.close()
    with pytest.raises(ConnectionException):
        own.sql("select 1")


def test_functions(con):
    con.create_function("inc", lambda x: x + 1, ["BIGINT"], "BIGINT")
    assert con.sql("select inc(1), inc(null)").fetchall() == [(2, None)]
    with pytest.raises(CatalogException):
        con.create_function("inc", lambda x: x, ["BIGINT"], "BIGINT")
    con.remove_function("inc")
    with pytest.raises(CatalogException):
        con.remove_function("inc")
    with pytest.raises(InvalidInputException):
        con.create_function("untyped", lambda x: x)
    con.create_function("bad", lambda x: None, ["BIGINT"], "BIGINT")
    with pytest.raises(Exception, match="returned None"):
        con.sql("select bad(1)").fetchall()


def test_module_functions(con):
    tessera.set_default_connection(con)
    assert tessera.sql("select 5 as x").fetchall() == [(5,)]
    assert tessera.values((1, 2)).fetchall() == [(1, 2)]
    import pandas as pd

    assert tessera.filter(pd.DataFrame({"a": [1, 2]}), "a > 1").fetchall() == [(2,)]
    assert tessera.query_df(pd.DataFrame({"a": [1, 2]}), "v1", "select sum(a) from v1").fetchall() == [(3,)]
    assert (tessera.apilevel, tessera.threadsafety, tessera.paramstyle) == ("2.0", 1, "qmark")
    with con.cursor() as other:
        assert other.execute("select 1").fetchone() == (1,)


def test_reader_gives_batches_as_they_come(spark):
    con = Connection(spark)
    own = con.sql("SELECT id, cast(id AS VARCHAR) AS s, if(id % 2 = 0, null, id * 1.5) AS x FROM range(1000)")
    reader = own.to_arrow_reader(100)
    sizes = [b.num_rows for b in reader]
    assert sum(sizes) == 1000 and max(sizes) <= 100
    assert own.to_arrow_reader().read_all().sort_by("id") == own.to_arrow_table().cast(reader.schema).sort_by("id")
    assert own.filter("id < 0").to_arrow_reader().read_all().num_rows == 0


def test_unknown_settings_raise(spark):
    con = Connection(spark)
    con.execute("SET threads = 4")
    with pytest.raises(Exception, match="no_such_setting"):
        con.execute("SET no_such_setting = 3")
