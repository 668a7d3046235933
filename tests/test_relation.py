"""Relations over the small tables that pin aggregates, windows, joins and groupings."""

import functools
import itertools
import math
import operator
import statistics
from collections import Counter

import pytest

from tessera import BinderException, InvalidInputException
from tessera.connection import Connection
from tessera.expression import ColumnExpression as C
from tessera.expression import ConstantExpression, FunctionExpression, StarExpression


@pytest.fixture(scope="module")
def con(spark):
    return Connection(spark)


#: Key, whole number, place, fraction, word: ties, nulls in the key and in the values, a group of one.
ROWS = [
    ("a", 7, 1, 0.25, "pear"), ("a", 7, 2, 1.5, "fig"), ("a", None, 3, -2.0, "kiwi"), ("a", 4, 4, 8.0, "date"), ("b", 12, 5, 0.5, "plum"), ("b", 3, 6, 0.125, "lime"),
    ("b", 12, 7, 4.0, "apple"), ("b", 3, 8, 2.5, "melon"), ("b", 9, 9, 1.0, "grape"), (None, 5, 10, 3.0, "nut"), (None, 6, 11, 6.0, "oat"), ("c", 2, 12, 0.75, "rye"),
]


@pytest.fixture(scope="module")
def agg(con, spark):
    return con.from_df(spark.createDataFrame(ROWS, "id string, v int, t int, f double, s string").coalesce(1))


def by_id(relation):
    return sorted(relation.fetchall(), key=repr)


def each(function, column=1):
    """What a function makes of a column's values that aren't null, by key."""
    groups = {}
    for r in ROWS:
        groups.setdefault(r[0], []).append(r)
    return sorted([(k, function([r[column] for r in g if r[column] is not None], g)) for k, g in groups.items()], key=repr)


def _bits(values):
    return "".join("1" if i in values else "0" for i in range(2, 13))


@pytest.mark.parametrize(
    "method, args, want",
    [
        ("sum", ("v",), each(lambda v, g: sum(v))),
        ("count", ("v",), each(lambda v, g: len(v))),
        ("min", ("v",), each(lambda v, g: min(v))),
        ("max", ("v",), each(lambda v, g: max(v))),
        ("median", ("v",), each(lambda v, g: float(statistics.median(v)))),
        ("bit_or", ("v",), each(lambda v, g: functools.reduce(operator.or_, v))),
        ("arg_max", ("s", "t"), each(lambda v, g: max(g, key=lambda r: r[2])[4])),
        ("arg_min", ("s", "f"), each(lambda v, g: min(g, key=lambda r: r[3])[4])),
        ("list", ("v",), each(lambda v, g: [r[1] for r in g])),
        ("histogram", ("v",), each(lambda v, g: dict(Counter(v)))),
        ("string_agg", ("s", "/"), each(lambda v, g: "/".join(r[4] for r in g))),
        ("product", ("v",), each(lambda v, g: float(math.prod(v)))),
        ("quantile_disc", ("v", 0.5), each(lambda v, g: sorted(v)[math.ceil(len(v) / 2) - 1])),
        ("quantile_cont", ("v", 0.5), each(lambda v, g: float(statistics.median(v)))),
        ("bitstring_agg", ("v", 2, 12), each(lambda v, g: _bits(v))),
    ],
)
def test_aggregates(agg, method, args, want):
    assert by_id(getattr(agg, method)(*args, groups="id", projected_columns="id")) == want


def test_mode(agg):
    got = dict(agg.filter("id = 'a'").mode("v", groups="id", projected_columns="id").fetchall())
    assert got == {"a": 7}


def test_aggregate_forms(agg):
    total = sum(r[1] or 0 for r in ROWS)
    assert agg.aggregate("sum(v) as s").fetchall() == [(total,)]
    assert by_id(agg.aggregate("id, sum(v)")) == each(lambda v, g: sum(v))
    last = each(lambda v, g: max(r[2] for r in g))
    assert by_id(agg.aggregate([C("id"), FunctionExpression("max", C("t")).alias("m")])) == last
    assert by_id(agg.aggregate([C("id"), FunctionExpression("max", C("t")).alias("m")], "id")) == last
    assert len(agg.aggregate("id, s, count(*) as n", "rollup(id, s)").fetchall()) == len(ROWS) + 4 + 1
    counts = Counter(r[1] for r in ROWS)
    assert sorted(agg.value_counts("v").fetchall(), key=repr) == sorted([(k, n if k is not None else 0) for k, n in counts.items()], key=repr)
    with pytest.raises(InvalidInputException):
        agg.sum("v", groups="id", window_spec="over ()")
    with pytest.raises(InvalidInputException):
        agg.bitstring_agg("v", min=1)
    with pytest.raises(InvalidInputException):
        agg.quantile_cont("v", "half")


def test_windows(agg):
    got = agg.row_number("over (partition by id order by v, t)", "id, v").fetchall()
    assert ("a", None, 4) in got and ("a", 4, 1) in got  # nulls come last
    lagged = sorted(agg.lag("v", "over (partition by id order by t)", projected_columns="t").fetchall())
    assert lagged[:4] == [(1, None), (2, 7), (3, 7), (4, None)]
    sums = sorted(agg.filter("id = 'b'").sum("v", window_spec="over (partition by id order by t rows between unbounded preceding and current row)", projected_columns="t").fetchall())
    assert [x for _, x in sums] == list(itertools.accumulate(r[1] for r in ROWS if r[0] == "b"))
    assert sorted(r[-1] for r in agg.n_tile("over (order by t)", 4, "t").fetchall()) == sorted([1, 2, 3, 4] * 3)
    assert len(agg.row_number("over ()").fetchall()) == len(ROWS)


def test_joins(con, spark):
    a = con.from_df(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "a int, b int")).set_alias("x")
    b = con.from_df(spark.createDataFrame([(1, 4), (3, 5)], "a int, b int")).set_alias("y")
    assert sorted(a.join(b, "a").fetchall()) == [(1, 1, 4), (3, 2, 5)]
    assert sorted(a.join(b, "x.a = y.a", " LEFT ").fetchall()) == [(1, 1, 1, 4), (2, 1, None, None), (3, 2, 3, 5)]
    assert sorted(a.join(b, "a", "semi").fetchall()) == [(1, 1), (3, 2)]
    assert a.join(b, "a", "anti").fetchall() == [(2, 1)]
    assert sorted(a.join(b, C("x.b") < C("y.b")).project("x.a").fetchall()) == [(1,), (1,), (2,), (2,), (3,), (3,)]
    assert len(a.cross(b)) == 6
    with pytest.raises(InvalidInputException):
        a.join(b, "a", "sideways")
    with pytest.raises(BinderException):
        a.join(b.set_alias("x"), "a")
    with pytest.raises(InvalidInputException):
        a.join(None, "a")


def test_projection_filter_and_order(agg, con):
    assert agg.select() is None
    assert agg.select(StarExpression(exclude=["f", "s"])).columns == ["id", "v", "t"]
    with pytest.raises(InvalidInputException):
        agg.select(StarExpression(exclude=["none"]))
    assert agg.select_types(["INTEGER"]).columns == ["v", "t"]
    with pytest.raises(InvalidInputException):
        agg.select_types(["DATE"])
    assert agg.filter(C("v") == ConstantExpression(9)).project("s").fetchall() == [("grape",)]
    assert "V" in agg and "nope" not in agg and agg["s"].columns == ["s"]
    assert agg.shape == (12, 5) and len(agg) == 12
    assert [r[0] for r in agg.order("v, t desc").project("v").fetchall()] == [*sorted(r[1] for r in ROWS if r[1] is not None), None]
    assert [r[0] for r in agg.sort(C("v").desc().nulls_first()).limit(2).project("v").fetchall()] == [None, 12]
    assert agg.order("t").limit(2, 1).project("t").fetchall() == [(2,), (3,)]
    with pytest.raises(InvalidInputException):
        agg.sort()
    assert agg.description[1][:2] == ("v", "INTEGER")
    assert agg.unique("id").order("id").fetchall() == [("a",), ("b",), ("c",), (None,)]
    with pytest.raises(BinderException):
        agg.project("nothing").fetchall()


def test_sets(con, spark):
    a = con.from_df(spark.createDataFrame([("p", 7)] * 4 + [("q", 8), ("q", 8), ("r", None), ("s", 9)], "x string, y long"))
    b = con.from_df(spark.createDataFrame([("p", 7), ("q", 8), ("q", 8), ("q", 8), ("r", None)], "x string, y long"))
    assert sorted(a.except_(b).fetchall()) == [("p", 7)] * 3 + [("s", 9)]
    assert sorted(a.intersect(b).fetchall()) == [("p", 7), ("q", 8), ("q", 8), ("r", None)]
    assert len(a.union(b)) == 13 and len(a.distinct()) == 4


def test_results(agg):
    assert agg.project("id").order("id").fetchone() == ("a",)
    own = agg.order("t").project("t")
    assert own.fetchmany(3) == [(1,), (2,), (3,)] and own.fetchone() == (4,)
    assert agg.df().shape == (12, 5)
    assert agg.to_arrow_table().num_rows == 12 and sum(b.num_rows for b in agg.arrow(3)) == 12
    assert agg.fetchnumpy()["v"].mask.sum() == 1
    assert agg.describe().project("aggr, v").fetchall()[0] == ("count", 11.0)
    assert "Scan" in agg.explain() or "Relation" in agg.explain()


def test_map(agg):
    assert sorted(agg.project("t").map(lambda df: df.assign(t=df.t + 1)).fetchall())[0] == (2,)
    with pytest.raises(Exception, match="pandas frame"):
        agg.map(lambda df: 3)


def test_sinks(agg, tmp_path, con):
    agg.to_parquet(str(tmp_path / "p"), partition_by=["id"])
    assert len(con.read_parquet(str(tmp_path / "p"))) == 12
    with pytest.raises(Exception):
        agg.to_parquet(str(tmp_path / "p"))
    agg.to_parquet(str(tmp_path / "p"), overwrite=True)
    agg.to_csv(str(tmp_path / "c"), sep=";", na_rep="NA", quoting="all")
    assert len(con.read_csv(str(tmp_path / "c"), na_values=["NA", "null"])) == 12
    with pytest.raises(InvalidInputException):
        agg.to_csv(str(tmp_path / "d"), quoting="some")
