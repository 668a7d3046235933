"""Expressions, as-of and positional joins, skew-safe aggregates, and streams that run once."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidInputException
from tessera.expression import CaseExpression, ColumnExpression, ConstantExpression, FunctionExpression, LambdaExpression, SQLExpression
from tessera.functions import GROUPS, mode_first, names
from tessera.operators.joins import asof_join, bins, positional_join
from tessera.plans.tables import frame
from tessera.streaming import events as E

C = ColumnExpression


def one(spark, expression):
    return spark.range(1).select(F.lit(5).alias("x"), F.lit("Ab").alias("s")).select(expression.column).first()[0]


def test_expressions(spark):
    assert one(spark, C("x") // 2) == 2 and one(spark, C("x") / 2) == 2.5 and one(spark, 7 % C("x")) == 2 and one(spark, 2 ** C("x")) == 32
    assert one(spark, 1 - C("x")) == -4 and one(spark, -C("x")) == -5 and one(spark, C("x") % 0) is None
    assert one(spark, C("x").between(1, 5) & ~(C("x") == 4)) is True
    assert one(spark, C("s").collate("NOCASE") == ConstantExpression("aB")) is True
    assert one(spark, CaseExpression(C("x") > 9, 1).when(C("x") > 4, 2)) == 2
    assert one(spark, FunctionExpression("list_reduce", ConstantExpression([1, 2, 3]), LambdaExpression(("a", "b"), C("a") + C("b")))) == 6
    assert one(spark, FunctionExpression("list_filter", ConstantExpression([1, 2, 3]), LambdaExpression("e", C("e") > 1))) == [2, 3]
    assert one(spark, SQLExpression("x + 1").alias("y").cast("VARCHAR")) == "6"
    assert C("x").alias("y").get_name() == "y" and C("x").get_name() == "x"
    for bad in (lambda: C("x").isin(), lambda: SQLExpression("1, 2"), lambda: C("x").when(C("x"), 1), lambda: bool(C("x"))):
        with pytest.raises(InvalidInputException):
            bad()


def test_function_names():
    import tessera.functions as T

    assert len(names()) == sum(len(g.split()) for g in GROUPS.values()) == len(set(names()))
    assert all(callable(getattr(T, n)) for n in names())
    with pytest.raises(AttributeError):
        T.nothing_like_it


def test_mode_first(spark):
    df = spark.createDataFrame([(1, 3, 0), (1, 2, 1), (1, 2, 2), (1, 3, 3), (2, None, 0), (2, 9, 1)], "k int, v int, o int")
    assert sorted(map(tuple, df.groupBy("k").agg(mode_first("v", "o")).collect())) == [(1, 3), (2, 9)]


def test_joins(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 5, "c")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (2, 6, 30)], "k int, t int, v int")
    assert sorted((r.n, r.v) for r in asof_join(left, right, "t", ["k"], ["v"]).collect()) == [("a", 20), ("b", None), ("c", None)]
    assert sorted((r.n, r.v) for r in asof_join(left, right, "t", ["k"], ["v"], strict=True).collect()) == [("a", 10), ("b", None), ("c", None)]
    both = positional_join(spark.range(100).repartition(7), spark.range(200, 260).toDF("b").repartition(3), "id", "b").collect()
    assert sorted((r.id, r.b) for r in both if r.b is not None) == [(i, 200 + i) for i in range(60)] and len(both) == 100


def test_streams(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    frame(spark, sf_dir, "events").repartition(3).write.parquet(str(source))
    batch = spark.read.parquet(str(source))
    stream = E.read_events(spark, str(source))
    sums = [F.count("*").alias("n")]
    out = E.run_once(E.windowed(stream, "ts", "1 day", sums, ["event_type"], late="1 hour"), "days", "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, E.windowed(batch, "ts", "1 day", sums, ["event_type"]).collect()))
    dedup = E.run_once(E.deduplicated(E.read_events(spark, str(source)), "ts", ["event_id"], "40 days"), "once")
    assert dedup.count() == batch.count()
    totals = E.run_once(E.running_totals(E.read_events(spark, str(source)), "user_id", "value"), "totals", "update")
    want = {r.user_id: r.n for r in batch.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert {r.user_id: r.m for r in totals.groupBy("user_id").agg(F.max("n").alias("m")).collect()} == want
    pairs = E.run_once(E.interval_joined(E.read_events(spark, str(source)).filter("event_type = 'view'"), E.read_events(spark, str(source)).filter("event_type = 'click'"), ["user_id"], "ts", "ts", "10 minutes", "40 days"), "pairs")
    own = E.interval_joined(batch.filter("event_type = 'view'"), batch.filter("event_type = 'click'"), ["user_id"], "ts", "ts", "10 minutes", "1 hour")
    assert pairs.count() == own.count()
    E.write_each(E.read_events(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_asof_of_a_hot_key(spark):
    """One key holds most rows: its ranges of time are apart, and each knows the last value before it."""
    left = spark.range(400).selectExpr("cast(if(id % 10 = 0, null, 1) as int) k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 401 as int)) t", "id n").unionAll(spark.sql("SELECT 1, null, 1000L"))
    right = spark.range(0, 400, 90).selectExpr("cast(if(id = 180, null, 1) as int) k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) t", "id v").unionAll(spark.sql("SELECT 1, null, 999L"))
    rows, values = left.collect(), right.collect()
    for strict in (False, True):
        want = {r.n: max(((v.t, v.v) for v in values if v.k == r.k and v.t is not None and r.t is not None and (v.t < r.t or v.t == r.t and not strict)), default=(None, None))[1] for r in rows}
        for n in (1, 2, 60):
            got = {r.n: r.v for r in asof_join(left, right, "t", ["k"], ["v"], strict, n).collect()}
            assert got == want


def test_ranges(spark):
    df = spark.range(5000).selectExpr("id", "cast(if(id % 50 = 0, null, id * 13 % 5000 / 7) as double) x", "concat('s', id % 100) s", "timestamp_ntz'2024-03-31' + make_interval(0, 0, 0, 0, 0, cast(id as int)) t", "timestamp'2024-03-31' + make_interval(0, 0, 0, 0, 0, cast(id as int)) z")
    for column in ("id", "x", "s", "t", "z"):
        rows = sorted((r for r in df.select(column, bins(df, column, 50).alias("b")).collect() if r[0] is not None), key=lambda r: r[0])
        assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) >= 40
    assert df.filter("x is null").select(bins(df, "x", 50).alias("b")).distinct().collect() == [(0,)]
    assert bins(df.limit(0), "x", 5) is None and bins(df.filter("x is null"), "x", 5) is None and bins(df, "id") is None


def test_positions_over_many_ranges(spark, monkeypatch):
    from tessera.operators import joins

    monkeypatch.setattr(joins, "BIN_ROWS", 10)
    both = positional_join(spark.range(300).repartition(7), spark.range(200, 460).toDF("b").repartition(3), "id", "b").collect()
    assert sorted((r.id, r.b) for r in both if r.b is not None) == [(i, 200 + i) for i in range(260)] and len(both) == 300


def test_a_stream_that_runs_once_gives_files(spark, sf_dir, tmp_path):
    """The rows are in files, state isn't in the JVM's memory, and the session's settings are as before."""
    source = tmp_path / "in"
    frame(spark, sf_dir, "events").repartition(3).write.parquet(str(source))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    out = E.run_once(E.deduplicated(E.read_events(spark, str(source), maxFilesPerTrigger="1"), "ts", ["event_id"], "40 days"), "in_files")
    assert out.inputFiles() and "parquet" in out._jdf.queryExecution().optimizedPlan().toString()
    assert spark.table("in_files").count() == out.count() == frame(spark, sf_dir, "events").count()
    assert spark.conf.get(key) == before and "RocksDB" in E.STATE[key]
    counts = E.run_once(E.windowed(E.read_events(spark, str(source), maxFilesPerTrigger="1"), "ts", "1 day", [F.count("*").alias("n")]), "all_days", "complete")
    assert counts.agg(F.sum("n")).first()[0] == out.count()
    empty = tmp_path / "none"
    empty.mkdir()
    assert E.run_once(E.deduplicated(E.read_events(spark, str(empty), out.schema), "ts", ["event_id"], "40 days"), "nothing").count() == 0
