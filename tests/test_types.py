import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types as X
from tessera.errors import InvalidInputException


@pytest.mark.parametrize("text, want", [("INTEGER", "int"), ("hugeint", "decimal(38,0)"), ("DECIMAL(10, 2)", "decimal(10,2)"), ("VARCHAR[]", "array<string>"), ("INTEGER[3][]", "array<array<int>>"), ('STRUCT("a b" INT, b VARCHAR[])', "struct<a b:int,b:array<string>>"), ("MAP(VARCHAR, DOUBLE)", "map<string,double>"), ("TIMESTAMP WITH TIME ZONE", "timestamp"), ("UNION(n INT, s VARCHAR)", "struct<tag:string,n:int,s:string>")])
def test_type_text(text, want):
    assert X.sqltype(text).simpleString() == want


def test_factories():
    assert X.python_type(list[int]) == T.ArrayType(T.LongType())
    assert X.python_type(dict[str, float]) == T.MapType(T.StringType(), T.DoubleType())
    assert X.python_type(int | None) == T.LongType()
    assert X.type_name(X.sqltype("STRUCT(a INT[], b DECIMAL(4,1))")) == "STRUCT(a INTEGER[], b DECIMAL(4,1))"
    assert X.type_name(X.struct_type({"1": "INTEGER", "a b": "DATE"})) == 'STRUCT("1" INTEGER, "a b" DATE)'
    assert X.enum_type("e", ["x", "y"]).metadata == {"enum": ["x", "y"]}
    for bad in ("NOTHING", "STRUCT(1)", "DECIMAL(50,2)"):
        with pytest.raises(InvalidInputException):
            X.sqltype(bad)
    with pytest.raises(InvalidInputException):
        X.array_type("INT", 0)


def test_checks(spark):
    df = spark.createDataFrame([([1, 2],), ([3],)], "a array<int>")
    assert df.limit(1).select(X.check_size(F.col("a"), 2).alias("a")).collect()[0].a == [1, 2]
    with pytest.raises(Exception, match="another size"):
        df.select(X.check_size(F.col("a"), 2)).collect()
    kinds = spark.createDataFrame([("small",), ("large",)], "k string")
    assert [r.k for r in kinds.orderBy(X.enum_position(F.col("k"), ["small", "large"])).collect()] == ["small", "large"]
    u = X.union_type({"n": "INT", "s": "VARCHAR"})
    assert spark.range(1).select(X.union_value("s", F.lit("x"), u).alias("u")).first().u.asDict() == {"tag": "s", "n": None, "s": "x"}
