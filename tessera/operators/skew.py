"""Skew-safe aggregation for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_count_distinct(df: DataFrame, keys: list[str], value: str, salts: int = 32) -> DataFrame:
    """Distinct values of each key in two steps, so one key's values spread over tasks: keys and n."""
    salted = df.select(*keys, value, F.pmod(F.xxhash64(value), F.lit(salts)).alias("__salt"))
    parts = salted.groupBy(*keys, "__salt").agg(F.countDistinct(value).alias("n"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. Spark keeps k rows a key and task before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")
