"""The driver's tables as relations and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.connection import Connection
from tessera.relation import Relation

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    return Connection(spark).read_parquet(f"{sf_dir}/{name}.parquet").set_alias(name)


def views(spark: SparkSession, sf_dir: str, names: str) -> Connection:
    """A connection of a session of its own in which the tables are views."""
    own = Connection(spark.newSession())
    for name in names.split():
        own.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return own
