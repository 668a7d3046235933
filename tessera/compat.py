"""The PySpark classes under this engine's roof, so that code written for a PySpark-like namespace imports from here."""

from pyspark import SparkConf, SparkContext
from pyspark.sql import Catalog, Column, DataFrame, DataFrameReader, DataFrameWriter, GroupedData, Row, SparkSession, Window, functions, types
from pyspark.sql.conf import RuntimeConfig
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter
from pyspark.sql.udf import UDFRegistration

__all__ = ["Catalog", "Column", "DataFrame", "DataFrameReader", "DataFrameWriter", "DataStreamReader", "DataStreamWriter", "GroupedData", "Row", "RuntimeConfig", "SparkConf", "SparkContext", "SparkSession", "UDFRegistration", "Window", "functions", "types"]
