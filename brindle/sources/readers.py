"""Readers of captured pages and records: the sources by name, each with a declared schema, united into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "source string, page int, pos int, fetched_at timestamp, status int, body string"


def captured(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Captured pages in Parquet, ORC, JSON lines or CSV; never with an inferred schema."""
    reader = spark.read.schema(CAPTURE)
    return reader.option("header", True).option("multiLine", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def followed(spark: SparkSession, path: str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """The same as a stream: each new file is part of the next poll."""
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def united(spark: SparkSession, places: dict[str, tuple[str, str]], enabled: list[str]) -> DataFrame:
    """The enabled sources of `places` (name -> path, kind) in one table, in the order of `enabled`, which `rank` keeps."""
    parts = [captured(spark, *places[name]).withColumn("source", F.lit(name)).withColumn("rank", F.lit(i)) for i, name in enumerate(enabled)]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], CAPTURE + ", rank int")
