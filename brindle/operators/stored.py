"""Lineage cut by tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the checkpoint folder, removed when the application ends.

    A checkpoint of rows is Java-serialised, read whole whatever columns are needed and of unknown size, so every later join sorts both sides; a table is none of these.
    """
    spark = df.sparkSession
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
