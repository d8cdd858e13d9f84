"""Registration of queries and the tables they read."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    """Registers a query under its function's name; `sql`: the same in DuckDB."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Rows and bytes of one Arrow batch at most, so that a Python worker holds a few megabytes of pages whatever their number and length; and what makes it give memory back.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2"}


def shipped(spark: SparkSession) -> SparkSession:
    """This package on the Python workers' path (on a cluster: --py-files or an image), and small Arrow batches."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [x for x in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors see; removed when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding in SQL that both engines run: it derives an operator's input columns from the tables."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", f"parquet.`{sf_dir}/{name}.parquet`")
    return shipped(spark).sql(sql)


def plain(sql: str) -> str:
    """The same binding for DuckDB."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


#: Listings derived from orders, with every kind of value that the rules tell apart.
LISTINGS = """
SELECT o_orderkey AS pos,
  CASE o_orderkey % 4 WHEN 0 THEN 'domria' WHEN 1 THEN 'lun' WHEN 2 THEN 'rieltor' ELSE 'olx' END AS source,
  CAST(o_orderkey AS STRING) AS source_id,
  CASE WHEN o_orderkey % 10 = 9 THEN ' Not a URL ' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 4 = 1 THEN 'https://www.OLX.ua:443/d/obyavlenie/ID' || CAST(o_orderkey - 2 AS STRING) || '.html?x=1#top'
    WHEN o_orderkey % 4 = 0 THEN 'https://dom.ria.com/uk/realty-' || CAST(1000000 + o_orderkey AS STRING) || '.html' WHEN o_orderkey % 4 = 2 THEN 'HTTPS://rieltor.ua/flats-rent/view/' || CAST(o_orderkey AS STRING) || '//'
    ELSE 'https://m.olx.ua/d/ID' || CAST(o_orderkey AS STRING) || '.html' END AS url,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS published_at,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 400 DAYS END AS refreshed_at,
  CASE WHEN o_orderkey % 37 <> 0 THEN o_totalprice END AS amount,
  CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'eur' WHEN 2 THEN 'UAH' WHEN 3 THEN 'GBP' END AS currency,
  CASE WHEN o_orderkey % 6 = 0 THEN 'day' WHEN o_orderkey % 6 > 1 THEN 'month' END AS period,
  CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '24,02' WHEN 3 THEN 'x' WHEN 4 THEN '10.5' ELSE CAST(49 + CAST(o_orderkey % 200 AS DOUBLE) / 100 AS STRING) END AS lat,
  CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '49,84' ELSE CAST(23 + CAST(o_orderkey % 160 AS DOUBLE) / 100 AS STRING) END AS lng,
  CASE o_orderkey % 5 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' WHEN 2 THEN 'apartment' WHEN 3 THEN 'room' ELSE 'unknown' END AS property_type,
  CAST(o_orderkey % 5 AS DOUBLE) AS rooms, CAST(20 + o_orderkey % 60 AS DOUBLE) AS area,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS seller_id,
  o_orderkey % 13 = 0 AS platform_owner, o_orderkey % 19 = 0 AS platform_agent, o_orderkey % 23 = 0 AS platform_business,
  o_orderkey % 3 = 0 AS is_business, o_orderkey % 29 = 0 AS agency, o_orderkey % 7 = 0 AS declared, o_orderkey % 21 = 0 AS bare,
  CASE o_orderkey % 31 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'unknown' END AS text_level
FROM {orders}
"""
L = f"WITH l AS ({plain(LISTINGS)}) "
NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, LISTINGS)
