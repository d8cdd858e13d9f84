"""Helpers that the corpus operators share: tables in the shared folder, Arrow glue."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most; keeps a Python worker's memory small whatever the texts' mean length.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Bytes of text that the vectorised operators look at together.
CHUNK_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or an own one where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local[") or master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """`df` as a table in the shared folder: its lineage is cut and survives lost executors.

    `group_bytes`: about how much a writing task holds of it, for rows of megabytes. The shuffle files behind it are of no use any more;
    Spark deletes them once the driver has collected what stands for them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    options = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(**options).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Python workers live on from stage to stage: blocks of more than 128 KB go back to the system as soon as they are free, Arrow's too.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2"}


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, workers that give memory back, and this package on their path (on a cluster: --py-files or an image)."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [x for x in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def chunks(rows: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer text is a range of its own."""
    start = held = 0
    for i, row in enumerate(rows):
        if i > start and held + len(row) > limit:
            yield start, i
            start, held = i, 0
        held += len(row)
    if start < len(rows):
        yield start, len(rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_none(ids: DataFrame, most: int = 250_000) -> bool:
    """Whether `ids` has at most `most` rows: only then may it be broadcast."""
    return ids.limit(most + 1).count() <= most


def concat_batches(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks() if held else None


def digest_hex(values: list[bytes]) -> list[str]:
    import hashlib

    return [hashlib.sha256(v).hexdigest() for v in values]


def with_row_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
