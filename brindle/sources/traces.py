"""An appending sink with a two-step commit: files first, then the list of a batch's files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows that a task holds before it writes a file.
FILE_ROWS = 200_000


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TraceWriter(DataSourceStreamWriter):
    """Tasks write files that nobody reads yet; the driver then writes `batches/<id>.json`, which names them. A batch that was committed before keeps its
    first files and those of the new attempt go, so a batch that is run again appends once; files of an attempt that failed go too."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def _filesystem(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        filesystem, root = self._filesystem()
        filesystem.create_dir(f"{root}/parts", recursive=True)
        kinds, files, rows = to_arrow_schema(self.schema), [], []

        def flushed() -> None:
            files.append(f"{uuid.uuid4().hex}.parquet")
            pq.write_table(pa.Table.from_pylist([r.asDict() for r in rows], schema=kinds), f"{root}/parts/{files[-1]}", filesystem=filesystem)
            rows.clear()

        for row in iterator:
            rows.append(row)
            if len(rows) >= FILE_ROWS:
                flushed()
        if rows:
            flushed()
        return Written(files)

    def _removed(self, messages: list[Written | None]) -> None:
        filesystem, root = self._filesystem()
        for name in (f for m in messages if m is not None for f in m.files):
            filesystem.delete_file(f"{root}/parts/{name}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        filesystem, root = self._filesystem()
        target = f"{root}/batches/{batchId}.json"
        if filesystem.get_file_info(target).is_file:
            self._removed(messages)
            return
        filesystem.create_dir(f"{root}/batches", recursive=True)
        staged = f"{root}/{uuid.uuid4().hex}.staged"  # a list is there as a whole or not at all
        with filesystem.open_output_stream(staged) as out:
            out.write(json.dumps({"batch": batchId, "files": [f for m in messages if m is not None for f in m.files]}).encode())
        filesystem.move(staged, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._removed(messages)


class TraceSink(DataSource):
    """`df.writeStream.format("trace_sink").option("path", ...)`."""

    @classmethod
    def name(cls) -> str:
        return "trace_sink"

    def streamWriter(self, schema: StructType, overwrite: bool) -> TraceWriter:  # noqa: N802
        return TraceWriter(self.options["path"], schema)


def appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the committed batches appended."""
    files = [f"{path}/parts/{f}" for r in spark.read.schema("batch bigint, files array<string>").json(f"{path}/batches").collect() for f in r.files]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
