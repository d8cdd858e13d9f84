"""Progress of streams as JSON lines."""

from __future__ import annotations

import json
import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """One line a batch, a file each in `path`: query, batch, rows. A batch that is told of twice has one line. `ended` is set when a query ends."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.ended = path, threading.Event()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(conf)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        out = self._fs.create(self._at(f"{self.path}/{p.runId}-{p.batchId}.json"), True)
        out.write(bytearray((json.dumps({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows}) + "\n").encode()))
        out.close()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()
