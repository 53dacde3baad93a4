"""Structured Streaming: the graph kept up to date from a stream of changed files, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.operators.graph import append, delete_files_narrow, upsert
from arbora.sources import ingest
from arbora.schema import EDGES, NODES


class LiveGraph:
    """Nodes and edges as Parquet versions in a folder; every micro batch of files replaces what these files held before.

    Batches are numbered by the stream; one that comes again after a failure writes the same version folder again and starts from the
    version before it, so nothing is taken twice. ``version`` names the batch last completed, -1 before the first; it is told by markers
    in the folder, so that a stream that is started again goes on where it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self) -> list[int]:
        folder = self._path(f"{self.folder}/done")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    @property
    def version(self) -> int:
        return max(self._done(), default=-1)

    def tables(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        at = self.version if version is None else version
        if at < 0:
            return self.spark.createDataFrame([], NODES).drop("modifiers"), self.spark.createDataFrame([], EDGES)
        return self.spark.read.parquet(f"{self.folder}/{at}/nodes"), self.spark.read.parquet(f"{self.folder}/{at}/edges")

    def take(self, files: DataFrame, batch: int) -> None:
        """files: (file_path, language, source_text); of repeated paths the greatest text counts, a null text deletes the file."""
        one = files.groupBy("file_path").agg(F.max(F.struct("source_text", "language")).alias("v")).select("file_path", "v.language", "v.source_text")
        before = max((v for v in self._done() if v < batch), default=-1)
        nodes, edges = delete_files_narrow(*self.tables(before), one)
        fresh_nodes, fresh_edges, _ = ingest.build(one)
        upsert(nodes, fresh_nodes).write.mode("overwrite").parquet(f"{self.folder}/{batch}/nodes")
        append(edges, fresh_edges).write.mode("overwrite").parquet(f"{self.folder}/{batch}/edges")
        self._fs.create(self._path(f"{self.folder}/done/{batch}"), True).close()

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, batch: self.take(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, value) per window of ``ts``; works on a stream, with a watermark for late rows, and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "events", "value")
