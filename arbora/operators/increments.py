"""Processing only records that no successful run has taken yet.

Change capture from a log:

* ``ChangeLog`` keeps a durable log: appended segments with an offset per partition, a batch plan written before processing starts
  and replayed after a failure, and a sink that keeps one row per key and offset.
* ``pending`` feeds it where the committed offsets are kept in a table: every record path is a partition, its version (here a
  modification time) is the offset, and the last successful run's note per path is the committed offset. ``capture`` does both.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.session import shared_dir


def canonical_path(path: Column) -> Column:
    """One spelling per path: forward slashes, no empty or ``.`` parts, ``..`` folded into the part before it.

    A leading ``..`` of a relative path stays, above the root of an absolute path it is dropped. Null stays null.
    """
    unified = F.translate(path, "\\", "/")
    parts = F.filter(F.split(unified, "/"), lambda p: (p != "") & (p != "."))
    absolute = unified.startswith("/")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part != "..", F.concat(done, F.array(part))).when(can_pop, popped).when(absolute, done).otherwise(F.concat(done, F.array(part)))

    folded = F.when(F.array_contains(parts, ".."), F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)).otherwise(parts)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def committed_offsets(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, run_id, offsets): per path what the last successful run, by run_id, noted.

    A run is successful if runs lists it as ``ok``. Notes with a null path or an unknown run count for nothing. A run that noted
    one path several times leaves all its distinct offsets.
    """
    good = runs.where(F.col("status") == "ok").select("run_id").distinct()
    notes = files.select(canonical_path(F.col("file_path")).alias("path"), "run_id", "mtime_ns").where(F.col("path").isNotNull())
    per_run = notes.join(good, "run_id", "left_semi").groupBy("path", "run_id").agg(F.collect_set("mtime_ns").alias("offsets"))
    return per_run.groupBy("path").agg(F.max("run_id").alias("run_id"), F.max_by("offsets", "run_id").alias("offsets"))


def pending(symbols: DataFrame, files: DataFrame, runs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The rows of symbols whose (path, mtime) no successful run has taken; every column, repeated rows included.

    Taken means that mtime is within ``tolerance`` seconds of an offset that ``committed_offsets`` holds for the path, in any
    spelling. A null path or mtime is never taken, an mtime of 0 is compared like any other. The offsets hold one row per path,
    so the join keeps the rows of symbols as they are; a path with very many rows is split by the adaptive skew join.
    """
    offsets = committed_offsets(files, runs).select("path", "offsets")
    rows = symbols.select(F.struct("*").alias("row"), canonical_path(F.col("file_path")).alias("path"), F.col("mtime").alias("at"))
    near = F.exists("offsets", lambda o: F.abs(F.col("at") - o / F.lit(1e9)) <= tolerance)
    return rows.join(offsets, "path", "left").where(~F.coalesce(near, F.lit(False))).select("row.*")


def capture(symbols: DataFrame, files: DataFrame, runs: DataFrame, folder: str | None = None, process=None) -> DataFrame:
    """The next batch as the sink keeps it, every column of symbols, taken through a ``ChangeLog`` in ``folder``.

    What ``pending`` finds is appended to the log, the plan is written, the batch is processed and read from the sink, one row per
    qualified_name, path and mtime. If an earlier call with the same folder failed after its plan was written, that plan is replayed
    first; what it took is in the sink once, however often it was appended. Without a folder the log is a new one in the shared folder.
    process: applied to every batch, DataFrame to DataFrame, keeping its columns. Nothing pending gives an empty result.
    """
    log = ChangeLog(symbols.sparkSession, folder, "key", ("path", "at"))
    process = process or (lambda batch: batch)
    if log.is_open():
        log.run(process)
    log.append(pending(symbols, files, runs).select(F.struct("*").alias("row"), F.col("qualified_name").alias("key"), canonical_path(F.col("file_path")).alias("path"), F.col("mtime").alias("at")))
    while log.run(process):
        pass
    return log.sink().select("row.*") if log.finished() else symbols.limit(0)


class ChangeLog:
    """A durable log of records and the state of its one consumer, all in one folder of a shared file system.

    ``append`` adds a segment whose rows carry (partition, offset) by the task that wrote them; no shuffle. ``plan`` writes the
    ranges that the next batch covers before anything is processed. ``run`` processes the open plan, replaying it after a failure,
    and marks it done only once its output is complete. ``sink`` reads the output, one row per key and offset; ``version`` names the
    columns of the records that are their offset for this purpose, the place in the log if none are named.
    Markers are written in a folder of their own and renamed, so whatever a crash leaves there is never read. One writer at a time: on
    stores whose rename overwrites, two that write the same marker could both succeed. Rows are appended as they are: null keys and repeated rows stay, and an empty frame makes an empty segment. The columns
    ``_segment``, ``_partition`` and ``_offset`` must not exist in the records.
    """

    RESERVED = ("_segment", "_partition", "_offset")

    def __init__(self, spark: SparkSession, folder: str | None = None, key: str = "qualified_name", version: tuple[str, ...] = RESERVED):
        self.spark, self.key, self.version = spark, key, version
        self.folder = folder or f"{shared_dir(spark)}/changelog-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, sub: str) -> list[str]:
        path = self._path(sub)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []
        return [n for n in names if not n.startswith((".", "_"))]  # what file systems and Spark keep beside the markers

    def _put(self, name: str, value: dict) -> None:
        """Written aside and renamed: a reader sees all of it or nothing."""
        temporary = self._path(f"unfinished/{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(self._path(name).getParent())
        if self._fs.exists(self._path(name)) or not self._fs.rename(temporary, self._path(name)):
            raise OSError(f"{name} exists already")

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def append(self, records: DataFrame) -> str:
        """Adds the records as one segment; it counts only once its marker is written. Returns the segment's name."""
        taken = set(records.columns) & set(self.RESERVED)
        if taken:
            raise ValueError(f"reserved columns: {sorted(taken)}")
        segment = f"{len(self._names('segments')):09d}-{uuid.uuid4().hex[:8]}"
        number = F.monotonically_increasing_id()
        (records.withColumn("_segment", F.lit(segment)).withColumn("_partition", F.shiftright(number, 33)).withColumn("_offset", number.bitwiseAND((1 << 33) - 1)).write.parquet(f"{self.folder}/data/{segment}"))
        ends = self.spark.read.parquet(f"{self.folder}/data/{segment}").groupBy("_partition").agg(F.max("_offset").alias("last")).collect()
        self._put(f"segments/{segment}", {str(r["_partition"]): r["last"] + 1 for r in ends})
        return segment

    def committed(self) -> dict[str, dict[str, int]]:
        """The end offsets per segment and partition that finished batches cover."""
        done: dict[str, dict[str, int]] = {}
        for name in self._names("done"):
            for segment, ends in self._get(f"plans/{name}").items():
                for partition, (_, end) in ends.items():
                    known = done.setdefault(segment, {})
                    known[partition] = max(known.get(partition, 0), end)
        return done

    def plan(self) -> str | None:
        """The open plan's name, or that of a new one written now; None if nothing is left to take."""
        done = set(self._names("done"))
        for name in self._names("plans"):
            if name not in done:
                return name
        committed = self.committed()
        ranges: dict[str, dict[str, list[int]]] = {}
        for segment in self._names("segments"):
            for partition, end in self._get(f"segments/{segment}").items():
                start = committed.get(segment, {}).get(partition, 0)
                if end > start:
                    ranges.setdefault(segment, {})[partition] = [start, end]
        if not ranges:
            return None
        name = f"{len(self._names('plans')):09d}"
        self._put(f"plans/{name}", ranges)
        return name

    def is_open(self) -> bool:
        """Whether a plan was written whose batch isn't done."""
        return bool(set(self._names("plans")) - set(self._names("done")))

    def finished(self) -> bool:
        """Whether any batch is done."""
        return bool(self._names("done"))

    def batch(self, name: str) -> DataFrame:
        """The records that the plan covers, the same at every call."""
        ranges = [(s, int(p), lo, hi) for s, parts in self._get(f"plans/{name}").items() for p, (lo, hi) in parts.items()]
        wanted = self.spark.createDataFrame(ranges, "_segment string, _partition long, _lo long, _hi long")
        rows = self.spark.read.parquet(*[f"{self.folder}/data/{s}" for s in sorted({r[0] for r in ranges})])
        kept = rows.join(wanted, ["_segment", "_partition"]).where((F.col("_offset") >= F.col("_lo")) & (F.col("_offset") < F.col("_hi")))
        return kept.drop("_lo", "_hi")

    def run(self, process) -> str | None:
        """Takes one batch through ``process`` (DataFrame to DataFrame, keeping key, segment, partition and offset).

        Whatever fails before the marker leaves the plan open; the next call replays it and overwrites its output.
        """
        name = self.plan()
        if name is None:
            return None
        process(self.batch(name)).write.mode("overwrite").parquet(f"{self.folder}/out/{name}")
        self._put(f"done/{name}", {"batch": name})
        return name

    def sink(self) -> DataFrame:
        """All finished output, one row per key and offset."""
        done = self._names("done")
        if not done:
            raise LookupError("no batch is finished")
        out = self.spark.read.parquet(*[f"{self.folder}/out/{name}" for name in done])
        return out.dropDuplicates([self.key, *self.version])
