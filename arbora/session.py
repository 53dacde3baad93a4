"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Estimates of more bits than this, an exabyte, mean nothing.
SIZE_BITS = 60


def local_session(cores: int = 4, partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("arbora")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where it is unset.

    Our own folder is made only for masters that run in one process, where the machine's disk is shared by all tasks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on; survives the loss of executors.

    A checkpoint keeps the estimated size of its plan, which joins multiply: after some rounds of a loop the estimate has thousands of
    digits and planning never ends. Estimates beyond any real size are therefore dropped.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    query = done._jdf.queryExecution()
    if query.optimizedPlan().stats().sizeInBytes().bit_length() <= SIZE_BITS:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(query.toRdd(), done._jdf.schema(), False), spark)


def spread(df: DataFrame, least: int = 1) -> int:
    """Partitions for a Python stage: as many as the cluster runs at once, or the session's shuffle partitions if more."""
    spark = df.sparkSession
    return max(least, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A new name in the shared folder for files that tasks write and read; what is there is deleted at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4()}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield fs.makeQualified(path).toString()
    finally:
        fs.delete(path, True)
