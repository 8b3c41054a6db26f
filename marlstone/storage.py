"""Shared storage for results that a job reads more than once."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: The optimiser gives sizes of this order to inputs that it knows nothing of.
UNKNOWN_BYTES = 1 << 50
#: Spark's setting of an Arrow batch's bytes, and our value.
_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session has none and runs on one machine (tests), a temporary
    folder is made and set, once per session; on a cluster that raises.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder goes with the cluster's own clean-up
        pass


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it Arrow batches hold BATCH bytes, unless the session has set a limit: of long texts a task holds several copies of a batch, in Spark and in Python."""
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The folder is removed by :func:`release` or at the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing will read it again."""
    path = getattr(df, "_marlstone_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    It learns of them when the driver collects garbage, which a driver with little to do puts off while disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate (file sizes for a plain scan), without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_bytes: int, least: int = 8, most: int = 100_000) -> int:
    """Number of partitions of about ``target_bytes`` each for a pass over ``df``."""
    size = estimated_bytes(df)
    if size >= UNKNOWN_BYTES:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(most, -(-size // target_bytes)))
