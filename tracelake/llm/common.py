"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of whole texts that go to Python at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Spark's setting that removes the shuffle files of a frame once it has run.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``.  Where none is configured, a local
    session gets one of our own and a cluster an error, as executors elsewhere couldn't read it.
    The files survive the loss of any executor and are removed by ``release``, or once the frame is
    garbage collected, if the cluster enables that.  Shuffle files behind them go at once: a driver
    with little garbage would keep them, several times the input, until the end.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt"))
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame has the setting of when it was made
    finally:
        if was is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, was)


def release(*frames: DataFrame) -> None:
    """Remove the files of frames that ``cut`` made and nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        path.getFileSystem(conf).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of ``frames`` has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def each(f: Callable[[Any], Any], batches: Iterator[Any]) -> Iterator[Any]:
    """``f`` of each batch; freed memory goes back to the system after the last one."""
    for x in batches:
        yield f(x)
    tidy()


def tidy() -> None:
    """Give freed memory back to the system.  Python workers live on for the next stages, and what
    their allocators keep counts against the executor."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Send at most BATCH_ROWS rows, or about BATCH_BYTES, at a time to Python: whole texts are large,
    and each of several workers of an executor holds a batch more than once (Arrow, strings,
    results)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_crc(col: str) -> Column:
    """crc32 of an integer id written as text."""
    return F.crc32(F.col(col).cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashes(count: int, most: int) -> int:
    """Threshold that lets about ``most`` of ``count`` 64-bit hashes through (those below it)."""
    return min((1 << 63) - 1, -(1 << 63) + (most * (1 << 64)) // max(1, count))
