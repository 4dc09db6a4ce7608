"""Session helpers: shared scratch space, table reading, worker code, sizing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python. Texts may be long, so batches stay small.
ARROW_ROWS = 1000
ARROW_BYTES = "4m"
#: Whether a write's shuffle files go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that one batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def tidy() -> None:
    """Give memory that is free in this Python worker back to the system: workers live longer than tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def fresh(name: str, *taken: DataFrame | list[str]) -> str:
    """A column name like `name` that no column has, whatever its case."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in used:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and all runs in one process, as in tests,
    a folder under /tmp/checkpoints is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{os.getpid()}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 the session may be gone when the interpreter ends
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: this cuts the lineage.

    What is written survives lost executors; it goes when the application ends. The shuffles that made it go at once:
    else they stay until the driver happens to collect its garbage, and disk grows with all that was ever shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.parquet(path)
    out._quern_path = path
    return out


def memo(make):
    """make(spark, sf_dir) once for a session and its tables: what several queries of one session read again. Only the last result is kept."""
    last: dict[tuple[str, str], object] = {}

    @functools.wraps(make)
    def found(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in last:
            last.clear()
            last[key] = make(spark, sf_dir)
        return last[key]

    return found


def discard(df: DataFrame) -> None:
    """Remove what stored() wrote for df at once; only where nothing that is still to run reads it."""
    if path := df.__dict__.pop("_quern_path", None):
        _remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df's input."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many hash buckets to deal df's content into: it grows with the input."""
    return max(partitions(df.sparkSession), min(1 << 20, input_bytes(df) // bytes_each))
