"""Tables written once to the folder that all executors share, so that several plans can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Seconds between two calls of the driver's collector, and when the last was.
PAUSE = 2.0
_tidied = [0.0]
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once in ``small_batches``; a larger row goes alone.
BATCH = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``) with its scheme. Unset, it is a temporary one, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, folder, True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return qualified(spark, found).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: without one it means the default file system, as Spark reads it."""
    return path if "://" in path else _system(spark, path)[1].toString().replace("file:/", "file:///", 1)


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, at.makeQualified(system.getUri(), system.getWorkingDirectory())


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path.rsplit("/", 1)[0]
    _tidy(spark)
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside send rows to Python in batches of ``BATCH`` bytes: by count alone 10,000 texts are one batch, which the
    executor and its worker hold in several copies. A limit that the session sets itself stays."""
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def _tidy(spark: SparkSession) -> None:
    """Let Spark clean up the shuffles behind tables that are written: it deletes their files once the driver has collected what
    refers to them, which a large heap may put off for long. In local mode files go with the process soon enough."""
    if not spark.sparkContext.master.startswith("local[") and time.monotonic() - _tidied[0] > PAUSE:
        spark._jvm.java.lang.System.gc()
        _tidied[0] = time.monotonic()


def drop(*stashed: DataFrame) -> None:
    """Delete the files of stashed tables that no later plan reads."""
    for df in stashed:
        if getattr(df, "scratch", None) in _made:
            _delete(df.sparkSession, df.scratch)


def scratch_mark() -> int:
    return len(_made)


def drop_since(spark: SparkSession, mark: int, keep: list[DataFrame]) -> None:
    """Delete all scratch made since ``mark`` but the tables to keep: once a result is stashed, nothing reads the rest."""
    kept = {df.scratch for df in keep}
    for folder in [f for f in _made[mark:] if f not in kept]:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    _made.remove(folder)
    _system(spark, folder)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
