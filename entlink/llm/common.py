"""What the operators of this subpackage share: scratch tables and table loading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and driver and executors
    are one process (tests) a temporary folder is made and used; a cluster without it is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='entlink-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/entlink/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str, compression: str = "zstd", files: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there.

    ``files``: at most so many, for tables that are known to be small for the tasks that make them.
    Where the folder is of a local file system, files go without checksum files, each of which
    costs the process two more programs to set its mode.
    """
    path = scratch_path(df.sparkSession, name)
    plain = {"compression": compression, "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    (df if files is None else df.coalesce(files)).write.options(**plain).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(spark: SparkSession, share: int = 32) -> int:
    """Files for results that are far smaller than what they are made from: one for ``share`` shuffle partitions, eight at least."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have ``rows`` rows at most, unless the session has set a number of its own.

    Whole texts travel in them: of 10 000 long ones a batch would take hundreds of megabytes, in
    the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def need(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise if a column is missing; extra columns are allowed and ignored."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


_STATE: list[Any] = [None, None]


def worker_state(key: object, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, one thing at a time: what another operator left goes first."""
    if _STATE[0] != key:
        _STATE[:] = [None, None]
        trim()
        _STATE[:] = [key, make()]
    return _STATE[1]


def trim() -> None:
    """Give memory that is no longer needed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
