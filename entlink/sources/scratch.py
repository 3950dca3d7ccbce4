"""Tables in the folder that driver and executors share, and small files beside them."""

from __future__ import annotations

import gc
import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where driver and executors are one process a temporary folder will do."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='entlink-')}"
        sc.setCheckpointDir(where)
    return where


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/entlink/{name}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: it is computed once and lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """``stage`` with zstd: for tables of texts and vectors, whose size counts."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and the files of shuffles that made them."""
    for df in tables:
        spark = df.sparkSession
        for path in {f"{name.rpartition('/')[0]}" for name in df.inputFiles()}:
            fs, where = _fs(spark, path)
            if "/entlink/" in path:
                fs.delete(where, True)
    released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles whose results are staged: it does so once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Full names of all files below ``path``, in order; none if it does not exist."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    found, out = fs.listFiles(where, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Written beside its place and put there by one rename that overwrites, so that a reader sees the old file or the new one."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, there = _fs(spark, beside)
    stream = fs.create(there, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    sc, hadoop = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
    how = getattr(hadoop, "Options$Rename")
    options = sc._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    hadoop.FileContext.getFileContext(there.toUri(), sc._jsc.hadoopConfiguration()).rename(there, hadoop.Path(path), options)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, value: object, path: str) -> None:
    write_text(spark, json.dumps(value, indent=2, sort_keys=True), path)


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def fingerprint(spark: SparkSession, path: str, settings: object = None) -> str:
    """One digest of all files below ``path`` (names and contents, each below 2 GB) and of the settings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("digest"))
    parts = sorted((r.path.removeprefix(path), r.digest) for r in files.collect())
    return hashlib.sha256(json.dumps([parts, settings], sort_keys=True).encode()).hexdigest()


def discover(spark: SparkSession, roots: list[str], marker: str, required: tuple[str, ...] = ()) -> str:
    """The one folder below ``roots`` that holds ``marker`` and all required files; else an error."""
    found = set()
    for root in roots:
        names = listed(spark, root)
        have = set(names)
        found |= {n.rpartition("/")[0] for n in names if n.endswith(f"/{marker}") and all(f"{n.rpartition('/')[0]}/{x}" in have for x in required)}
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} folders have {marker}: {', '.join(sorted(found))}")
    return found.pop()
