"""Shared-folder tables: how lineage is cut and intermediate results survive executor loss.

Everything is written below the folder the cluster names in ``spark.checkpoint.dir``.  Only a local
session may leave it unset; it gets a folder of its own, which goes when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Root folder for intermediate tables, shared by all executors; also the session's checkpoint folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
        named = _local_roots[app]
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/framelake-{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder.

    The files belong to the frame: Spark's cleaner deletes them when nothing refers to it any more
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    scratch_root(df.sparkSession)
    return df.checkpoint()


class Intermediate:
    """Tables of a multi-step operator, dropped together once its result is computed, or when a step fails."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Intermediate:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self._spark, label)
        self._paths.append(path)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def own(self, path: str) -> str:
        """A folder below the scratch root that others write; it is dropped with the tables."""
        self._paths.append(path)
        return path

    def drop(self) -> None:
        for path in self._paths:
            target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)
        self._paths.clear()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one file, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme Spark resolves it to, for readers and writers outside of Spark."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(target).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)
