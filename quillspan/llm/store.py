"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; it goes when the application ends.

    Where the setting is absent, a temporary folder serves sessions of one
    process only; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="quillspan-"))
    path = f"{root.rstrip('/')}/quillspan-{context.applicationId}"
    jvm = context._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path if "://" in path or path.startswith("file:") else files.makeQualified(at).toString()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark's own switch: the shuffle files of a query go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    What it was computed from is needed no more, so its shuffle files are removed
    at once and do not add up over the steps of a job.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    held, path = _PATHS.pop(id(df), (None, None))
    if held is not None and held() is df:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
