"""Shared storage for intermediate tables.

Intermediate results that are read more than once, or whose size decides the
plan of a later step, are written as Parquet under the folder that the session
names in ``spark.checkpoint.dir``.  That folder is shared by all executors, so
the loss of one costs nothing, and the files' sizes give the optimizer true
statistics: it broadcasts a small table and shuffles a large one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a single-JVM session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomtext-")
        atexit.register(_remove, _own[app])
    return "file://" + _own[app]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtext-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``scratch`` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)


def small(df: DataFrame, limit: int) -> DataFrame:
    """A written table with the hint to broadcast it if its files take at most ``limit`` bytes, else the table as it is."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size of a table; for one just written, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
