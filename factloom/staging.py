"""Tables written to the folder that driver and executors share, to end lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, removed when Python exits.

    Where that is unset, a local master gets a temporary folder; on a cluster, whose executors would
    each write to their own disk, it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder and not getattr(context, "_tables_removed_at_exit", False):
        context._tables_removed_at_exit = True
        atexit.register(_remove, context, f"{folder.rstrip('/')}/tables_{context.applicationId}")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(context, "_own_shared_dir", None)
        if folder is None:
            folder = context._own_shared_dir = tempfile.mkdtemp(prefix="shared_")
            atexit.register(shutil.rmtree, folder, True)
    return f"{folder.rstrip('/')}/tables_{context.applicationId}"


def _remove(context, path: str) -> None:
    if context._jsc is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def write(df: DataFrame) -> str:
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def table(df: DataFrame) -> DataFrame:
    """``df`` as a written Parquet table: lineage ends there and lost executors lose nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df))
