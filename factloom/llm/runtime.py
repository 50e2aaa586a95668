"""Shared folder, cut lineage and input handling for the corpus operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.staging import shared_dir

#: Rows of two or three longs up to which a side is broadcast; a larger side is shuffled.
BROADCAST_ROWS = 400_000

#: Rows in an Arrow batch: rows hold whole texts, so Spark's default of 10,000 takes tens of MB in every task.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024

_here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and keep batches of texts small unless the session says otherwise."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    if getattr(context, "_package_shipped", False):
        return
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{os.path.basename(_here)}_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(_here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_here)))
    context.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)
    context._package_shipped = True


def table(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``table``, with the rows of equal ``key`` in one bucket file: joins on it do not shuffle this side."""
    spark = df.sparkSession
    name = f"t_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018  resolves the files before the name goes
    spark.sql(f"DROP TABLE {name}")
    return found


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if its counted size allows it; otherwise leave it to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def id_text() -> Column:
    """doc_id as text; a null id counts as empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
