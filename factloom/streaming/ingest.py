"""JSON lines arriving in a folder, appended to a fact store as they come."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.facts import FactStore, parse_lines


def follow(spark: SparkSession, folder: str, store: FactStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that appends the facts of new files in ``folder``; each file is read once.

    A micro-batch is stored under the stream's checkpoint and its number, so one that comes again after
    a failure is stored once; see ``FactStore.add_facts``.
    """
    lines, stream = spark.readStream.text(folder), hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        store.add_facts(parse_lines(batch).filter(F.size("entities") > 0).select("entities", "source"), batch_id=f"{stream}_{number}")

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
