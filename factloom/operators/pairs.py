"""Joins whose result is much larger than their input: pairs of all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.staging import table

#: Rows of a key that are joined at once with as many of the other side.
BLOCK = 2_000
#: Pairs for each input row from which a join counts as one that makes many.
MANY = 4


def counted(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with its rows on both sides."""
    sides = [rows.groupBy(*keys).agg(F.count("*").alias(name)) for rows, name in ((left, "left_rows"), (right, "right_rows"))]
    return sides[0].join(sides[1], keys, "full").na.fill(0, ["left_rows", "right_rows"])


def makes_many(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    found = counted(left, right, keys).agg(F.sum(F.col("left_rows") * F.col("right_rows").cast("double")), F.sum(F.col("left_rows") + F.col("right_rows"))).head()
    return (found[0] or 0) > MANY * (found[1] or 0)


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two sets of rows on ``keys``, none of them null, in cells.

    The rows of a key are dealt over blocks of about ``BLOCK`` rows by their hash, and each block of one side
    meets each block of the other in a cell of its own. A pair of rows is in one cell, a task holds one block
    at a time, and a key of any size is shared by all tasks. A row is copied once for each block it meets.
    """
    blocks = lambda name: F.greatest(F.ceil(F.col(name) / BLOCK), F.lit(1)).cast("int")
    large = table(counted(left, right, keys).filter(F.greatest("left_rows", "right_rows") > BLOCK).select(*keys, blocks("left_rows").alias("left_blocks"), blocks("right_rows").alias("right_blocks")))
    if large.isEmpty():
        return left.join(right.hint("merge"), keys)
    cell, parts = [*keys, "left_block", "right_block"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(rows: DataFrame, own: str, other: str) -> DataFrame:
        of = lambda side: F.coalesce(f"{side}_blocks", F.lit(1))
        block = F.pmod(F.xxhash64(*rows.columns), of(own)).cast("int").alias(f"{own}_block")
        met = F.explode(F.sequence(F.lit(0), of(other) - 1)).alias(f"{other}_block")
        return rows.join(large, keys, "left").select(*rows.columns, block, met).repartition(parts, *cell)

    return cut(left, "left", "right").join(cut(right, "right", "left").hint("merge"), cell).drop("left_block", "right_block")
