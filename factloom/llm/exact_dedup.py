"""Exact duplicates by a binomial tree of merges over sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.runtime import small, table

#: Least number of runs; there are as many as shuffle partitions if these are more, rounded up to a power of FAN_IN.
RUNS = 64
FAN_IN = 4
KEY = ("digest", "n_bytes", "check")


def _digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def _segment(bits: int) -> Column:
    """The segment of a digest among 2**bits equal ranges."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), 56 - bits)


def _merged(runs: DataFrame, keep: str, parts: int) -> DataFrame:
    """Merge what the runs of a group have in a segment: entries come sorted, equal neighbours become one.

    A partition holds whole segments and reads them in order; rows move by run and segment only.
    """
    best = F.max if keep == "largest" else F.min
    order = ["run", "segment", *KEY]
    ordered = runs.repartition(parts, "run", "segment").sortWithinPartitions(*order)
    return ordered.groupBy(*order).agg(best("keep").alias("keep"), F.sum("size").alias("size")).sortWithinPartitions(*order)


def _groups(docs: DataFrame, keep: str, runs: int | None, fan_in: int) -> DataFrame:
    """Every row's digests with keep (doc_id, row) and size of its group, written once."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted, rounds = runs or max(RUNS, parts), 0
    while fan_in**rounds < wanted:
        rounds += 1
    digit = fan_in.bit_length() - 1
    rows = table(_digests(docs).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(fan_in**rounds)).cast("int")))
    leaf = rows.select("run", F.lit(0).cast("long").alias("segment"), *KEY, F.struct("doc_id", "row").alias("keep"), F.lit(1).cast("long").alias("size"))
    up = F.floor(F.col("run") / fan_in).cast("int")
    levels = [table(_merged(leaf, keep, parts))]
    for n in range(1, rounds + 1):
        levels.append(table(_merged(levels[-1].withColumns({"run": up, "segment": _segment(digit * n)}), keep, parts)))
    done = levels.pop().filter("size > 1").drop("segment")
    while levels:
        below = levels.pop().select("run", *KEY, up.alias("up"))
        done = below.join(done.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    return rows.join(done, ["run", *KEY], "left")


def exact_groups(docs: DataFrame, keep: str = "largest", runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; null counts as empty. Of equal texts the row with the
    ``keep`` ("largest" or "smallest") doc_id stays; of repeated rows with that id one stays, and a
    null id is below all others. Other columns are not read.

    Rows are dealt into runs by row, not by digest, so copies of one text spread over all of them.
    Each run is sorted by digest, equal entries reduced to one. Then runs are exchanged in binomial
    rounds: the ``fan_in`` (a power of two) partners of a round split their range of digests among
    themselves, each takes the others' entries of its part and merges the sorted pieces, keeping the
    identifier that wins and the number of rows. So there are as many sorted pieces after every round
    as before it; at the end each holds one range of the digests of all rows. An entry is matched on
    SHA-256, byte length and a second 64-bit hash at every level, so entries merge only where all
    three agree. Entries of more than one row then go back down the same tree to the rows, whereby no
    task meets more of a text than one run or ``fan_in`` entries hold.
    """
    found = _groups(docs, keep, runs, fan_in)
    return found.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("keep").isNull(), F.lit(True)).otherwise(F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest", runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` doesn't keep, all columns unchanged.

    Rows to drop are found by doc_id and digest; where the same doc_id and text is on several rows,
    one of these is returned.
    """
    found = _groups(docs, keep, runs, fan_in).filter("size > 1")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = found.groupBy(F.col("doc_id").alias("__dedup_id"), F.col("digest").alias("__dedup_digest")).agg(
        F.max(F.col("keep.row") == F.col("row")).alias("__dedup_stays"), F.count("*").alias("__dedup_n")
    )
    gone = table(gone)
    unique = gone.filter("__dedup_n > 1").isEmpty()
    gone = small(gone)
    marked = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__dedup_id")) & (F.unhex(F.sha2(text, 256)) == F.col("__dedup_digest")), "left")
    once = marked.filter("__dedup_n is null or (__dedup_stays and __dedup_n = 1)").select(docs.columns)
    if unique:
        return once
    repeated = marked.filter("__dedup_stays and __dedup_n > 1")
    first = repeated.groupBy("__dedup_id", "__dedup_digest").agg(F.first(F.struct(*docs.columns)).alias("__dedup_row")).select("__dedup_row.*")
    return once.unionByName(first)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
