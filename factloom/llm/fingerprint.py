"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import text as T
from factloom.llm.runtime import ship

WIDTH = 5
#: One of this many shingle hashes is retained.
SCALE = 4


def sketch(column: pa.Array, width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    """For each text its distinct retained hashes in ascending order; of a text that retains none the smallest hash alone.

    A hash is retained below 2**64 / scale, whichever text it is from, so sketches of parts merge by
    union. The lone hash of a short text is above that bound and is dropped once others join it.
    """
    out = []
    bound = np.uint64((1 << 64) // scale)
    for _, data, offsets in T.chunks(column):
        values, at = T.shingles(*T.word_hashes(data, offsets), width)
        low = values < bound
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        kept, kept_at = T.distinct_sorted(values[low], np.searchsorted(row[low], np.arange(len(at))))
        for i in range(len(at) - 1):
            own = kept[kept_at[i] : kept_at[i + 1]]
            if not len(own) and at[i + 1] > at[i]:
                own = values[at[i] : at[i + 1]].min(keepdims=True)
            out.append(own)
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both < np.uint64((1 << 64) // scale)]
    return low if len(low) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two texts' shingles, 1 for two without words."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """Estimated share of the first text's shingles that the second has, however unequal the two are.

    None where that cannot be told: a lone hash above the bound stands for a text too short to retain
    any, and is in no sketch of a text that retains some.
    """
    if len(a) == 1 and a[0] >= np.uint64((1 << 64) // scale) and not (len(b) == 1 and b[0] == a[0]):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def packed(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u8").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs`` (doc_id, text); null text is empty, whose fingerprint is ''."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [packed(x) for x in sketch(batch.column("text"), width, scale)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def compare_neighbours(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Fingerprint each text, its edited text, and compare with these and with the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    for each row of ``docs`` (doc_id, text). The next document is the one with the next smaller
    doc_id, after the smallest the largest; a single row is its own next. Null text is empty; null
    doc_ids come last, and rows of equal doc_id are in the order of their texts' hashes.

    Rows are sorted into ranges of doc_id, cut at quantiles. The first row of each range also goes
    to the range before it, so every row finds its next one while its range is read once in order.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id")
    edges = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("e")).head()["e"] or []
    edges = np.array(sorted(set(edges)), dtype=np.int64)

    # Range i holds the ids that i edges are not below; null ids are with the smallest, in the last range.
    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, doc_id.to_numpy()), dtype="int32")

    place = range_of(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("tie"))
    rows = docs.withColumn("place", place)
    # One row for a range; there are as many ranges as shuffle partitions.
    heads = {r.place: r.first for r in rows.groupBy("place").agg(F.max(order).alias("first")).collect()}
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    there = sorted(heads)
    goes = [(heads[p].known, heads[p].doc_id, heads[p].tie, there[i - 1]) for i, p in enumerate(there)]
    ahead = F.broadcast(spark.createDataFrame(goes, "_known boolean, _id long, _tie long, to int"))
    looked = rows.join(ahead, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.xxhash64("text")))
    looked = looked.select("doc_id", "text", F.col("to").alias("place")).dropDuplicates(["doc_id", "place"])
    own, next_one = rows.withColumn("peek", F.lit(False)), looked.withColumn("peek", F.lit(True))
    sorted_rows = own.unionByName(next_one).withColumn("tie", F.xxhash64("text"))
    sorted_rows = sorted_rows.repartition(parts, "place").sortWithinPartitions("place", "peek", F.col("doc_id").desc_nulls_last(), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its next one
        done: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            edited = [x[: len(x) - len(x) // 2] + following[: len(x) // 2] for _, x, following, _, _ in done]
            prints = sketch(pa.array(edited, pa.large_string()), width, scale)
            columns = [
                pa.array([x[0] for x in done], pa.int64()),
                pa.array([len(x[1]) for x in done], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([packed(x[3]) for x in done], pa.string()),
                pa.array([packed(x) for x in prints], pa.string()),
                pa.array([likeness(x[3], y) for x, y in zip(done, prints, strict=True)], pa.float64()),
                pa.array([likeness(x[3], x[4]) for x in done], pa.float64()),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            texts = batch.column("text")
            prints = sketch(texts, width, scale)
            for i, (doc_id, peek, where) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("peek").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                text = texts[i].as_py()
                if held is not None and held[3] == where:
                    done.append((held[0], held[1], text, held[2], prints[i]))
                    size += len(held[1])
                held = None if peek else (doc_id, text, prints[i], where)
                if size > 4 * T.CHUNK_BYTES:
                    yield flush()
                    size = 0
        if done:
            yield flush()

    return sorted_rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
