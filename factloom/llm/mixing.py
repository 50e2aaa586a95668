"""Mixing sources to target weights in fixed-length token blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import text as T
from factloom.llm.runtime import ship, table

BLOCK_WORDS = 128
SHARDS = 256
#: A source has at least this many blocks, shorter ones if need be: its quota is rounded to a block.
LEAST_BLOCKS = 64
#: Sources at most: the driver holds their list, and their block counts for each shard.
MOST_SOURCES = 10_000
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Tokens to take from each source: ``share`` of all by weight (repeating), none above ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weight[i] for i in free)
        out = [most * sizes[i] if i in capped else left * weight[i] / total for i in range(len(sizes))]
        over = [i for i in free if out[i] > most * sizes[i]]
        if not over:
            return out
        capped.update(over)


def block_length(size: int, block: int) -> int:
    """Words in each block of a source of ``size`` words: ``block``, or less where that gave under ``LEAST_BLOCKS`` of them."""
    return max(1, min(block, size // LEAST_BLOCKS))


def draw_shards(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each output shard: multinomial by what is left, so that the columns sum to the quotas."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, dtype=np.int64)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    for k in range(shards):
        size = int(left.sum()) // (shards - k)
        while size:
            drawn = np.minimum(rng.multinomial(size, left / left.sum()), left)
            out[k] += drawn
            left -= drawn
            size -= int(drawn.sum())
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key, at ``index``: a Feistel network walked into range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for step in range(4):
            left, right = right, left ^ (T.mix(right + key[todo] * T.BASE, step) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in T.chunks(batch.column("text")):
            n = len(offsets) - 1
            size = np.diff(T.words(data, offsets)[2]).astype(np.int64)
            kept = [batch.column(c).slice(row, n) for c in ("doc_id", "source", "tie")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size)], ["doc_id", "source", "tie", "size"])


def _slots(first: np.ndarray, start: np.ndarray, source: np.ndarray, blocks: np.ndarray, seed: int):
    """Map slot numbers to blocks. first: slot at which each (shard, source) cell begins; start: slots of the source before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("id").to_numpy()
            cell = np.searchsorted(first, slot, side="right") - 1
            nth = start[cell] + slot - first[cell]
            size = blocks[source[cell]]
            epoch = nth // size
            key = T.mix((source[cell] * 1_000_003 + epoch).astype(np.uint64), seed)
            yield pa.RecordBatch.from_arrays([pa.array(source[cell]), pa.array(permuted(nth % size, size, key))], ["source_no", "block"])

    return run


def _plan(docs: DataFrame, block: int, shards: int, seed: int, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, source, tie, size, row, source_no), source table, and uses of each row's blocks."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("tie"))
    sized = docs.mapInArrow(_sizes, "doc_id long, source string, tie long, size long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sized = sized.repartitionByRange(parts, "source", "doc_id", "tie").sortWithinPartitions("source", "doc_id", "tie")
    sized = table(sized.select("*", F.monotonically_increasing_id().alias("row")).withColumn("part", F.shiftright("row", 33).cast("int")))

    # One row for a source: the driver holds the list of sources, nothing of their documents.
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sizes = {r.source: r.words for r in sums.groupBy("source").agg(F.sum("words").alias("words")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    total = [int(sizes[x]) for x in names]
    target = targets(total, weights, share, most) if names else []
    lengths = [block_length(n, block) for n in total]
    blocks = np.array([-(-n // length) for n, length in zip(total, lengths, strict=True)], dtype=np.int64)
    quotas = [int(min(np.floor(most * b), round(t * b / n))) if n else 0 for t, b, n in zip(target, blocks, total, strict=True)]
    rows = [(i, *x) for i, x in enumerate(zip(names, total, target, lengths, strict=True))]
    sources = spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, length int")

    drawn = draw_shards(quotas, shards, seed) if names else np.zeros((1, 1), dtype=np.int64)
    start = np.cumsum(drawn, axis=0) - drawn
    flat = drawn.ravel()
    used = flat > 0
    first = (np.cumsum(flat) - flat)[used]
    source = np.tile(np.arange(drawn.shape[1]), len(drawn))[used]
    slots = spark.range(int(flat.sum()), numPartitions=parts).mapInArrow(_slots(first, start.ravel()[used], source, blocks, seed), "source_no long, block long")
    uses = slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))

    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    joined = offsets.join(F.broadcast(sources), offsets.source.eqNullSafe(sources.source)).select(
        F.col("part").alias("_part"), offsets.source.alias("_source"), "offset", "source_no", "source_size", "target", "length"
    )
    within = Window.partitionBy("part", "source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(joined, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("start", F.col("offset") + F.col("within")).select("doc_id", "tie", "size", "row", "source_no", "source_size", "target", "length", "start")
    ends = F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length")))
    pieces = placed.filter("size > 0").select("row", "doc_id", "tie", "source_no", "start", "size", "length", F.explode(ends).alias("block"))
    at = F.greatest(F.col("block") * F.col("length"), F.col("start")) - F.col("start")
    to = F.least((F.col("block") + 1) * F.col("length"), F.col("start") + F.col("size")) - F.col("start")
    pieces = pieces.select("row", "doc_id", "tie", "source_no", "block", at.alias("from"), to.alias("to"))
    return placed, sources, pieces.join(uses, ["source_no", "block"])


def mix_sources(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    The words of a source, its documents in the order of doc_id, are packed end to end into blocks
    of ``block`` words; the last may be short. A source of less than ``LEAST_BLOCKS`` such blocks has
    shorter ones, all of one length, so that rounding stays a small part of its target. Sources by code point, null last, weigh ``weights``
    (repeating) and share ``share`` of all words, none above ``most`` times its size. Each output
    shard draws multinomial counts of blocks from what is left of these quotas, so the totals meet
    them to a block. A slot of a source walks through pseudorandom permutations of its blocks, one
    after the other, so no block is used more than ``ceil`` of its average, and never more than
    ``most`` times. Blocks are joined by their index with the pieces of documents that lie in them.
    taken is the number of words used, repeats counted.

    Everything follows from the rows and ``seed``: reruns agree. A text that is null or without words
    has size 0 and nothing is taken from it; rows that repeat are packed one after the other. An empty
    table gives none; more than ``MOST_SOURCES`` sources are a ValueError.
    """
    placed, _, pieces = _plan(docs, block, shards, seed, weights, share, most)
    taken = pieces.groupBy(F.col("row").alias("_row")).agg(F.sum((F.col("to") - F.col("from")) * F.col("uses")).alias("taken"))
    out = placed.join(taken, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(names: list[str]):
    """Cut out of each text the words of its pieces, once for each use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("__mix_pieces").to_pylist()
            for row, data, offsets in T.chunks(batch.column("text")):
                n = len(offsets) - 1
                starts, _, at = T.words(data, offsets)
                take, texts = [], []
                raw = data.tobytes()
                for i in range(n):
                    own = np.concatenate([[offsets[i]], starts[at[i] + 1 : at[i + 1]], [offsets[i + 1]]])
                    mine = pieces[row + i]
                    for k in range(1, max(p["uses"] for p in mine) + 1):
                        cut = b"".join(raw[own[p["from"]] : own[p["to"]]] for p in mine if p["uses"] >= k)
                        take.append(row + i)
                        texts.append(cut.decode())
                picked = batch.take(pa.array(take, pa.int64()))
                out = {c: picked.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in names:
                    out["n_chars"] = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return run


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, as documents with the columns of ``docs``: its words that are in drawn blocks.

    A document whose blocks are used k times at most gives k rows; the first holds the words of all
    of its drawn blocks, the next those drawn at least twice, and so on, in the order of the text.
    n_chars, if there, is set anew; documents of which nothing is drawn are left out. Of rows with
    equal doc_id and text one carries the draws of all.
    """
    _, _, pieces = _plan(docs, *[options.get(k, d) for k, d in (("block", BLOCK_WORDS), ("shards", SHARDS), ("seed", 0), ("weights", WEIGHTS), ("share", 1.5), ("most", 2.0))])
    merged = pieces.groupBy("doc_id", "tie", "from", "to").agg(F.sum("uses").cast("int").alias("uses"))
    cuts = merged.groupBy(F.col("doc_id").alias("__mix_id"), F.col("tie").alias("__mix_tie")).agg(F.sort_array(F.collect_list(F.struct("from", "to", "uses"))).alias("__mix_pieces"))
    rows = docs.withColumn("__mix_hash", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(cuts, rows.doc_id.cast("long").eqNullSafe(F.col("__mix_id")) & (F.col("__mix_hash") == F.col("__mix_tie")))
    return rows.select(*docs.columns, "__mix_pieces").mapInArrow(_cut(docs.columns), docs.schema)
