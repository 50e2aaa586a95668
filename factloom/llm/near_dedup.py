"""MinHash near-duplicate detection by an inverted join over signature coordinates.

1. Every document becomes its set of distinct word shingles (64-bit hashes) and a signature of
   ``COORDINATES`` minima. Documents with equal sets form a class; only its smallest id goes on.
2. A class is posted under each (coordinate, value) pair. Pairs met once cannot collide and are
   dropped. A link needs ``matches`` equal coordinates, so two linked signatures share a posting
   among the ``coordinates - matches + 1`` rarest of each (prefix filter over one global order:
   frequency, then value). Only these short prefix lists are merged; the long lists that remain
   are skipped, their collisions being counted by probing the signatures of the pairs met.
3. Pairs with ``matches`` collisions join documents into candidate groups. Each list hands on a
   spanning set of its pairs, never all of them.
4. Inside a candidate group pairs are confirmed on the full sets: intersections of a block of
   documents come from one product of their incidence matrices. Again a block hands on spanning
   links only. Components of confirmed links are the result.

Lists and groups beyond ``BLOCK`` and ``SETS_BLOCK`` members are dealt out in blocks, each member once.
What a block links becomes one, of which only the smallest member goes to the next round of blocks,
until these of a group fit one block or a round joins little. Pairs that are still apart are then compared all: members of the largest
component go to one row of blocks, the others to all of them (``_across``). No pair of different
components is left out, and pairs that are linked by others already are not compared again.

The one loss is statistical: the match threshold lies five standard deviations below the expected
collisions of a pair at the limit of similarity, so about one such pair in a hundred thousand is
missed, and far fewer above the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import text as T
from factloom.llm.components import connected
from factloom.llm.runtime import ship, small, table

COORDINATES = 64
BLOCK = 1024
SETS_BLOCK = 512


def _features(width: int, coordinates: int):
    keys = (np.arange(1, coordinates + 1, dtype=np.uint64) * T.BASE)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in T.chunks(batch.column("text")):
                hashes, at = T.word_hashes(data, offsets)
                values, at = T.distinct_sorted(*T.shingles(hashes, at, width))
                n = len(at) - 1
                counts = np.diff(at)
                sums = []
                for seed in (101, 102):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(values, seed))])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                signature = np.zeros((n, coordinates), dtype=np.uint64)
                full = np.flatnonzero(counts)
                if len(full):
                    for lo in range(0, coordinates, 4):
                        hashed = T.mix(values[None, :] ^ keys[lo : lo + 4])
                        signature[full, lo : lo + 4] = np.minimum.reduceat(hashed, at[full], axis=1).T
                raw = signature.tobytes()
                width_bytes = coordinates * 8
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        pa.array(counts.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([raw[i * width_bytes : (i + 1) * width_bytes] for i in range(n)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "key1", "key2", "signature"],
                )

    return run


def _matrix(column: pa.Array, dtype=np.uint64) -> np.ndarray:
    """Rows of equal length from a binary column."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(n, -1) if n else np.zeros((0, 1), dtype)


def _tokens(signature: np.ndarray) -> np.ndarray:
    return T.mix(signature, 7) ^ T.mix(np.arange(signature.shape[1], dtype=np.uint64), 8)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tokens = _tokens(_matrix(batch.column("signature")))
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), tokens.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.ravel().view(np.int64)), pa.array(rep)], ["token", "rep"])


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each row of a symmetric Boolean matrix with a true diagonal."""
    label = np.arange(len(linked))
    while True:
        new = np.array([label[row].min() for row in linked])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _merge_lists(matches: int):
    """Rows sorted by list: spanning pairs, within each list, of those with enough equal coordinates."""

    def pairs(reps: np.ndarray, signatures: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
        lengths = np.diff(cuts)
        short = lengths <= 48
        for n in np.unique(lengths[short & (lengths > 1)]):
            left, right = np.triu_indices(n, 1)
            at = cuts[:-1][lengths == n]
            step = max(1, 200_000 // len(left))
            for lo in range(0, len(at), step):
                a = (at[lo : lo + step, None] + left).ravel()
                b = (at[lo : lo + step, None] + right).ravel()
                good = (signatures[a] == signatures[b]).sum(axis=1) >= matches
                yield np.stack([reps[a[good]], reps[b[good]]], axis=1)
        for k in np.flatnonzero(~short):
            rows = slice(cuts[k], cuts[k + 1])
            part, ids = signatures[rows], reps[rows]
            hits = np.zeros((len(part), len(part)), dtype=np.uint8)
            for c in range(part.shape[1]):
                hits += part[:, c, None] == part[None, :, c]
            label = _labels((hits >= matches) | np.eye(len(part), dtype=bool))
            yield np.stack([ids[label], ids], axis=1)[label != np.arange(len(part))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, signature, cuts in T.whole_groups(batches, ["key", "cell"], ["rep", "body"]):
            signatures = _matrix(signature)
            rep = rep.to_numpy(zero_copy_only=False)
            for found in pairs(rep, signatures, cuts):
                if len(found):
                    found = np.unique(np.sort(found, axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in T.chunks(batch.column("text")):
                values, at = T.distinct_sorted(*T.shingles(*T.word_hashes(data, offsets), width))
                n = len(at) - 1
                raw = values.tobytes()
                sets = pa.array([raw[at[i] * 8 : at[i + 1] * 8] for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), sets], ["rep", "body"])

    return run


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked: 100 * intersection >= percent * union, for every pair."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    everywhere = int((count == n).sum())
    use = (count > 1) & (count < n)
    kept = use[column]
    row, column = row[kept], (np.cumsum(use) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.full((n, n), everywhere, dtype=np.float32)
    width = 4096
    for lo in range(0, int(use.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        shared += part @ part.T
    shared = shared.round().astype(np.int64)
    return 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, shingles, cuts in T.whole_groups(batches, ["key", "cell"], ["rep", "body"]):
            ids = rep.to_numpy(zero_copy_only=False)
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in shingles[lo:hi]]
                    label = _labels(_linked(sets, percent) | np.eye(hi - lo, dtype=bool))
                    moved = np.flatnonzero(label != np.arange(hi - lo))
                    found.append(np.stack([ids[lo:hi][label[moved]], ids[lo:hi][moved]], axis=1))
            if found:
                found = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, large: DataFrame, block: int, seed: int) -> DataFrame:
    """Give rows (key, rep) a cell: those of ``large`` (key, count) keys one of as many as it takes, all others the first."""
    own = F.pmod(F.xxhash64("rep", F.lit(seed)), F.ceil(F.col("count") * 2 / block))
    return rows.join(large, "key", "left").select("key", "rep", F.coalesce(own, F.lit(0)).cast("long").alias("cell"))


def _across(rows: DataFrame, block: int) -> DataFrame:
    """Give rows (key, rep, component) cells in which each meets all rows of its key that are of other components."""
    sizes = rows.groupBy("key", "component").count()
    sizes = sizes.groupBy("key").agg(F.max(F.struct("count", "component")).alias("big"), F.sum("count").alias("n")).filter("n > big.count")
    count = lambda n: F.ceil(n * 2 / block).cast("long")
    sizes = sizes.select("key", F.col("big.component").alias("big"), count(F.col("big.count")).alias("wide"), count(F.col("n") - F.col("big.count")).alias("high"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("component") == F.col("big"), F.col("wide")).otherwise(F.col("high"))))
    largest = "transform(sequence(0L, high - 1), j -> own * high + j)"
    others = "concat(transform(sequence(0L, wide - 1), i -> i * high + own), transform(sequence(0L, high - 1), j -> (wide + least(own, j)) * high + greatest(own, j)))"
    cells = F.when(F.col("component") == F.col("big"), F.expr(largest)).otherwise(F.expr(others))
    return rows.select("key", "rep", F.explode(cells).alias("cell"))


def linked_within(members: DataFrame, bodies, check, block: int) -> DataFrame:
    """(node, component) over the links that ``check`` finds between members (key, rep) of one key.

    ``bodies`` gives (rep, body) for a DataFrame of reps; ``check`` reads rows (rep, body) sorted by key
    and cell, and gives spanning links of each cell.
    """
    members = table(members.select("key", "rep").distinct())

    def links(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(bodies(dealt.select("rep")), "rep").select("key", "cell", "rep", "body")
        return table(rows.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(check, "a long, b long").distinct())

    def apart(found: DataFrame) -> DataFrame:
        """The members of large keys with their components, where these are several."""
        rows = members.join(large.select("key"), "key").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        rows = rows.select("key", "rep", F.coalesce("component", "rep").alias("component"))
        several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
        return table(rows.join(several, "key", "left_semi"))

    crowded = lambda rows: rows.groupBy("key").count().filter(F.col("count") > block)
    large = small(table(crowded(members)))
    met = links(_in_blocks(members, large, block, 0))
    found = connected(met)
    if large.isEmpty():
        return found
    rest, last, together = apart(found), None, False
    while not rest.isEmpty():
        heads = table(rest.select("key", F.col("component").alias("rep")).distinct())
        n = heads.count()
        if together or last is not None and 2 * n > last:
            return connected(met.union(links(_across(rest, block))))
        several = crowded(heads)
        last, together = n, several.isEmpty()
        met = table(met.union(links(_in_blocks(heads, several, block, n))))
        found = connected(met)
        rest = apart(found)
    return found


def match_threshold(percent: int, coordinates: int) -> int:
    p = percent / 100
    return max(1, int(coordinates * p - 5 * (coordinates * p * (1 - p)) ** 0.5))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``width`` words make a shingle; documents are linked when 100 * intersection >= ``percent`` *
    union of their sets. component_id is the smallest doc_id reachable over links, kept whether
    that is the document itself. A null text counts as empty; empty texts link with nothing, so
    each is its own component. Repeated rows are returned as often as they come, each with the same
    values. A row without doc_id takes the component of the equal sets it meets and is kept only if
    that is null too; rows of one doc_id with different texts are one node, linked with what any of
    them is linked with. ``matches`` is the match threshold, by default the one the module describes.
    An empty table gives none. Other columns of ``docs`` are not read.
    """
    matches = match_threshold(percent, coordinates) if matches is None else matches
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, key1 long, key2 long, signature binary"
    features = table(docs.mapInArrow(_features(width, coordinates), schema))
    filled = features.filter("n_shingles > 0")
    classes = table(filled.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    signed = classes.filter("rep is not null").select("rep", "signature")

    postings = signed.mapInArrow(_postings, "token long, rep long")
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("met"))
    first = coordinates - matches + 1
    prefix = shared.filter(F.size("met") >= matches).select("rep", F.explode(F.expr(f"slice(met.token, 1, {first - coordinates} + size(met))")).alias("token"))
    prefix = table(prefix)
    lists = prefix.join(prefix.groupBy("token").count().filter("count > 1").select("token"), "token").withColumnRenamed("token", "key")
    signatures = signed.withColumnRenamed("signature", "body")
    groups = linked_within(lists, lambda reps: signatures, _merge_lists(matches), BLOCK)
    groups = table(groups.select(F.col("component").alias("key"), F.col("node").alias("rep")))

    def sets(reps: DataFrame) -> DataFrame:
        wanted = small(table(reps.distinct()))
        found = docs.join(wanted, docs.doc_id == F.col("rep"), "left_semi").mapInArrow(_sets(width), "rep long, body binary")
        return found.dropDuplicates(["rep", "body"])

    linked = linked_within(groups, sets, _confirm(percent), SETS_BLOCK)

    named = classes.select("key1", "key2", "n_shingles", "rep").join(linked, F.col("rep") == F.col("node"), "left")
    named = named.select("key1", "key2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "key1", "key2").join(named, ["key1", "key2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] END) AS shingle FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x
), m AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
