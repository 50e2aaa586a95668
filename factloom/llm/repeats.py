"""Removal of repeated byte strings, by column-wise suffix sorting of the places where texts can agree.

The method asked for inserts one symbol of every document a round into one collection-wide
Burrows-Wheeler transform. Over whole texts that is a job for each byte of the longest document, and
an order over every byte of the corpus; neither fits the limits. What has to be found is bounded,
though: equal strings of ``LENGTH`` bytes. So the transform is built over short contexts instead:

1. Every string of ``LENGTH`` bytes names one anchor in it, the smallest hash of its ``ANCHOR``-byte
   substrings (the leftmost of equal ones). Equal strings name equal anchors at equal places. An
   anchor stands for a run of neighbouring starts, about 70, and its context is the bytes of these
   strings. Anchors met once are done: no string that names them repeats.
2. Occurrences of an anchor with equal contexts form a class; all strings of a class with two
   members repeat.
3. Contexts of anchors with several classes are aligned at the anchor and sorted column by column
   from the right: each round inserts one symbol of every context, stably sorts the order of the
   last round by it, and updates the common prefixes of neighbours. A string repeats where a
   neighbour shares ``LENGTH`` symbols from its column on. Columns, order and prefixes are
   sequential files; a round reads and writes each once.

Anchors of more than ``BLOCK`` classes are lengthened first: two contexts share a string only if half of
what it has beside the anchor agrees on the left, or the rest on the right. So each context goes to
the group of the anchor with these bytes on its left, and to that with those on its right, and so on
until no group is large (``_lengthened``); at the end of that an anchor is the whole string. The
fewer bytes are left open, the shorter is the stretch that a group's strings lie in. Contexts that agree
on all of it repeat there, and only one of them goes on (``_merged``).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import text as T
from factloom.llm.runtime import ship, small, table

LENGTH = 200
ANCHOR = 64
#: Classes up to which the contexts of an anchor are sorted in one task, and contexts sorted together.
BLOCK, SORTED = 2000, 20_000
PLACE = ("at", "first", "last", "n", "stop")


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = T.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return total, down


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray]:
    """Anchors of whole texts: row, place, first and last start, and hashes of anchor and context.

    Neighbours with equal anchor and context, as in text that repeats a few bytes over and over, are
    one entry: n counts them, stop is the last start of the last one.
    """
    span = length - anchor + 1
    none = {k: np.zeros(0, np.int64) for k in ("row", "at", "first", "last", "anchor", "context", "n", "stop")}
    if len(data) < length:
        return none
    total, down = _prefix_hash(data)
    hashes = T.mix((total[anchor:] - total[:-anchor]) * down[: len(data) - anchor + 1], 11)
    bits = np.uint64(max(22, int(len(data)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    starts = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    if not len(starts):
        return none
    at = (best[starts] & low).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    at = at[begin]
    row = np.searchsorted(offsets, first, side="right") - 1
    context = T.mix((total[last + length] - total[first]) * down[first], 12)
    context = T.mix(context ^ T.mix(((at - first) << 16 | (last - first)).astype(np.uint64), 13), 14)
    anchors = hashes[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (context[1:] != context[:-1]) | (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
    kept = np.flatnonzero(fresh)
    n = np.diff(np.append(kept, len(at)))
    stop = last[kept + n - 1]
    row, at, first, last = row[kept], at[kept], first[kept], last[kept]
    base = offsets[row]
    hashed = {"anchor": anchors[kept].view(np.int64), "context": context[kept].view(np.int64)}
    return {"row": row, "at": at - base, "first": first - base, "last": last - base, "n": n, "stop": stop - base} | hashed


def _occurrences(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for row, data, offsets in T.chunks(batch.column("text")):
                found = _anchored(data, offsets, length, anchor)
                columns = [pa.array(found[k]) for k in ("anchor", "context")] + [pa.array(uid[row + found["row"]])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[k].astype(np.int32)) for k in PLACE)], ["anchor", "context", "uid", *PLACE])

    return run


def _contexts(length: int):
    """Cut the wanted contexts out of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (uid, text, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "wanted")), strict=True)):
                raw = text.encode()
                out = {
                    "anchor": pa.array([w["anchor"] for w in wanted], pa.int64()),
                    "single": pa.array([w["n"] == 1 for w in wanted], pa.bool_()),
                    "uid": pa.array([uid] * len(wanted), pa.int64()),
                    "first": pa.array([w["first"] for w in wanted], pa.int32()),
                    "shift": pa.array([w["first"] - w["at"] for w in wanted], pa.int32()),
                    "context": pa.array([raw[w["first"] : w["last"] + length] for w in wanted], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return run


def sort_columns(contexts: list[bytes], shift: np.ndarray, length: int, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """Aligned contexts sorted from the right: for every column, which contexts share ``length`` symbols from it on with another.

    ``shift`` is the column of each context's first symbol. Order and common prefixes of the last
    round are read from a file, and those of the new one written to the next.
    """
    n = len(contexts)
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as one, tempfile.TemporaryFile() as two:
        grid = np.full((n, columns), 256, dtype=np.uint16)
        for row, (context, column) in enumerate(zip(contexts, shift, strict=True)):
            grid[row, column : column + len(context)] = np.frombuffer(context, dtype=np.uint8)
        for column in range(columns - 1, -1, -1):
            np.ascontiguousarray(grid[:, column]).tofile(symbols)
        del grid
        symbols.seek(0)
        np.arange(n, dtype=np.int32).tofile(one)
        np.zeros(n, dtype=np.int32).tofile(one)
        for column in range(columns - 1, -1, -1):
            one.seek(0)
            order = np.fromfile(one, dtype=np.int32, count=n)
            prefix = np.fromfile(one, dtype=np.int32, count=n)  # with the context before it in the order
            symbol = np.fromfile(symbols, dtype=np.uint16, count=n)[order]
            to = np.argsort(symbol, kind="stable")
            same = np.zeros(n, dtype=bool)
            same[1:] = (symbol[to[1:]] == symbol[to[:-1]]) & (symbol[to[1:]] < 256)
            new = np.zeros(n, dtype=np.int32)
            here = np.flatnonzero(same)
            if len(here):
                # The least prefix between two contexts that were apart in the last order.
                edges = np.stack([to[here - 1] + 1, to[here] + 1], axis=1).ravel()
                new[here] = 1 + np.minimum.reduceat(np.append(prefix, 0), edges)[::2]
            order = order[to]
            two.seek(0)
            order.tofile(two)
            new.tofile(two)
            one, two = two, one
            long = new >= length
            long[:-1] |= new[1:] >= length
            yield column, order[long]


def _repeated(length: int, anchor: int):
    span = length - anchor
    columns = 2 * span + anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> Iterator[pa.RecordBatch]:
            single, uid, first, shift, context = (np.concatenate([h[k] for h in held]) for k in range(5))
            held.clear()
            # Lengthened anchors may bring a context more than once; it is no repeat of itself. One that has strings open goes first.
            order = np.argsort(~single.astype(bool), kind="stable")
            once = order[np.unique(np.stack([uid, first, shift])[:, order], axis=1, return_index=True)[1]]
            single, uid, first, shift, context = (x[once] for x in (single, uid, first, shift, context))
            marks = np.zeros((len(uid), span + 1), dtype=bool)
            for column, which in sort_columns(list(context), shift + span, length, columns):
                if column <= span:
                    marks[which, column] = True
            marks &= single[:, None]
            edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            base = first[row] - (shift[row] + span)
            yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(base + begin), pa.array(base + end - 1 + length)], ["uid", "from", "to"])

        for single, uid, first, shift, context, _ in T.whole_groups(batches, ["anchor"], ["single", "uid", "first", "shift", "context"]):
            texts = np.empty(len(context), dtype=object)
            texts[:] = context.to_pylist()
            numbers = [c.to_numpy(zero_copy_only=False) for c in (single, uid, first, shift)]
            held.append((numbers[0], numbers[1], numbers[2].astype(np.int64), numbers[3].astype(np.int64), texts))
            if sum(len(h[0]) for h in held) >= SORTED:
                yield from solve()
        if held:
            yield from solve()

    return run


def _merged(groups: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """Groups with one of all contexts that agree where the strings of the group lie, and (uid, from, to) of that place in all of these."""
    before, after = -F.col("shift"), -F.col("shift") + anchor
    begin = F.greatest(before - (length - anchor - F.col("right")), F.lit(0)).cast("int")
    end = F.least(after + (length - anchor - F.col("left")), F.octet_length("context")).cast("int")
    groups = groups.withColumns({"begin": begin, "end": end}).filter(F.col("end") - F.col("begin") >= length)
    stretch = F.xxhash64(before - F.col("begin"), F.expr("substring(context, begin + 1, end - begin)"))
    groups = table(groups.withColumn("stretch", stretch))
    alike = groups.groupBy("anchor", "stretch").agg(F.count("*").alias("members"), F.min(F.struct("uid", "first", "shift")).alias("one"))
    alike = small(table(alike.filter("members > 1").select("anchor", "stretch", "one")))
    met = table(groups.join(alike, ["anchor", "stretch"]))
    place = [(F.col("first") + F.col(c)).cast("long").alias(name) for c, name in (("begin", "from"), ("end", "to"))]
    shared = met.filter("single").select("uid", *place)
    ones = met.filter(F.struct("uid", "first", "shift") == F.col("one")).withColumn("single", F.lit(False)).drop("one")
    rest = groups.join(alike, ["anchor", "stretch"], "left_anti").unionByName(ones)
    return rest.drop("begin", "end", "stretch"), shared


def _lengthened(contexts: DataFrame, length: int, anchor: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Contexts in groups (``anchor``) of at most ``block``, and (uid, from, to) of repeated strings of contexts that were merged.

    ``left`` and ``right`` are the bytes beside the anchor that all of a group have; of the others that a
    string needs, half (rounded up) have to agree further left or the rest further right. Contexts
    that end before these bytes have no such string. Rounds are the logarithm of ``length``.
    """
    span = length - anchor
    groups, ready, shared = contexts.withColumns({"left": F.lit(0), "right": F.lit(0)}), [], []
    while True:
        large = groups.groupBy("anchor").count().filter(F.col("count") > block).select("anchor")
        large = table(large)
        ready.append(groups.join(small(large), "anchor", "left_anti"))
        if large.isEmpty():
            break
        over = table(groups.join(small(large), "anchor", "left_semi"))
        over = over.filter(F.col("left") + F.col("right") < span).withColumn("open", span - F.col("left") - F.col("right"))
        more_left, more_right = F.ceil(F.col("open") / 2).cast("int"), F.floor(F.col("open") / 2).cast("int") + 1
        to_left = over.withColumn("more", more_left).filter(-F.col("shift") >= F.col("left") + F.col("more"))
        to_left = to_left.withColumns({"anchor": F.xxhash64("anchor", F.lit("left"), F.expr("substring(context, 1 - shift - left - more, more)")), "left": F.col("left") + F.col("more")})
        to_right = over.withColumn("more", more_right).filter(F.octet_length("context") + F.col("shift") - anchor >= F.col("right") + F.col("more"))
        to_right = to_right.withColumns({"anchor": F.xxhash64("anchor", F.lit("right"), F.expr(f"substring(context, 1 - shift + {anchor} + right, more)")), "right": F.col("right") + F.col("more")})
        groups, found = _merged(to_left.unionByName(to_right).drop("open", "more"), length, anchor)
        groups = table(groups)
        shared.append(found)
    none = contexts.filter(F.lit(False)).select("uid", F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to"))
    return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, shared, none)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of texts without the given ranges."""
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw = text.encode()
            end, removed, spans, kept = 0, 0, 0, []
            for r in sorted((r["from"], r["to"]) for r in ranges or ()):
                if not spans or r[0] > end:
                    kept.append(raw[end : r[0]])
                    spans += 1
                    removed += r[1] - r[0]
                    end = r[1]
                elif r[1] > end:
                    removed += r[1] - end
                    end = r[1]
            kept.append(raw[end:])
            rows.append((len(raw), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """(uid, from, to): byte ranges, which may overlap, that cover all repeated strings of ``docs`` (uid, text)."""
    found = f"anchor long, context long, uid long, {', '.join(f'{c} int' for c in PLACE)}"
    occurrences = table(docs.mapInArrow(_occurrences(length, anchor), found))
    met = occurrences.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    met = met.filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike"))
    repeated = table(occurrences.join(met, "anchor"))
    mixed = repeated.filter("not alike")
    classes = mixed.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(F.struct("uid", "at", "first", "last")).alias("one"))
    classes = table(classes)
    copied = mixed.join(classes.filter("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    copied = repeated.filter("alike").select("uid", "first", "stop").unionByName(copied.select("uid", "first", "stop"))
    ranges = copied.select("uid", F.col("first").cast("long").alias("from"), (F.col("stop") + length).cast("long").alias("to"))

    open_anchors = classes.groupBy("anchor").agg(F.min("n").alias("least")).filter("least = 1")
    wanted = classes.join(open_anchors, "anchor").select("anchor", "n", "one.*")
    wanted = wanted.groupBy("uid").agg(F.collect_list(F.struct("anchor", "n", "at", "first", "last")).alias("wanted"))
    wanted = table(wanted)
    texts = docs.join(small(wanted.select("uid")), "uid", "left_semi").dropDuplicates(["uid"])
    schema = "anchor long, single boolean, uid long, first int, shift int, context binary"
    contexts = texts.join(wanted, "uid").select("uid", "text", "wanted").mapInArrow(_contexts(length), schema)
    contexts = table(contexts)
    grouped, shared = _lengthened(contexts, length, anchor, block)
    grouped = grouped.repartition("anchor").sortWithinPartitions("anchor")
    partly = grouped.mapInArrow(_repeated(length, anchor), "uid long, from long, to long")
    return ranges.unionByName(partly).unionByName(shared)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in
    the same text or another; strings end with their text and are judged on the input. n_spans
    counts maximal removed runs; kept_sha256 is that of the bytes that stay. Null text is empty. Rows
    that repeat are copies of one another, so all their strings repeat. Other columns are not read.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("uid"))
    ranges = repeated_ranges(docs.select("uid", "text"), length, anchor, block)
    ranges = table(ranges.groupBy("uid").agg(F.collect_set(F.struct("from", "to")).alias("ranges")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = small(ranges.select("uid"))
    whole = docs.join(touched, "uid", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
    cut = docs.join(touched, "uid", "left_semi").join(ranges, "uid").select("doc_id", "text", "ranges").mapInArrow(_cut, schema)
    return whole.unionByName(cut)
