"""Katz backoff language model, trained and applied in exchanges of packed messages.

Training documents give the counts c of runs of up to ``ORDER`` words. ``END`` closes each text and
is also what its first word follows. Counts up to ``CUT`` are discounted after Good and Turing, in
each order by its own counts of counts:

    P(w | h) = d(c) c(h w) / c(h)          if h w was seen
             = alpha(h) P(w | h')          if only h was; h' is h without its first word
             = P(w | h')                   else

Below single words all unseen ones are one class, of which P is what the discounts left. alpha(h)
makes P(. | h) sum to one exactly; it takes the sum of P(w | h') over all w seen after h.

Tokens do not travel one by one. Documents are packed into blocks, and for each order a block sends
its distinct runs of words once, with their training counts, to the buckets of its 2**``BITS`` cells. A
bucket adds up the counts of equal runs, stores its part of the table of that order, numbers the runs,
and answers each message with an array of the same order; for contexts after which the block meets an
unseen word it adds what alpha is made of. With the answers of all orders a block scores its tokens
by itself. Runs go to the bucket of their context; those of contexts with over 1 / ``HOT`` of all
tokens are spread by their last word, and the sums of these contexts, ``HOT`` at most, added up after.

A block sends as many messages whatever the size of the corpus. Beyond 2**``BITS`` blocks the buckets
are the leaves of a tree: each of its nodes merges the messages of about 2**``BITS`` senders to one,
deals that out to cells by the next digit, and hands the answers back the same way. So rows grow
with the number of blocks, and no task holds more than a block's share of runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import text as T
from factloom.llm.runtime import bucketed, id_text, ship, table

FOLDS, HELD_OUT = 7, 2
ORDER = 2
BLOCK_BYTES = 4 << 20
CUT = 5
HOT = 4096
BITS = 8
END = np.uint64(0x3C2F733E3C2F733E)
ASKED, SPREAD = 1, 2


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers in one compressed piece, their bytes by significance."""
    head, body = [len(arrays)], []
    for values in arrays:
        size = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
        head += [size, len(values)]
        planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        body.append(np.ascontiguousarray(planes.T).tobytes())
    return np.array(head, dtype="<u4").tobytes() + zstandard.compress(b"".join(body), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw[4 : 4 + 8 * n], dtype="<u4").reshape(-1, 2)
    body = np.frombuffer(zstandard.decompress(raw[4 + 8 * n :]), dtype=np.uint8)
    out, at = [], 0
    for size, length in head.tolist():
        values = np.zeros((length, 8), dtype=np.uint8)
        values[:, :size] = body[at : at + size * length].reshape(size, length).T
        out.append(values.view("<i8").ravel())
        at += size * length
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..CUT) from the numbers n[r] of types with count r, r up to CUT + 1; d(r) = 1 beyond.

    Where counts of counts are too few for a discount between 0 and 1, half a count is taken off.
    """
    out = np.ones(CUT + 1)
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > CUT, c, d[np.minimum(c, CUT)] * c)


def weights(c: np.ndarray, few: np.ndarray, below: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and alpha of contexts with count c, few[:, r - 1] followers of count r, and P-sum ``below`` of all followers.

    A context whose discounts leave nothing gets one count more, for what was not seen after it.
    """
    left = (few * ((1 - d[1:]) * np.arange(1, CUT + 1))).sum(axis=1)
    more = (few.sum(axis=1) == 0).astype(float)
    return c + more, (left + more) / (c + more) / (1 - below)


@dataclass(frozen=True)
class Level:
    """What every task knows of an order: discounts, sums, and the contexts that several buckets hold."""

    d: np.ndarray
    total: int
    types: int
    spread: dict[int, tuple[np.ndarray, float]]


@dataclass
class Grams:
    """Distinct contexts, ascending, and the distinct words after each: a message, or the merged messages of a node."""

    ctx: np.ndarray
    flags: np.ndarray
    den: np.ndarray  # of P(. | the context without its first word)
    n: np.ndarray  # words after each context
    word: np.ndarray
    low: np.ndarray  # count of the run without its first word
    count: np.ndarray

    def pack(self) -> bytes:
        return pack(np.diff(self.ctx, prepend=0), self.flags, self.den, self.n, self.word, self.low, self.count)

    @classmethod
    def of(cls, raw: bytes) -> Grams:
        step, *rest = unpack(raw)
        return cls(np.cumsum(step), *rest)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ctx)), self.n)


@dataclass
class Answer:
    """Counts and numbers of a message's runs; contexts without a small count; few and below of those in need of alpha."""

    count: np.ndarray
    number: np.ndarray
    full: np.ndarray
    few: np.ndarray
    below: np.ndarray

    @classmethod
    def none(cls, grams: int, contexts: int) -> Answer:
        return cls(np.zeros(grams, np.int64), np.zeros(grams, np.int64), np.zeros(contexts, np.int64), np.zeros((contexts, CUT), np.int64), np.zeros(contexts))

    def pack(self, need: np.ndarray) -> bytes:
        """``need`` marks the contexts of which few and below are given."""
        step = np.diff(self.number, prepend=0)
        up = not len(step) or step.min() >= 0
        raw = pack(np.array([up]), self.count, step if up else self.number, self.full, self.few[need].T.ravel())
        return len(raw).to_bytes(4, "little") + raw + self.below[need].tobytes()

    @classmethod
    def of(cls, raw: bytes, asked: np.ndarray, n: np.ndarray) -> Answer:
        """From what ``pack`` gave for a message of ``n`` words after each context, of which ``asked`` are in need anyway."""
        stop = 4 + int.from_bytes(raw[:4], "little")
        up, count, number, full, few = unpack(raw[4:stop])
        need = needed(count, asked, n)
        out = cls(count, np.cumsum(number) if up[0] else number, full, np.zeros((len(n), CUT), np.int64), np.zeros(len(n)))
        out.few[need], out.below[need] = few.reshape(CUT, -1).T, np.frombuffer(raw[stop:])
        return out


def needed(count: np.ndarray, flags: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which contexts have unseen runs, in the message or (ASKED) beside it; SPREAD ones are known to all."""
    unseen = np.bincount(np.repeat(np.arange(len(n)), n)[count == 0], minlength=len(n)) > 0
    return (unseen | (flags & ASKED > 0)) & (flags & SPREAD == 0)


def combine(parts: list[Grams]) -> tuple[Grams, list[np.ndarray], list[np.ndarray]]:
    """The parts as one, counts added up, and where each part's runs and contexts are in it."""
    joined = {k: np.concatenate([getattr(p, k) for p in parts]) for k in ("ctx", "flags", "den", "n", "word", "low", "count")}
    ctx, at = np.unique(joined["ctx"], return_inverse=True)
    flags = sum(bit * (np.bincount(at[joined["flags"] & bit > 0], minlength=len(ctx)) > 0) for bit in (ASKED, SPREAD))
    den = np.zeros(len(ctx), np.int64)
    np.maximum.at(den, at, joined["den"])
    owner, word = np.repeat(at, joined["n"]), joined["word"]
    bits = int(word.max()).bit_length() if len(word) else 0
    if bits + len(ctx).bit_length() > 62:
        word = np.unique(word, return_inverse=True)[1]
        bits = len(word).bit_length()
    _, first, place = np.unique(owner << bits | word, return_index=True, return_inverse=True)
    count = np.bincount(place, weights=joined["count"], minlength=len(first)).astype(np.int64)
    whole = Grams(ctx, flags, den, np.bincount(owner[first], minlength=len(ctx)), joined["word"][first], joined["low"][first], count)
    ends, ctx_ends = np.cumsum([len(p.word) for p in parts])[:-1], np.cumsum([len(p.ctx) for p in parts])[:-1]
    return whole, np.split(place, ends), np.split(at, ctx_ends)


def deal(whole: Grams, depth: int, bits: int) -> Iterator[tuple[int, Grams, np.ndarray, np.ndarray]]:
    """(cell, its part of ``whole``, places of its runs, places of its contexts), by the digit of ``depth``."""
    digit = lambda x: (x >> bits * depth) & ((1 << bits) - 1)
    spread, own, owner = whole.flags & SPREAD > 0, digit(whole.ctx), whole.owner
    cell = np.where(spread[owner], digit(whole.word), own[owner]).astype(np.uint16)
    grams = np.argsort(cell, kind="stable")
    alone = np.flatnonzero((whole.n == 0) & ~spread)
    alone = alone[np.argsort(own[alone].astype(np.uint16), kind="stable")]
    edges = np.arange((1 << bits) + 1)
    cuts, alone_cuts = np.searchsorted(cell[grams], edges), np.searchsorted(own[alone], edges)
    for k in np.flatnonzero(np.diff(cuts) + np.diff(alone_cuts)).tolist():
        mine = grams[cuts[k] : cuts[k + 1]]
        ctx = np.union1d(owner[mine], alone[alone_cuts[k] : alone_cuts[k + 1]])
        n = np.diff(np.append(np.searchsorted(owner[mine], ctx), len(mine)))
        yield k, Grams(whole.ctx[ctx], whole.flags[ctx], whole.den[ctx], n, whole.word[mine], whole.low[mine], whole.count[mine]), mine, ctx


def gather(whole: Grams, depth: int, bits: int, answers: dict[int, bytes]) -> Answer:
    """The answer to ``whole`` from those to the parts that ``deal`` made of it."""
    out = Answer.none(len(whole.word), len(whole.ctx))
    for k, part, mine, ctx in deal(whole, depth, bits):
        a = Answer.of(answers[k], part.flags, part.n)
        out.count[mine], out.number[mine], out.full[ctx], out.few[ctx], out.below[ctx] = a.count, a.number, a.full, a.few, a.below
    return out


def _rows(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))


_ASK = {"node": pa.int64(), "path": pa.int64(), "body": pa.binary()}
_ASK_SQL = "node long, path long, body binary"
_FOUND = {"kind": pa.string(), "node": pa.int64(), "path": pa.int64(), "body": pa.binary(), "stats": pa.list_(pa.float64())}
_FOUND_SQL = "kind string, node long, path long, body binary, stats array<double>"


def _asks(node: int, path: int, whole: Grams, depth: int, bits: int) -> pa.RecordBatch:
    found = [(path | k << bits * depth, part.pack()) for k, part, _, _ in deal(whole, depth, bits)]
    return _rows({"node": [node] * len(found), "path": [x[0] for x in found], "body": [x[1] for x in found]}, _ASK)


def _leaves(order: int, d: np.ndarray, bits: int):
    """Add up each bucket's runs: a table row, its sums, those of its SPREAD contexts, and an answer to every message."""

    def bucket(path: int, nodes: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        parts = [Grams.of(x) for x in bodies]
        whole, place, ctx_place = combine(parts)
        count, owner = whole.count, whole.owner
        seen, small = count > 0, (count > 0) & (count <= CUT)
        few = np.bincount(owner[small] * CUT + count[small] - 1, minlength=len(whole.ctx) * CUT).reshape(-1, CUT)
        below = np.bincount(owner[seen], weights=discounted(whole.low[seen], d) / whole.den[owner[seen]], minlength=len(whole.ctx))
        number = np.arange(len(count))
        if order == 1:  # frequent words get the small numbers, of which the messages of later orders are full
            number[np.argsort(-count, kind="stable")] = np.arange(len(count))
        answer = Answer(count, number << bits | path, (few.sum(axis=1) == 0).astype(np.int64), few, below)
        of_counts = np.bincount(count[count <= CUT + 1], minlength=CUT + 2)
        out = [
            ("table", -1, pack(np.diff(whole.ctx, prepend=0), np.bincount(owner[seen], minlength=len(whole.ctx)), whole.word[seen], count[seen]), None),
            ("sums", -1, None, [float(x) for x in (seen.sum(), count.sum(), *of_counts)]),
        ]
        out += [("spread", int(whole.ctx[c]), None, [*few[c].astype(float), below[c]]) for c in np.flatnonzero(whole.flags & SPREAD > 0)]
        for node, part, mine, ctx in zip(nodes, parts, place, ctx_place, strict=True):
            a = Answer(answer.count[mine], answer.number[mine], answer.full[ctx], answer.few[ctx], answer.below[ctx])
            out.append(("answer", node, a.pack(needed(a.count, part.flags, part.n)), None))
        kind, node, body, stats = zip(*out, strict=True)
        return _rows({"kind": kind, "node": node, "path": [path] * len(out), "body": body, "stats": stats}, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, path, body, cuts in T.whole_groups(batches, ["path"], ["node", "path", "body"]):
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield bucket(path[lo].as_py(), node[lo:hi].to_pylist(), body[lo:hi].to_pylist())

    return run


def _merged(depth: int, bits: int):
    """Merge the messages to each node of the tree (path, up) and deal them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for up, path, body, cuts in T.whole_groups(batches, ["path", "up"], ["up", "path", "body"]):
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                whole = combine([Grams.of(x.as_py()) for x in body[lo:hi]])[0]
                yield _asks(up[lo].as_py(), path[lo].as_py(), whole, depth, bits)

    return run


def _returned(depth: int, bits: int):
    """For each node of the tree, its messages and the answers to what it dealt on: the answers to the messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, path, cell, body, cuts in T.whole_groups(batches, ["path", "up"], ["node", "path", "cell", "body"]):
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = list(zip(*(x[lo:hi].to_pylist() for x in (node, cell, body)), strict=True))
                asked = [(n, Grams.of(b)) for n, c, b in rows if c < 0]
                whole, place, ctx_place = combine([g for _, g in asked])
                got = gather(whole, depth, bits, {c: b for _, c, b in rows if c >= 0})
                out = []
                for (n, part), mine, ctx in zip(asked, place, ctx_place, strict=True):
                    a = Answer(got.count[mine], got.number[mine], got.full[ctx], got.few[ctx], got.below[ctx])
                    out.append((n, a.pack(needed(a.count, part.flags, part.n))))
                yield _rows({"node": [x[0] for x in out], "path": [path[lo].as_py()] * len(out), "body": [x[1] for x in out]}, _ASK)

    return run


def _exchange(asks: DataFrame, leaves, senders: int, depth: int, deep: int, bits: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Answers (node, path, body) to messages of the same columns, and the other rows that the buckets give."""
    if depth == deep - 1:
        found = table(asks.repartition(parts, "path").sortWithinPartitions("path").mapInArrow(leaves, _FOUND_SQL), partition_by="kind")
        return found.filter("kind = 'answer'").select("node", "path", "body"), found.filter("kind <> 'answer'")
    nodes = -(-senders // (1 << bits))
    asks = table(asks.withColumn("up", F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(nodes)).cast("long")))
    up = asks.repartition(parts, "path", "up").sortWithinPartitions("path", "up", "node").mapInArrow(_merged(depth + 1, bits), _ASK_SQL)
    answers, found = _exchange(up, leaves, nodes, depth + 1, deep, bits, parts)
    shift = bits * (depth + 1)
    answers = answers.select(F.lit(-1).cast("long").alias("node"), F.expr(f"path & {(1 << shift) - 1}").alias("path"), F.shiftright("path", shift).alias("cell"), "body", F.col("node").alias("up"))
    both = asks.select("node", "path", F.lit(-1).cast("long").alias("cell"), "body", "up").unionByName(answers)
    both = both.repartition(parts, "path", "up").sortWithinPartitions("path", "up", "cell", "node")
    return table(both.mapInArrow(_returned(depth + 1, bits), _ASK_SQL)), found


def _blocks(limit: int):
    """Pack documents into blocks: tokens as places in the sorted list of the block's distinct words."""

    def packed(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, out, sizes, tokens = (np.concatenate([h[k] for h in held]) if k else sum((h[0] for h in held), []) for k in range(4))
        words, place = np.unique(tokens, return_inverse=True)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(TaskContext.get().partitionId() << 24) + number], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "held": pa.array([out.tolist()], pa.list_(pa.bool_())),
                "tokens": pa.array([pack(sizes, place)], pa.binary()),
                "words": pa.array([words.tobytes()], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for row, data, offsets in T.chunks(batch.column("text")):
                n = len(offsets) - 1
                hashes, at = T.word_hashes(data, offsets)
                # 63 bits, so that they are numbers like all others
                tokens = (np.insert(hashes, at[1:], END) >> np.uint64(1)).astype(np.int64)
                held.append((batch.column("doc_id").slice(row, n).to_pylist(), out[row : row + n], np.diff(at) + 1, tokens))
                size += len(data)
                if size >= limit:
                    yield packed(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield packed(number, held)

    return run


_BLOCK_SQL = "block long, doc_ids array<long>, held array<boolean>, tokens binary, words binary"


@dataclass
class Runs:
    """The distinct runs of one order in a block, by place: context and rest (without last and first word), last word; and what is known."""

    at: np.ndarray  # run that ends at each token, -1 where the text is too short for one
    ctx: np.ndarray
    rest: np.ndarray
    last: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    over: np.ndarray = field(default_factory=lambda: np.zeros(0))  # denominator and alpha of each context
    alpha: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Block:
    """A block's tokens, its runs of each order, and the answers got so far."""

    def __init__(self, row: dict, order: int, levels: list[Level], hot: int):
        self.hot, self.levels, self.asked = hot, levels, {}
        self.sizes, tokens = unpack(row["tokens"])
        self.words = np.frombuffer(row["words"], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)
        n = len(self.words)
        zero = np.zeros(n, np.int64)
        self.runs = [Runs(tokens, zero, zero, np.arange(n))]
        opens = np.zeros(len(tokens), dtype=bool)
        opens[self.begin] = True
        for k in range(2, order + 1):
            below = self.runs[-1].at
            before = np.roll(below, 1)
            before[opens] = tokens[-1] if k == 2 else -1  # END, which closes every text
            inside = np.flatnonzero(before >= 0)
            key, first, place = np.unique(before[inside] * n + tokens[inside], return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1)
            at[inside] = place
            self.runs.append(Runs(at, key // n, below[inside[first]], key % n))

    def context_count(self, k: int) -> np.ndarray:
        """Training count of every context of order k: of all tokens, or of the runs of order k - 1."""
        return np.array([self.levels[0].total if self.levels else 0]) if k == 1 else self.runs[k - 2].count

    def ask(self, k: int) -> tuple[Grams, np.ndarray, np.ndarray]:
        """The message of order k, and which runs and contexts it is about."""
        if k not in self.asked:
            self.asked = {k: self._ask(k)}
        return self.asked[k]

    def _ask(self, k: int) -> tuple[Grams, np.ndarray, np.ndarray]:
        own = self.runs[k - 1]
        taught = own.at[self.learn]
        count = np.bincount(taught[taught >= 0], minlength=len(own.ctx))
        one = np.ones(1, np.int64)
        if k == 1:
            return Grams(np.zeros(1, np.int64), one * SPREAD, one, one * len(count), self.words, np.zeros_like(count), count), np.arange(len(count)), np.zeros(1, np.int64)
        lower = self.runs[k - 2]
        known = lower.count > 0
        sent = known[own.ctx] & known[own.rest]
        hot = lower.count > self.limit
        asked = np.zeros(len(known), dtype=bool)
        asked[own.ctx[~sent]] = True
        asked &= known & ~hot
        mine = np.flatnonzero(sent)
        mine = mine[np.lexsort((self.runs[0].number[own.last[mine]], lower.number[own.ctx[mine]]))]
        there = asked.copy()
        there[own.ctx[mine]] = True
        ctx = np.flatnonzero(there)
        ctx = ctx[np.argsort(lower.number[ctx], kind="stable")]
        place = np.full(len(known), -1)
        place[ctx] = np.arange(len(ctx))
        den = np.zeros(len(ctx), np.int64)
        den[place[own.ctx[mine]]] = lower.over[lower.ctx[own.rest[mine]]]
        flags = ASKED * asked[ctx] + SPREAD * hot[ctx]
        n = np.bincount(place[own.ctx[mine]], minlength=len(ctx))
        return Grams(lower.number[ctx], flags, den, n, self.runs[0].number[own.last[mine]], lower.count[own.rest[mine]], count[mine]), mine, ctx

    @property
    def limit(self) -> float:
        return max(self.levels[0].total / self.hot, 1000)

    def hear(self, k: int, answers: list[dict], bits: int) -> bytes:
        """Take in the answers to the message of order k; returns them as one piece for ``recall``."""
        whole, mine, ctx = self.ask(k)
        got = gather(whole, 0, bits, {x["path"] & ((1 << bits) - 1): x["body"] for x in answers or ()})
        need = needed(got.count, whole.flags, whole.n)
        return got.pack(need)

    def recall(self, k: int, raw: bytes) -> None:
        whole, mine, ctx = self.ask(k)
        got = Answer.of(raw, whole.flags, whole.n)
        own, level, counts = self.runs[k - 1], self.levels[k - 1], self.context_count(k)
        own.count, own.number = np.zeros(len(own.ctx), np.int64), np.zeros(len(own.ctx), np.int64)
        own.count[mine], own.number[mine] = got.count, got.number
        few, below = np.zeros((len(counts), CUT), np.int64), np.zeros(len(counts))
        few[ctx], below[ctx] = got.few, got.below
        full = np.zeros(len(counts), np.int64)
        full[ctx] = got.full
        names = np.zeros(1, np.int64) if k == 1 else self.runs[k - 2].number
        for i in [0] if k == 1 else np.flatnonzero(counts > self.limit):
            few[i], below[i] = level.spread.get(int(names[i]), (0, 0.0))
            full[i] = few[i].sum() == 0
        over, own.alpha = weights(np.maximum(counts, 0 if k == 1 else 1), few, below, level.d)
        own.over = counts + full if k > 1 else over

    def p(self, k: int) -> np.ndarray:
        """P of the last word of every run of order k after the others."""
        if k == 0:
            return np.ones(len(self.words))
        own, counts = self.runs[k - 1], self.context_count(k)
        lower = self.p(k - 1)[own.rest]
        backed = np.where((counts > 0)[own.ctx] | (k == 1), own.alpha[own.ctx], 1.0) * lower
        return np.where(own.count > 0, discounted(own.count, self.levels[k - 1].d) / np.maximum(own.over[own.ctx], 1), backed)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _recalled(row: dict, order: int, levels: list[Level], hot: int) -> Block:
    block = Block(row, order, levels, hot)
    for k in range(1, len(levels) + 1):
        if f"known{k}" in row:
            block.recall(k, row[f"known{k}"])
    return block


def _first_asks(k: int, levels: list[Level], hot: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _asks(row["block"], 0, _recalled(row, k, levels, hot).ask(k)[0], 0, bits)

    return run


def _heard(k: int, levels: list[Level], hot: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            known = _recalled(row, k, levels[: k - 1], hot).hear(k, row["answers"], bits)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([known], pa.binary())], ["block", f"known{k}"])

    return run


def _scores(order: int, levels: list[Level], hot: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = _recalled(row, order, levels, hot)
            block.recall(order, block.hear(order, row["answers"], bits))
            best = np.zeros(len(block.learn))
            for k, own in enumerate(block.runs, 1):
                inside = own.at >= 0
                best[inside] = np.log10(block.p(k))[own.at[inside]]
            c, first = block.runs[0].count[block.runs[0].at], levels[0]
            base = np.log10((c + 1) / (first.total + first.types + 1))
            sums = [np.add.reduceat(x, block.begin) for x in (base, best, (c > 0).astype(np.int64))]
            total = np.full(len(block.begin), first.total, dtype=np.int64)
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *map(pa.array, (block.sizes, sums[2], total, sums[0], sums[1]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _level(found: DataFrame) -> Level:
    """The sums over all buckets, in one row, and those of the contexts they share, at most ``HOT``."""
    size = 2 + CUT + 2
    sums = found.filter("kind = 'sums'").agg(*[F.sum(F.col("stats")[i]) for i in range(size)]).head()
    types, total, *n = [x or 0.0 for x in sums]
    shared = found.filter("kind = 'spread'").groupBy("node").agg(*[F.sum(F.col("stats")[i]) for i in range(CUT + 1)])
    spread = {r[0]: (np.array([int(x) for x in r[1:-1]]), r[-1]) for r in shared.collect()}
    return Level(discounts(np.array(n)), int(total), int(types), spread)


def score_documents(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, hot: int = HOT, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), scored by a model of the rows whose crc32(doc_id) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (single words, one added to
    each count) and score (the module's model of ``order`` words), both log10 probabilities of the
    whole text and its end. Null text is empty: its only token is the end. A null doc_id counts as
    empty text. Rows that repeat are counted and returned as often as they come. Without any training
    document every token is unseen and the score is 0, the logarithm of its certain class. Other
    columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.crc32(id_text()) % FOLDS == HELD_OUT).alias("held_out"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = bucketed(rows.mapInArrow(_blocks(block_bytes), _BLOCK_SQL), "block", parts)
    senders, deep = known.select("block").count(), 1
    while senders > 1 << bits * deep:
        deep += 1

    levels: list[Level] = []
    for k in range(1, order + 1):
        asks = known.mapInArrow(_first_asks(k, list(levels), hot, bits), _ASK_SQL)
        leaves = _leaves(k, levels[-1].d if levels else np.ones(CUT + 1), bits * deep)
        answers, found = _exchange(asks, leaves, senders, 0, deep, bits, parts)
        levels.append(_level(found))
        answers = answers.groupBy(F.col("node").alias("block")).agg(F.collect_list(F.struct("path", "body")).alias("answers"))
        heard = known.join(answers, "block", "left")
        if k < order:
            state = bucketed(heard.mapInArrow(_heard(k, list(levels), hot, bits), f"block long, known{k} binary"), "block", parts)
            known = known.join(state, "block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heard.mapInArrow(_scores(order, levels, hot, bits), schema)
