"""Vectorised helpers for whole texts inside Arrow batches.

A batch is cut into chunks of whole texts, so that the arrays made from a chunk stay
small; every text is read to its end. Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``; these bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n (BASE is odd, so it has an inverse)."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry at the end)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside[:-1].copy()
    last[:-1] &= ~inside[1:-1] if len(data) else inside[:0]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = inside[cuts]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased (A-Z) word, and the first word's index of each text.

    A word is read in pieces of eight bytes. Each is mixed with its number in the word, which no
    choice of letters undoes, before the pieces are added up; the length goes in last.
    """
    starts, ends, at = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    lower = np.zeros(len(data) + 8, dtype=np.uint8)
    lower[: len(data)] = _LOWER[data]
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=lower, strides=(1,))
    size = ends - starts
    pieces = (size + 7) // 8
    first = np.cumsum(pieces) - pieces
    number = np.arange(first[-1] + pieces[-1]) - np.repeat(first, pieces)
    begin = np.repeat(starts, pieces) + 8 * number
    left = np.minimum(np.repeat(ends, pieces) - begin, 8)
    value = eight[begin] & _FIRST_BYTES[left]
    mixed = mix(value ^ mix(number.astype(np.uint64), 31), 32)
    return mix(np.add.reduceat(mixed, first) + size.astype(np.uint64), 33), at


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words within each text, in order, and each text's first index.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    count = np.diff(at)
    n = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    out_at = np.concatenate([[0], np.cumsum(n)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    begin = np.repeat(at[:-1] - out_at[:-1], n) + np.arange(out_at[-1])
    stop = np.repeat(at[1:], n)
    out = np.zeros(len(begin), dtype=np.uint64)
    used = np.zeros(len(begin), dtype=np.uint64)
    for k in range(width):
        there = begin + k < stop
        step = hashes[np.minimum(begin + k, len(hashes) - 1)]
        out = np.where(there, out * BASE + step, out)
        used += there
    return mix(out, width) ^ used, out_at


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and each text's first index."""
    values = values.copy()
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[begin:end].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[at[:-1][at[:-1] < len(values)]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple]:
    """Columns of runs of whole groups, and where each group begins; rows come sorted by ``keys``."""

    def cut(held: pa.Table) -> np.ndarray:
        new = np.zeros(held.num_rows, dtype=bool)
        new[:1] = True
        for key in keys:
            values = held.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def out(held: pa.Table, cuts: np.ndarray) -> tuple:
        whole = [held.column(c).combine_chunks() for c in columns]
        return (*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in whole], np.append(cuts, held.num_rows))

    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.num_rows:
            cuts = cut(held)
            if cuts[-1]:
                yield out(held.slice(0, cuts[-1]), cuts[:-1])
                held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield out(held, cut(held))
