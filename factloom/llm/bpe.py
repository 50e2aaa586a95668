"""Byte-level BPE by a dynamic programme over prefixes, and its decoding."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm.runtime import ship

#: Fixed value: the byte-level pattern that splits text before merging; white space as Unicode defines it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Entries of the newer of two generations of pieces seen before, and of pairs tested before.
CACHED = 150_000
#: Texts encoded at a time.
ROWS = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


#: The settings that this encoder follows, as the definition names them; a missing one counts as null.
_MODEL = {"type": ("BPE",), "dropout": (None, 0.0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)}
_SPLITTER = {"type": ("ByteLevel",), "add_prefix_space": (False,), "use_regex": (None, True)}
_ADDED = {"single_word": (None, False), "lstrip": (None, False), "rstrip": (None, False), "normalized": (None, False)}


def check_definition(definition: dict) -> None:
    """Raise ValueError if a tokenizer definition has settings under which other ids would come out than ``Encoder`` gives."""
    found = [("model", definition["model"], _MODEL), ("pre_tokenizer", definition.get("pre_tokenizer") or {}, _SPLITTER)]
    found += [("added token", x, _ADDED) for x in definition.get("added_tokens") or ()]
    found += [("definition", definition, {"normalizer": (None,)}), ("decoder", definition.get("decoder") or {}, {"type": ("ByteLevel",)})]
    for where, settings, known in found:
        for name, values in known.items():
            if settings.get(name) not in values:
                raise ValueError(f"{where}: {name} = {settings.get(name)!r} is not supported")
    if missing := [b for b, letter in enumerate(byte_letters()) if letter not in definition["model"]["vocab"]]:
        raise ValueError(f"the vocabulary has no token for the bytes {missing}")


class Encoder(dict):
    """Maps a piece of text to its ids, packed as little-endian 32-bit integers; fills itself.

    For every prefix of the piece one token ends the prefix's encoding. It is the one among the
    tokens ending there (an automaton over the vocabulary gives these) that can stand after the
    last token of the prefix it leaves. Following these tokens back from the end gives the ids.
    """

    def __init__(self, definition: bytes):
        super().__init__()
        definition = json.loads(definition)
        check_definition(definition)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = definition["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in definition.get("added_tokens") or ()}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            if token not in self.special:
                self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda text: [text]
        self.pieces = regex.compile(_SPLIT).findall

        self.rank: dict[int, int] = {}
        self.merge: dict[int, int] = {}  # by left << 20 | right
        self.parts: dict[int, tuple[int, int]] = {}
        for at, pair in enumerate(definition["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole, pair = vocabulary[left + right], (vocabulary[left], vocabulary[right])
            self.merge[pair[0] << 20 | pair[1]] = at
            if whole not in self.parts:
                self.rank[whole], self.parts[whole] = at, pair
        self.known = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            if token not in self.special and (len(self.bytes[i]) == 1 or i in self.parts):
                self.known.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.known.make_automaton()
        self.older: dict[str, bytes] = {}
        self.tested: dict[int, bool] = {}
        self.tested_older: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that were once at an edge of ``token`` (side 0 left, 1 right), and the rank of the merge that took each in."""
        key = (token, side)
        if key in self.edges:
            return self.edges[key]
        found, until = self.edges.setdefault(key, []), float("inf")
        while True:
            found.append((token, until))
            if token not in self.parts:
                return found
            until = self.rank[token]
            token = self.parts[token][side]

    def fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side.

        Merges happen by rank, equal ones from left to right. The border falls if two tokens that
        were at it merge before either is taken into its own neighbour.
        """
        merge, ends = self.merge, self.edge(right, 0)
        for a, a_until in self.edge(left, 1):
            for b, b_until in ends:
                at = merge.get(a << 20 | b)
                if at is not None and at < a_until and at <= b_until:
                    return False
        return True

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is not None:
            self[piece] = packed
            return packed
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        last = [-1] * len(raw)
        size = [0] * len(raw)
        tested = self.tested
        for end, (token, length) in self.known.iter(raw):
            if last[end] < 0:
                before = end - length
                if before < 0:
                    fits = True
                else:
                    key = last[before] << 20 | token
                    fits = tested.get(key)
                    if fits is None:
                        fits = self.tested_older.get(key)
                        if fits is None:
                            fits = self.fit(last[before], token)
                        tested[key] = fits
                if fits:
                    last[end], size[end] = token, length
        ids, end = [], len(raw) - 1
        while end >= 0:
            ids.append(last[end])
            end -= size[end]
        ids.reverse()
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(tested) > CACHED:
            self.tested, self.tested_older = {}, tested
        if len(self) > CACHED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        parts = self.cut(text)
        get, out = self.__getitem__, []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                out.extend(map(get, self.pieces(part)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """``docs`` with ids (array<int>) and decoded (string) in place of columns of these names.

    ids are those of the byte-level BPE defined in ``tokenizer_file`` for the whole text, special
    tokens recognised in it and none added; decoded is the text that the ids stand for. Null text is
    empty and has no ids; each row is treated by itself, so repeated rows agree. The file is read
    by the driver and broadcast: its size is that of a vocabulary. Settings of it that this encoder does
    not follow are a ValueError (``check_definition``). An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_file, "rb") as f:
        raw = f.read()
    check_definition(json.loads(raw))
    definition = spark.sparkContext.broadcast(raw)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition.value)  # made in a quarter of a second; kept, its caches would stay in an idle worker
        for batch in batches:
            n = batch.num_rows
            for row in range(0, n, ROWS):
                stop = min(row + ROWS, n)
                texts = batch.column("text").slice(row, stop - row).to_pylist()
                packed = [np.frombuffer(encoder.encode(x or ""), dtype="<u4") for x in texts]
                ends = np.cumsum([0, *map(len, packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(packed).astype(np.int32), pa.int32()))
                decoded = pa.array([encoder.decode(x) for x in packed], pa.string())
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), ids, decoded], [*kept, "ids", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema.fields)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def pack_ids(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit integers), decoded_sha256 of the rows of ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            digests = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            texts = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(digests), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids", "decoded").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
