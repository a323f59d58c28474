"""Byte-level BPE by backtracking over longest matches, exact and linear in the text, and its inverse.

A token sequence is the one that the merges give exactly if every two neighbours are: no merge across their border
would have come first. So the encoder takes the longest token at each place, asks whether it fits its left neighbour,
else tries the next shorter, and goes back where none fits. Every place is left for good at most once.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from voxelweave.llm.common import arrow_rows, id_and_text
from voxelweave.llm.token_cache import CACHE_PARTS, Parts, cut_marked, encoded_slices

#: Neighbour pairs whose fit a worker keeps.
CACHE_PAIRS = 1_000_000
_LOADED: dict[tuple[str, str], "ByteBpe"] = {}


class ByteBpe:
    """The vocabulary of one rank file, ready to encode and decode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        self.size = [0] * len(self.bytes)
        trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.bytes[i], self.size[i] = token, len(token)
            trie.add_word(token.decode("latin-1"), i)
        trie.make_automaton()
        self.trie = trie
        self.decimal = pa.array(map(str, range(len(self.bytes))))
        self.spelt = pa.array(self.bytes, pa.binary())
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes))]
        self.fits: dict[int, bool] = {}
        self.shorter = [-1] * len(self.bytes)
        for i in sorted(ranks.values()):
            token = self.bytes[i]
            for k in range(len(token) - 1, 0, -1):
                if (short := ranks.get(token[:k])) is not None:
                    self.shorter[i] = short
                    break
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None and a < i and b < i and self._fit(a, b):
                    self.pairs[a, b] = i
                    self.halves[i] = (a, b)
                    break
        self.fits = {}
        self.parts = Parts(cut_marked, lambda parts: [array("I", self.encode(p)).tobytes() for p in parts], CACHE_PARTS)

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between two tokens alone: unfold the later-made side until none joins."""
        limit, pairs, halves = len(self.bytes) + 1, self.pairs, self.halves
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b and halves[a][0] != a:
                limit, a = a, halves[a][1]
            elif halves[b][0] != b:
                limit, b = b + 1, halves[b][0]
            elif halves[a][0] != a:
                limit, a = a, halves[a][1]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._fit(a, b)
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        size, n = self.size, len(piece)
        longest = [-1] * (n + 1)
        for end, i in self.trie.iter(piece.decode("latin-1")):
            at = end + 1 - size[i]
            if longest[at] < 0 or size[longest[at]] < size[i]:
                longest[at] = i
        out: list[int] = []
        open_ends = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_ends[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.piece(m.encode("utf-8"))]

    def decode(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each id; in one buffer, so those of a run of ids lie side by side."""
        return self.spelt.take(pa.array(ids))


def vocabulary(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = ByteBpe(ranks, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text.

    A null or empty text has no ids; rows that repeat an id are encoded each; columns besides the two are not read. An empty
    table gives an empty result. A very long text is split and encoded whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for doc_ids, ids, at in encoded_slices(bpe.parts, batch):
                said = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(said, pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for; null ids count as none. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [x or b"" for x in arrow_rows(part, "ids").to_pylist()]
                at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw])))
                back = bpe.decode(np.frombuffer(b"".join(raw), np.uint32))
                said = [buf.to_pybytes() for buf in _runs(back, at)]
                yield pa.record_batch([arrow_rows(part, "doc_id"), pa.array(raw, pa.binary()), pa.array(said, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def _runs(said: pa.Array, at: np.ndarray) -> Iterator[pa.Buffer]:
    """The bytes of said[a:b] for each two neighbours of `at`."""
    _, offsets, data = said.buffers()
    ends = np.frombuffer(offsets, np.int32)[at].tolist() if len(said) else [0] * len(at)
    for a, b in zip(ends, ends[1:]):
        yield data.slice(a, b - a) if b > a else pa.py_buffer(b"")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, and SHA-256 of the decimal ids (one blank between) and of the decoded bytes.

    The ids never leave the task, and what is decoded are the ids. Nulls, repeated rows and other columns as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for doc_ids, ids, at in encoded_slices(bpe.parts, batch):
                decimal = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), bpe.decimal.take(pa.array(ids)))
                said = [hashlib.sha256(x).hexdigest() for x in _runs(pc.binary_join(decimal, " "), np.arange(len(at)))]
                back = [hashlib.sha256(x).hexdigest() for x in _runs(bpe.decode(ids), at)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(np.diff(at)), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers as public

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
