"""Whole texts as token ids: parts are told apart in Arrow, each distinct part of a slice is encoded or looked up once.

Both vocabularies split a text before they merge, and never across the end of a word; so the ids of a text are those
of its parts one after the other. A slice of texts is cut into parts by byte masks, Arrow's dictionary gives the
distinct ones, and their ids are dealt out again by a take; Python sees distinct parts alone.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from voxelweave.llm.common import arrow_rows, text_slices

#: Parts kept per worker and generation; the older generation goes when the younger is full.
CACHE_PARTS = 300_000
#: Longer parts are encoded but not kept.
CACHE_CHARS = 64
#: Bytes of text that are cut into parts together; a longer text is taken in windows that end at a cut.
WINDOW = 4 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[32, 10]] = True
#: Marks that no match joins with a letter before them.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*#$%&|")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_LOADED: dict[tuple[str, str], "PartEncoder"] = {}


def _tails(data: np.ndarray) -> np.ndarray:
    """Where punctuation follows a letter of ASCII or Latin-1: no match goes over that border."""
    at = np.zeros(len(data), bool)
    at[1:] = _LETTER[data[:-1]] & _TAIL[data[1:]]
    spot = np.flatnonzero(_TAIL[data[2:]] & (data[:-2] == 0xC3)) + 2
    at[spot] = (data[spot - 1] != 0x97) & (data[spot - 1] != 0xB7)  # the two signs among the letters
    return at


def cut_marked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of byte-level texts: before a blank or newline that follows a non-space, and before punctuation behind a letter.

    No match of the splitting pattern runs on from a non-space into white space, and none looks behind; so a cut
    there moves no match. A byte that could end a white space of several bytes allows no cut.
    """
    at, solid = _tails(data), _SOLID[data[:-1]]
    high = data[:-1] >= 0x80
    if high.any():
        wide = high.copy()
        wide[1:] &= data[:-2] != 0xC2
        wide[2:] &= (data[:-3] < 0xE1) | (data[:-3] > 0xE3)
        solid = solid | wide
    at[1:] |= solid & _BREAK[data[1:]]
    return data, at


def cut_plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts for a vocabulary that folds case and drops white space: before blanks, newlines and punctuation behind a letter.

    A to Z are folded first, so that words share their parts; not before a byte above ASCII, which may be a mark that
    composes by case.
    """
    at = _tails(data)
    at |= _BREAK[data]
    fold = (data >= 65) & (data <= 90)
    fold[:-1] &= data[1:] < 0x80
    return data + (fold.view(np.uint8) << 5), at


class PartCache:
    """Ids of parts that were met before, in two generations of bounded size."""

    def __init__(self, parts: int = CACHE_PARTS):
        self.parts = parts
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, parts: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct parts; learn(parts) gives those of new ones."""
        if len(self.young) > self.parts:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        got = list(map(young.get, parts))
        gaps = [k for k, x in enumerate(got) if x is None]
        new = []
        for k in gaps:
            known = old.get(parts[k])
            if known is None:
                new.append(k)
            else:
                got[k] = young[parts[k]] = known
        for k, ids in zip(new, learn([parts[k] for k in new])):
            got[k] = ids
            if len(parts[k]) <= CACHE_CHARS:
                young[parts[k]] = ids
        return got


class Parts:
    """Token ids of texts in a slice, given a way to cut and a way to encode a part."""

    def __init__(self, cut: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], learn: Callable[[list[str]], list[bytes]], parts: int):
        self.cut, self.learn, self.cache = cut, learn, PartCache(parts)

    def _window(self, data: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts that begin at pos, one after the other, and where each part's begin."""
        ends = np.append(pos, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(pos), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        known = self.cache.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.learn)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = pa.array(np.frombuffer(b"".join(known), np.uint32))
        dealt = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), ids).take(coded.indices)
        return dealt.values.to_numpy(), dealt.offsets.to_numpy()

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned, 32 bits) of a slice's texts, and where each text's begin. One text alone may be long."""
        n, bounds = len(data), np.zeros(len(offs), np.int64)
        if not n:
            return np.zeros(0, np.uint32), bounds
        if n > 2 * WINDOW and len(offs) == 2:
            ids = np.concatenate([self._cut(part, np.array([0, len(part)]))[0] for part in self._windows(data)])
            return ids, np.array([0, len(ids)])
        return self._cut(data, offs)

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        said, at = self.cut(data)
        at[offs[:-1][offs[:-1] < len(data)]] = True
        pos = np.flatnonzero(at)
        ids, part_at = self._window(np.ascontiguousarray(said), pos)
        return ids, part_at[np.searchsorted(pos, offs)].astype(np.int64)

    def _windows(self, data: np.ndarray) -> Iterator[np.ndarray]:
        a, size = 0, WINDOW
        while a < len(data):
            b = min(a + size, len(data))
            if b < len(data):
                cuts = np.flatnonzero(self.cut(data[a:b])[1][1:])
                if not len(cuts):  # no cut so far: look further
                    size *= 2
                    continue
                b = a + int(cuts[-1]) + 1
            yield data[a:b]
            a, size = b, WINDOW


class PartEncoder(Parts):
    """Ids of texts by the tokenizers library; "marked" is byte-level, "plain" drops white space."""

    def __init__(self, path: str, kind: str, parts: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"marked": cut_marked, "plain": cut_plain}[kind], self._ask, parts)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # ids that show where a word begins (a blank before it) or ends (the end-of-word mark)
        self.first = kind == "marked"
        vocab = self.library.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if self.first else t.endswith("</w>"))]] = True

    def _each(self, parts: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(parts), 4096):
            for e in self.library.encode_batch_fast(parts[lo : lo + 4096], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _together(self, parts: list[str]) -> list[bytes] | None:
        """Ids of words that each begin with white space, asked for as one text and told apart by their borders; None if that fails."""
        ids = np.array(self.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        bounds = [*at.tolist(), len(ids)] if self.first else [0, *(at + 1).tolist()]
        if len(bounds) != len(parts) + 1 or bounds[0] != 0 or bounds[-1] != len(ids):
            return None
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]

    def _ask(self, parts: list[str]) -> list[bytes]:
        """Ids of parts from the library, words of letters alone many at a time."""
        out: list[bytes] = [b""] * len(parts)
        heads, words, rest = " " if self.first else " \n", [], []
        for k, p in enumerate(parts):
            (words if p[0] in heads and p[1:].isalpha() else rest).append(k)
        groups = [words[lo : lo + 512] for lo in range(0, len(words), 512)]
        while groups:
            some = groups.pop()
            got = self._together([parts[k] for k in some])
            if got:
                for k, ids in zip(some, got):
                    out[k] = ids
            elif len(some) > 8:
                groups += [some[: len(some) // 2], some[len(some) // 2 :]]
            else:  # a letter that the library doesn't know as one
                rest += some
        for k, ids in zip(rest, self._each([parts[k] for k in rest])):
            out[k] = ids
        return out


def encoder(path: str, kind: str, parts: int = CACHE_PARTS) -> PartEncoder:
    """One encoder per worker, path and kind ("marked" for byte-level, "plain" for the one that drops white space)."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = PartEncoder(path, kind, parts)
    return _LOADED[path, kind]


def encoded_slices(enc: Parts, batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, ids and where each text's ids begin, for slices of a batch of (doc_id, text); a null text counts as empty."""
    rows = arrow_rows(batch, "doc_id")
    for i, j, data, offs in text_slices(batch, "text", WINDOW):
        yield rows.slice(i, j - i).to_pylist(), *enc.encode(data, offs)
