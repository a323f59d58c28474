"""Helpers inside tasks: text out of Arrow batches in bounded slices, and vectorised word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.session import work_uri

SLICE_BYTES = 1 << 19
U = np.uint64
_M1, _M2, _BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C55
#: Bytes that hash_spans works on at a time.
HASH_BYTES = 1 << 20
_POWERS: list[np.ndarray] = []

#: ASCII white space, by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SAME = np.arange(256, dtype=np.uint64) + U(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += U(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(_M1)
    x ^= x >> U(27)
    x *= U(_M2)
    x ^= x >> U(31)
    return x


def _powers() -> list[np.ndarray]:
    """The base's powers and those of its inverse, as many as a window has bytes."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(HASH_BYTES + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of about `most` bytes each; a longer text makes a slice of its own.

    A null counts as an empty text.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def row_starts(n: int, offs: np.ndarray) -> np.ndarray:
    first = np.zeros(n + 1, bool)
    first[offs] = True
    return first[:n]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from prefix sums of one polynomial.

    Spans are in order and don't overlap. Prefix sums are made for a window at a time; a span that reaches into several
    adds up what each window has of it.
    """
    up, down = _powers()
    value, out = _LOWER if lower else _SAME, np.zeros(len(start), np.uint64)
    for a in range(0, len(data), HASH_BYTES):
        b = min(a + HASH_BYTES, len(data))
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        if lo >= hi:
            continue
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = np.maximum(start[lo:hi] - a, 0), np.minimum(end[lo:hi], b) - a
        part = (sums[e] - sums[s]) * down[s]
        if start[lo] < a:
            part[:1] *= U(pow(_BASE, int(a - start[lo]), 1 << 64))
        out[lo:hi] += part
    return mix(out + (end - start).astype(np.uint64) * U(_M1))


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of anything but `space`, by byte), and where each row's words begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, word = row_starts(n, offs), ~space[data]
    begins, ends = word & first, word.copy()
    begins[1:] |= word[1:] & ~word[:-1]
    ends[:-1] &= ~word[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offs)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles.

    A text of fewer words than `width` has its whole word sequence as one shingle; one without words has none.
    """
    start, end, at = words(data, offs)
    w = hash_spans(data, start, end, lower)
    odd = [U((_M2 * (2 * k + 3)) & ((1 << 64) - 1) | 1) for k in range(width)]
    if len(w) >= width:
        s = w[: len(w) - width + 1] * odd[0]
        for k in range(1, width):
            s += w[k : len(w) - width + 1 + k] * odd[k]
        s = mix(s)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            few = (w[a:b] * np.array(odd[: b - a])).sum(dtype=np.uint64, keepdims=True)
            yield mix(few + np.uint64((b - a) * 0x51ED27))
        else:
            yield np.zeros(0, np.uint64)


def crc_mod3(doc_id):
    """crc32(doc_id as text) mod 3, which separates learning rows from held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def arrow_rows(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for the jobs that run inside; the session's own setting holds again afterwards.

    Texts are long, and a batch is held whole on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: compressed, and without lineage."""
    out = work_uri(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read, under fixed names; so extra columns can't clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
