"""Documents packed into fixed token windows by vector best-fit under three capacities at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import id_and_text
from voxelweave.llm.token_cache import encoded_slices, encoder

#: Pieces that are sorted and placed together.
BLOCK = 16_384
#: Encoded parts that a worker keeps in each of two generations, about 130 bytes each.
CACHE_PARTS = 200_000


def pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones behind a first that takes the rest."""
    if n <= most:
        return [(0, n)]
    head = n % most
    return ([(0, head)] if head else []) + [(s, most) for s in range(head, n, most)]


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of every piece; capacity is (tokens, documents, attention cost), attention costs length squared.

    Longest first. Among the open bins that have room in every dimension a piece goes to the one whose weighted
    residual is shortest after it ("norm"), or whose residual points most its way ("dot"); ties go to the oldest bin. A
    new bin opens only where none has room. Bins that can't take the shortest piece left are closed.
    """
    cap, w = np.array(capacity, float), np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, name, fill = np.zeros((256, 3)), np.zeros(256, np.int64), np.zeros(256, np.int64)
    n_open = n_bins = 0
    least = lengths[order[-1]] if len(order) else 0
    for k, item in enumerate(order.tolist()):
        size = int(lengths[item])
        need = np.array([size, 1.0, float(size) * size])
        r = left[:n_open]
        ok = np.flatnonzero((r[:, 0] >= size) & (r[:, 1] >= 1) & (r[:, 2] >= need[2])) if n_open else ()
        if len(ok):
            share = r[ok] / cap
            if rule == "dot":
                at = ok[np.argmax(share @ (w * need / cap))]
            else:
                rest = share - need / cap
                at = ok[np.argmin((rest * rest) @ w)]
        else:
            if n_open == len(left):
                left, name, fill = (np.concatenate((x, np.zeros_like(x))) for x in (left, name, fill))
            at = n_open
            left[at], name[at], fill[at] = cap, n_bins, 0
            n_open, n_bins = n_open + 1, n_bins + 1
        bin_of[item], place[item] = name[at], fill[at]
        left[at] -= need
        fill[at] += size
        if left[at, 0] < least or left[at, 1] < 1:
            n_open -= 1
            for x in (left, name, fill):
                x[at] = x[n_open]
    return bin_of, place


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pack(docs: DataFrame, path: str, kind: str = "marked", end: int = 2, capacity: tuple[int, int, int] = (1024, 1024, 1024 * 1024), rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """Every document encoded, ended with the id `end`, cut only where it is longer than a window, and packed.

    Returns a row a piece: doc_id, piece, start, length, ids (binary), sequence_id, offset. Pieces are dealt by a hash
    before they are placed, so that each task has all lengths however the files are laid out. Windows are filled within a
    task, a block of pieces at a time, so a task holds one block; each task leaves a few windows partly filled, against
    the thousands that it fills. capacity bounds the tokens, documents and attention cost
    (sum of squared lengths) of a window; a piece of full length must fit an empty one.

    A null text counts as empty: its one piece is the end id. Repeated rows are packed as they come. An empty table gives an
    empty result; columns besides the two are not read. The ids of a very long text are held whole by the task that cuts it.
    """
    if capacity[1] < 1 or capacity[2] < capacity[0] ** 2:
        raise ValueError("a window must have room for one piece of full length")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path, kind, CACHE_PARTS), np.array([end], "<u4").tobytes()
        for batch in batches:
            for doc_ids, ids, at in encoded_slices(enc, batch):
                rows = []
                for doc_id, a, b in zip(doc_ids, at[:-1].tolist(), at[1:].tolist()):
                    said = ids[a:b].tobytes() + tail
                    for k, (start, n) in enumerate(pieces(b - a + 1, capacity[0])):
                        rows.append((doc_id, k, start, n, said[4 * start : 4 * (start + n)]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

    def placed(rows: pa.Table, first: int) -> tuple[list[pa.RecordBatch], int]:
        bins, at = best_fit(rows.column("length").to_numpy(), capacity, rule=rule)
        out = rows.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(at))
        return out.to_batches(), first + int(bins.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt, held, n = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= block:
                rows = pa.Table.from_batches(held)
                out, nxt = placed(rows.slice(0, block), nxt)
                held, n = rows.slice(block).to_batches(), n - block
                yield from out
        if n:
            yield from placed(pa.Table.from_batches(held), nxt)[0]

    # the length is in the key for rows without an id; a task fetches its rows file by file, so a block of them needs the sort
    key = ["doc_id", "piece", "length"]
    dealt = id_and_text(docs).mapInArrow(encoded, PIECES).repartition(*key).sortWithinPartitions(F.xxhash64(*key))
    return dealt.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; windows of 1024 tokens.

    The caps on documents and attention cost are those of a window of 1024 tokens, which no choice can exceed, so they cost
    no sequences and only weigh the choice between bins.
    """
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
