"""Token ids as length-delimited binary records with masked checksums, and an offset index beside each shard.

A record is: payload length (8 bytes, little-endian), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the
payload (4). The payload is the document id (8 bytes, signed; the smallest value stands for null), the width of an id
(1 byte) and the ids (unsigned, 2 bytes each if all are below 65,536, else 4). An index file has 32 bytes a record: doc_id, byte offset, payload length, ids of the shard before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.llm.common import arrow_rows, id_and_text, small_batches
from voxelweave.llm.token_cache import encoded_slices, encoder
from voxelweave.session import cut, work_uri

SHARD_BYTES = 128 << 20
READ_BYTES = 8 << 20
#: Encoded parts that a worker keeps in each of two generations; few, as the JVM sorts beside it.
CACHE_PARTS = 250_000
NO_ID = -(1 << 63)
MASK = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted by a constant, so that a checksum of checksums stays sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(buf: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at an offset and the offset after it; ValueError if a checksum or a length is wrong."""
    head = bytes(buf[at : at + 8])
    if len(head) < 8 or int.from_bytes(buf[at + 8 : at + 12], "little") != masked(head):
        raise ValueError(f"damaged length at byte {at}")
    n = int.from_bytes(head, "little")
    payload = buf[at + 12 : at + 12 + n]
    if len(payload) < n or int.from_bytes(buf[at + 12 + n : at + 16 + n], "little") != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + n


class Shard:
    """One file and its index, named by the attempt that writes them.

    No attempt touches another's files, whole or not: the manifest names those of the attempt that Spark committed, and
    readers open no others.
    """

    def __init__(self, uri: str, name: str, attempt: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.name = f"{name}-{attempt}"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}.rec")
        self.index: list[tuple] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        payload = (NO_ID if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.index.append((NO_ID if doc_id is None else doc_id, self.size, len(payload), self.tokens))
        self.out.write(record := frame(payload))
        self.size += len(record)
        self.tokens += len(ids)

    def close(self) -> dict:
        self.out.close()
        with self.fs.open_output_stream(f"{self.root}/{self.name}.idx") as out:
            out.write(np.array(self.index, INDEX).tobytes())
        return {"shard": self.name, "records": len(self.index), "tokens": self.tokens, "bytes": self.size}


_MANIFEST = "shard string, records long, tokens long, bytes long"


def _writer(uri: str, path: str, kind: str, end: int, shard_bytes: int):
    schema = pa.schema([("shard", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get(), 0
        shard, enc = None, encoder(path, kind, CACHE_PARTS)
        for batch in batches:
            for doc_ids, ids, at in encoded_slices(enc, batch):
                for doc_id, a, b in zip(doc_ids, at[:-1].tolist(), at[1:].tolist()):
                    shard = shard or Shard(uri, f"part-{task.partitionId():06d}-{part:04d}", task.taskAttemptId())
                    shard.add(doc_id, np.append(ids[a:b], np.uint32(end)))
                    if shard.size >= shard_bytes:
                        yield pa.RecordBatch.from_pylist([shard.close()], schema)
                        shard, part = None, part + 1
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close()], schema)

    return run


def write_tokens(docs: DataFrame, uri: str, path: str, kind: str = "plain", end: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, end it with the id `end`, and write the records in ascending doc_id order.

    Rows are dealt by ranges of doc_id, so shard names in order hold ids in order (null ids first, equal ids side by
    side, rows that repeat an id each as a record of their own). A null or empty text is the end id alone; an empty
    table gives an empty manifest; columns besides the two are not read. Returns the manifest, computed: shard, records,
    tokens, bytes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = id_and_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    with small_batches(docs.sparkSession):
        return cut(in_order.mapInArrow(_writer(uri, path, kind, end, shard_bytes), _MANIFEST))


def _reader(uri: str, shuffled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard, base in zip(arrow_rows(batch, "shard").to_pylist(), arrow_rows(batch, "base").to_pylist()):
                with fs.open_input_stream(f"{root}/{shard}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                if shuffled:  # any order does: the index finds each record
                    index = index[np.random.default_rng(zlib.crc32(shard.encode())).permutation(len(index))]
                with fs.open_input_file(f"{root}/{shard}.rec") as f:
                    lo = 0
                    while lo < len(index):
                        hi = lo + 1
                        if not shuffled:
                            hi = max(hi, int(np.searchsorted(index["offset"], index["offset"][lo] + READ_BYTES)))
                        first = int(index["offset"][lo])
                        buf = memoryview(f.read_at(int(index["offset"][hi - 1] + index["length"][hi - 1]) + 16 - first, first))
                        rows = [[], [], [], []]
                        for r in index[lo:hi]:
                            payload, _ = unframe(buf, int(r["offset"]) - first)
                            doc_id = int.from_bytes(payload[:8], "little", signed=True)
                            ids = np.frombuffer(payload[9:], f"<u{payload[8]}").astype("<u4")
                            if doc_id != r["doc_id"] or len(payload) != r["length"]:
                                raise ValueError(f"the index of {shard} does not fit its records")
                            for to, v in zip(rows, (None if doc_id == NO_ID else doc_id, base + int(r["before"]), len(ids), ids.tobytes())):
                                to.append(v)
                        yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        lo = hi

    return run


def read_tokens(manifest: DataFrame, uri: str, shuffled: bool = False) -> DataFrame:
    """The records of all shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    Checks both checksums of every record, and the index against it. One manifest row stands for a whole shard, so the
    running sum that places shards goes over as many rows as there are files.
    """
    base = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest.select("shard", base.alias("base")).repartition(parts, "shard")
    return placed.mapInArrow(_reader(uri, shuffled), "doc_id long, start long, n_tokens long, ids binary")


def op4_token_records(spark, sf_dir: str) -> DataFrame:
    """Per document, from the record files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    uri = work_uri(spark, "token-records")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
