"""Web archives: payloads written as WARC records in segments, read back and reassembled by origin.

A response's block is an HTTP head and the payload in chunked transfer framing. A block longer than a segment goes on in
continuation records, which name the first record as their origin and carry a segment number, the last one also the
total length; they may stand in another file. Equal payloads are written once; others revisit that record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.llm.common import arrow_rows, small_batches
from voxelweave.session import cut, work_uri

SEGMENT_BYTES, FILE_BYTES, CHUNK_BYTES = 16 << 10, 64 << 20, 4096
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 9562
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for lo in range(0, len(payload), size):
        part = payload[lo : lo + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped; ValueError if it is cut short."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body without its last chunk")
        n = int(body[at:line].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[line + 2 : line + 2 + n]
        if len(part) < n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("chunk shorter than it says")
        out.append(part)
        at = line + 4 + n


def payload_of(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP head without an end")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


class Archive:
    """Numbered files of one task attempt, named by it.

    No attempt touches another's files; the manifest names those of the attempt that Spark committed.
    """

    def __init__(self, uri: str, task: int, attempt: int, most: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.root, recursive=True)
        self.task, self.attempt, self.most, self.number, self.out, self.size = task, attempt, most, 0, None, 0
        self.done: list[str] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name, self.size = f"part-{self.task:06d}-{self.number:04d}-{self.attempt}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(data)
        self.size += len(data)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.name)
            self.out, self.number = None, self.number + 1


def _writer(uri: str, segment: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get(), None
        for batch in batches:
            for row in zip(*[arrow_rows(batch, c) for c in ("page_id", "url", "payload", "key", "copy", "first_key", "first_id")]):
                page_id, url, payload, key, copy, first_key, first_id = (x.as_py() for x in row)
                files = files or Archive(uri, task.partitionId(), task.taskAttemptId(), most)
                url = url and url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
                rid = record_id(f"{key}#{copy}")
                common = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("X-Source-Id", page_id), ("Content-Type", "application/http; msgtype=response")]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if first_key is not None:
                    files.add(record([("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"{first_key}#1")), ("X-Refers-To-Source-Id", first_id), *common], http))
                    continue
                block = http + chunked(payload)
                parts = [block[lo : lo + segment] for lo in range(0, len(block), segment)]
                total = len(block)
                for k, part in enumerate(parts, 1):
                    last = ("WARC-Segment-Total-Length", total if k == len(parts) else None)
                    if len(parts) == 1:
                        files.add(record([("WARC-Type", "response"), *common], part))
                    elif k == 1:
                        files.add(record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], part))
                    else:
                        files.add(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{key}#{copy}/{k}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), last], part))
        if files:
            files.close()
            yield pa.record_batch([pa.array(files.done)], ["file"])

    return run


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record a row; returns the file names, computed.

    Of rows with equal payloads of at least `least_bytes` the one with the smallest id is the response and the others
    revisit it; the smallest id is a partial aggregate over digests, and only digests and ids meet in the join. Payloads
    are shuffled once. A null payload counts as empty. Rows that repeat both id and payload are records of their own
    and share their kind; rows without an id are responses. An empty table gives no file; other columns are not read.
    """
    payload = F.encode(F.coalesce(pages[payload_col].cast("string"), F.lit("")), "UTF-8")
    base = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("sha", F.sha2("payload", 256))
    ids = base.where(F.octet_length("payload") >= least_bytes).select("page_id", "sha")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first_id"))
    later = ids.join(first.hint("merge"), "sha").where("page_id > first_id").select("page_id", "sha", "first_id").distinct()
    rows = base.join(later.hint("merge"), ["page_id", "sha"], "left")
    key = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "sha")
    first_key = F.when(F.col("first_id").isNotNull(), F.concat_ws("-", F.col("first_id").cast("string"), "sha"))
    copy = F.row_number().over(W.partitionBy("page_id", "sha").orderBy("url"))
    rows = rows.select("page_id", "url", "payload", "first_id", key.alias("key"), first_key.alias("first_key"), copy.alias("copy"))
    with small_batches(pages.sparkSession):
        return cut(rows.mapInArrow(_writer(uri, segment_bytes, file_bytes), "file string"))


def _members(stream) -> Iterator[bytes]:
    buf = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not buf and not (buf := stream.read(1 << 20)):
                if out:
                    raise ValueError("archive ends within a record")
                return
            out.append(z.decompress(buf))
            buf = z.unused_data
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('warc-record-id')} is not as long as it says")
    return headers, rest[:n]


SEGMENT = "origin string, number int, total long, type string, page_id long, digest string, refers_to string, refers_to_id long, url string, block binary"
_FIELDS = ["origin", "number", "total", "type", "page_id", "digest", "refers_to", "refers_to_id", "url", "block"]
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("refers_to_id", pa.int64()), ("url", pa.string()), ("block", pa.binary())])


def _reader(uri: str, segmented: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for name in arrow_rows(batch, "file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in _members(f):
                        h, block = parse(data)
                        if ("warc-segment-number" in h) != segmented:
                            continue
                        url = h.get("warc-target-uri")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append(dict(zip(_FIELDS, (h.get("warc-segment-origin-id", h["warc-record-id"]), number(h, "warc-segment-number") or 1, number(h, "warc-segment-total-length"), h["warc-type"], number(h, "x-source-id"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to"), number(h, "x-refers-to-source-id"), url, block))))
                        size += len(block)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SEGMENT)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SEGMENT)

    return run


RECORD = "record_id string, record_type string, page_id long, url string, payload binary, payload_digest string, refers_to_record string, refers_to long"
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their segments: numbers without a gap, the total length as told, the payload's digest as told."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            out = []
            for row in batch.slice(lo, 256).to_pylist():
                parts = sorted(row["segments"], key=lambda s: s["number"])
                if [s["number"] for s in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError(f"record {row['origin']} lacks a segment")
                block, total, head = b"".join(s["block"] for s in parts), parts[-1]["total"], parts[0]
                if total is None and len(parts) > 1 or total is not None and total != len(block):
                    raise ValueError(f"record {row['origin']} has {len(block)} bytes of {total}")
                payload = None
                if head["type"] == "response":
                    payload = payload_of(block)
                    if sha1_base32(payload) != head["digest"]:
                        raise ValueError(f"record {row['origin']} has another payload than its digest")
                out.append({"record_id": row["origin"], "record_type": head["type"], "page_id": head["page_id"], "url": head["url"], "payload": payload, "payload_digest": head["digest"], "refers_to_record": head["refers_to"], "refers_to": head["refers_to_id"]})
            yield pa.RecordBatch.from_pylist(out, _RECORD)


def read_warc(files: DataFrame, uri: str) -> DataFrame:
    """The records of the archives, whole: record_id, record_type, page_id, url, payload, payload_digest, refers_to_record, refers_to.

    Segments are grouped by origin; records of one segment need no shuffle and are decoded where they are read. A
    revisit has no payload; its digest is that of the payload it stands for.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.repartition(parts, "file")
    fields = F.struct("number", "total", "type", "page_id", "digest", "refers_to", "refers_to_id", "url", "block")
    whole = spread.mapInArrow(_reader(uri, False), SEGMENT).select("origin", F.array(fields).alias("segments"))
    cut_up = spread.mapInArrow(_reader(uri, True), SEGMENT).groupBy("origin").agg(F.collect_list(fields).alias("segments"))
    return whole.mapInArrow(_decode, RECORD).union(cut_up.mapInArrow(_decode, RECORD))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    uri = work_uri(spark, "warc")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    records = read_warc(files, uri)
    with small_batches(spark):
        records = cut(records.select("record_id", "page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to_record", "refers_to"))
    full = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("n").alias("full"))
    out = records.join(full.hint("merge"), "refers_to_record", "left")
    return out.select("page_id", F.coalesce("n", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
