"""Near-duplicate groups by HyperMinHash: compressed registers, banding, estimation, then exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import U, arrow_rows, id_and_text, mix, shingle_hashes, small_batches, text_slices, written
from voxelweave.operators.graph import connected_components
from voxelweave.session import cut

BANDS, ROWS = 40, 8
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Standard errors below the threshold down to which an estimate still asks for verification.
MARGIN = 4
#: Rows of one block in the comparison of what is left of a bucket.
BLOCK = 512
#: Ids above this number are matched by a shuffle join instead of a broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000

_PROBE: list[np.ndarray] = []


def _probes() -> np.ndarray:
    """For each register the other registers to borrow from, in a fixed random order."""
    if not _PROBE:
        at = np.arange(REGISTERS * 4096, dtype=np.uint64)
        _PROBE.append((mix(at + U(77)) % U(REGISTERS)).astype(np.int32).reshape(REGISTERS, 4096))
    return _PROBE[0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash of sorted distinct 64-bit shingle hashes (at least one): 16 bits a register.

    The high half of a hash picks the bucket; each bucket keeps the smallest of its remixed hashes as a leading-zero
    count and the next ten mantissa bits. An empty bucket borrows from the first filled one of its probe order, which
    keeps the chance of agreement at the Jaccard similarity for small sets as well.
    """
    bucket = (((shingles >> U(32)) * U(REGISTERS)) >> U(32)).astype(np.int64)
    value = mix(shingles ^ U(0xD1B54A32D192ED03))
    runs = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    low = np.minimum.reduceat(value, runs)
    filled = np.zeros(REGISTERS, bool)
    filled[bucket[runs]] = True
    m, e = np.frexp(np.maximum(low, U(1)).astype(np.float64))
    zeros = np.clip(64 - e, 0, 63)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[runs]] = (zeros << MANTISSA_BITS) | np.minimum(((m - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64), (1 << MANTISSA_BITS) - 1)
    empty = np.flatnonzero(~filled)
    probes, lo = _probes(), 0
    while len(empty) and lo < probes.shape[1]:
        hi = lo + (32 if lo == 0 else 512)
        ask = probes[empty, lo:hi]
        hit = filled[ask]
        got = hit.any(axis=1)
        out[empty[got]] = out[ask[got, hit[got].argmax(axis=1)]]
        empty, lo = empty[~got], hi
    if len(empty):  # a set of one or two: any fixed choice does
        out[empty] = out[bucket[runs[0]]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the share that agrees by chance (Yu and Weber 2017)."""
    share = (a == b).mean(axis=-1)
    chance = 0.169919487159739093975315012348 * 2.0**-MANTISSA_BITS * 4 * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    return (share - chance) / (1 - chance)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band, from (rows, REGISTERS) registers."""
    halves = np.ascontiguousarray(sigs).view(np.uint64).reshape(len(sigs), BANDS, ROWS // 4)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + U(1)), (len(sigs), BANDS)).copy()
    for k in range(ROWS // 4):
        key = mix(key * U(0x9E3779B97F4A7C15) + halves[:, :, k])
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = arrow_rows(batch, "doc_id")
        for i, j, data, offs in text_slices(batch, "text"):
            n, digest, sig = [], [], []
            for s in shingle_hashes(data, offs):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(registers(s).tobytes() if len(s) else None)
            yield pa.record_batch([ids.slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, registers (null for an empty set)."""
    return docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, sig binary")


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            keys = band_keys(_sig_matrix(arrow_rows(part, "sig")))
            reps = np.repeat(arrow_rows(part, "rep").to_numpy(), BANDS)
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["band", "rep"])


def _estimates(threshold: float):
    floor = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                n = [arrow_rows(part, c).to_numpy() for c in ("n_a", "n_b")]
                keep = estimate(_sig_matrix(arrow_rows(part, "sig_a")), _sig_matrix(arrow_rows(part, "sig_b")), *n) >= floor
                keep &= np.minimum(*n) >= threshold * np.maximum(*n) - 1e-9  # no more of the union than the smaller set can be shared
                yield part.filter(pa.array(keep)).select(["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b = (arrow_rows(batch, c).to_pylist() for c in ("a", "b"))
            keep = []
            for i, j, data, offs in text_slices(batch, "text_b"):
                for row, mine in zip(range(i, j), shingle_hashes(data, offs)):
                    if last[0] != a[row]:
                        one = next(text_slices(batch.slice(row, 1), "text_a"))
                        last = (a[row], next(shingle_hashes(*one[2:])))
                    both = len(np.intersect1d(last[1], mine, assume_unique=True))
                    if len(mine) and 100 * both >= percent * (len(mine) + len(last[1]) - both):
                        keep.append(row)
            yield pa.record_batch([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return run


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, estimated: bool = False) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough: first by registers, then on the full shingle sets."""
    spark = pairs.sparkSession
    if not estimated:
        left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
        right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
        pairs = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(_estimates(percent / 100), "a long, b long")
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    if ids.count() <= BROADCAST_IDS:
        texts = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    else:
        texts = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_verify(percent), "a long, b long")


def _blocks(threshold: float):
    """Pairs of two blocks of a bucket that are in different components, collide in no earlier band and are estimated similar."""
    floor = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = []
        rep, comp, n, side = (rows.column(c).to_numpy() for c in ("rep", "component", "n_shingles", "side"))
        sig = _sig_matrix(rows.column("sig").combine_chunks())
        bands = band_keys(sig)
        own = np.uint64(key[0].as_py() & ((1 << 64) - 1))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for x in left:
            ys = right[(comp[right] != comp[x]) & (rep[right] > rep[x])] if side[x] == 2 else right[comp[right] != comp[x]]
            if not len(ys):
                continue
            ys = ys[np.minimum(n[ys], n[x]) >= threshold * np.maximum(n[ys], n[x]) - 1e-9]
            ys = ys[estimate(sig[ys], sig[x], n[ys], n[x]) >= floor]
            if len(ys):
                same = bands[ys] == bands[x]
                ys = ys[bands[x][same.argmax(axis=1)] == own]
                found += [(min(rep[x], rep[y]), max(rep[x], rep[y])) for y in ys]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their five-word shingle sets.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself included) and kept. Equal shingle sets
    are folded to one representative first, so thousands of copies cost one row. Representatives that share a band of
    registers meet in a bucket; each is compared with the bucket's smallest and with its largest, and the verified
    links are contracted to components, so a group of near copies takes comparisons in proportion to its rows. What a
    bucket then still holds of different components, texts that are alike but mostly below the limit, is compared in
    blocks by registers, so no link is lost to the choice of partners; only there comparisons of registers, not rows that
    are shuffled, grow with the square of a bucket. Every candidate is confirmed on whole shingle sets.

    Null or wordless texts have empty sets and link with nothing. Rows without an id are kept and link with nothing
    (component_id null). Rows that repeat a doc_id count as one document; each gets its row in the result.
    An empty table gives an empty result; columns besides the two are not read. A very long text is hashed in windows, but its
    shingle hashes, eight bytes each, are held by one task; both texts of a pair that is confirmed meet there.
    """
    with small_batches(docs.sparkSession):
        return _groups(id_and_text(docs, id_col, text_col), percent)


def _mixed(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (band, rep, component) of the buckets that hold more than one component, with the number of a bucket's rows.

    The aggregate is written out before it meets the rows, so the join stands on exchanges of its own, which adaptive
    execution splits where a bucket is large.
    """
    rest = buckets.join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    rest = cut(rest.select("band", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = cut(rest.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size")).where("c1 < c2"))
    return rest.join(mixed.select("band", "size").hint("merge"), "band")


def _groups(docs: DataFrame, percent: int) -> DataFrame:
    marked = cut(signatures(docs))
    classes = marked.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = cut(classes)
    sigs = marked.select(F.col("doc_id").alias("rep"), "digest", "sig", "n_shingles")
    reps = cut(sigs.join(classes.hint("merge"), ["rep", "digest"]).dropDuplicates(["rep", "digest"]).drop("digest"))
    # the ends of the buckets are written out before they meet the bands, and nothing behind the join rests on its
    # partitioning, so that adaptive execution can split a bucket that a third of the representatives are in
    bands = written(reps.mapInArrow(_bands, "band long, rep long"), "dedup-bands")
    lead = cut(bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high"))
    buckets = cut(bands.join(lead.hint("merge"), "band").select("band", "rep", "low", "high"))
    lows = buckets.where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    highs = buckets.where("rep < high").select(F.col("rep").alias("a"), F.col("high").alias("b"))
    links = cut(_links(lows.union(highs).distinct(), reps, docs, percent))
    parts = cut(connected_components(links, "a", "b"))
    # what is left: members of buckets that still hold more than one component, without the two already compared
    rest = _mixed(buckets.where("rep <> low and rep <> high").select("band", "rep"), parts)
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), n_blocks).cast("int")
    rest = rest.select("band", "rep", "component", n_blocks.alias("n"), block.alias("mine"))
    # a row goes to every pair of blocks that holds its own: side 0 is the lower block, 1 the higher, 2 the block with itself
    rest = rest.select("band", "rep", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rest = rest.select("band", "rep", "component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), side.alias("side"))
    rest = rest.join(reps.hint("merge"), "rep")
    pairs = rest.groupBy("band", "x", "y").applyInArrow(_blocks(percent / 100), "a long, b long").distinct()
    more = cut(_links(pairs, reps, docs, percent, estimated=True))
    parts = connected_components(_stars(parts).union(more), "a", "b")
    named = classes.join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = marked.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("digest")).alias("digest"))
    out = out.join(named.hint("merge"), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _stars(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
