"""Repeated passages by content-defined chunking: a gear hash cuts, digests match, repeated runs go.

What is matched is a chunk with the one after it. Neighbour units overlap by a chunk, so a run of repeated units is one
passage, not a row of short chunks that happen to occur somewhere; and chunks can be small, which leaves little of a
passage at its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import SPACE, U, arrow_rows, id_and_text, mix, row_starts, small_batches, text_slices, words, written

#: Mean words of a chunk, and the fewest words in a row that count as a repeated passage.
MEAN_WORDS, RUN_WORDS = 4, 16
#: Characters outside white space that make a run of fewer words a repeated passage too: text without white space has no words to count.
RUN_CHARS = 100
#: Runs of over LONG_WORD bytes without white space are cut at characters too, one in CHAR_MEAN on average.
LONG_WORD, CHAR_MEAN = 64, 24
GEAR_BYTES = 16
_GEAR = (mix(np.arange(256, dtype=np.uint64) + U(0x6765)) & U(0xFFFF)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash h = (h << 1) + G[byte] at every byte; 16 bits wide, so it depends on 16 bytes."""
    h = _GEAR[data]
    step = 1
    while step < GEAR_BYTES:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint16(step)
        h, step = longer, 2 * step
    return h


def cuts(data: np.ndarray, offs: np.ndarray, mean_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk starts over the slice, and where each row's chunks begin.

    A chunk starts at a word where the gear hash of the bytes before it is low. In a run of over LONG_WORD bytes
    without white space it may start at any character, by a stricter bound. Both depend on the content near by
    alone, so an insertion moves no cut but its own. The first GEAR_BYTES bytes of a row get no cut: their hash reaches
    into the row before, which is another one whenever rows are dealt otherwise.
    """
    n = len(data)
    start, end, _ = words(data, offs)
    first = row_starts(n, offs)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    h = (gear(data).astype(np.uint32) * np.uint32(40503)) & np.uint32(0xFFFF)
    at = np.zeros(n, bool)
    inner = start[start > 0]
    at[inner[h[inner - 1] < 65536 // mean_words]] = True
    wide = end - start > LONG_WORD
    if wide.any():
        edge = np.zeros(n + 1, np.int8)
        edge[start[wide] + 1] += 1
        edge[end[wide]] -= 1
        inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool) & ((data & 0xC0) != 0x80)
        at[1:] |= inside[1:] & (h[:-1] < 65536 // CHAR_MEAN)
    early = np.zeros(n + GEAR_BYTES, bool)
    for k in range(GEAR_BYTES):
        early[offs[:-1] + k] = True
    at &= ~early[:n]
    at |= first
    begin = np.flatnonzero(at)
    return begin, np.searchsorted(begin, offs)


def unit_digests(data: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit BLAKE2b digests of the units of a slice, and where each row's units begin.

    A unit is a chunk and the next one of its row, without the white space at its end; a row of one chunk has that as
    its unit. A digest that two texts share by chance marks one unit, which alone is too short to go.
    """
    raw, n = data.tobytes(), np.diff(at)
    units = np.maximum(n - 1, np.minimum(n, 1))
    unit_at = np.concatenate(([0], np.cumsum(units)))
    row = np.repeat(np.arange(len(n)), units)
    first = at[:-1][row] + np.arange(len(row)) - unit_at[:-1][row]
    stops = np.append(begin, len(raw))
    ends = stops[np.minimum(first + 2, at[1:][row])]
    digests = [hashlib.blake2b(raw[a:b].rstrip(b" \t\n\x0b\x0c\r"), digest_size=8).digest() for a, b in zip(begin[first].tolist(), ends.tolist())]
    return np.frombuffer(b"".join(digests), np.int64), unit_at


def _units(mean_words: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = arrow_rows(batch, "doc_id").to_numpy(zero_copy_only=False)
            for i, j, data, offs in text_slices(batch, "text"):
                begin, at = cuts(data, offs, mean_words)
                if not len(begin):
                    continue
                d, unit_at = unit_digests(data, begin, at)
                if not whole:
                    yield pa.record_batch([pa.array(d)], ["digest"])
                    continue
                n = np.diff(unit_at)
                idx = np.arange(len(d)) - np.repeat(unit_at[:-1], n)
                yield pa.record_batch([pa.array(d), pa.array(np.repeat(ids[i:j], n)).cast(pa.int64()), pa.array(idx.astype(np.int32))], ["digest", "doc_id", "idx"])

    return run


OUT = "doc_id long, text string, n_words long, n_words_before long, n_chunks long, n_repeated_chunks long, removed_words long, removed_spans array<struct<start:long,end:long>>"


def _n_words(text: str) -> int:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return len(words(data, np.array([0, len(data)]))[0])


def _remove(mean_words: int, run_words: int, run_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = arrow_rows(batch, "doc_id")
            texts = arrow_rows(batch, "text")
            repeated = arrow_rows(batch, "__repeated")
            for i, j, data, offs in text_slices(batch, "text"):
                begin, at = cuts(data, offs, mean_words)
                start, _, word_at = words(data, offs)
                solid = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])))
                rows = []
                for k in range(j - i):
                    mine, lo, hi = begin[at[k] : at[k + 1]], offs[k], offs[k + 1]
                    said = repeated[i + k].as_py()
                    spans, gone, hits = [], 0, 0
                    if said and len(mine):
                        ends = np.append(mine[1:], hi)
                        raw = data[lo:hi].tobytes()
                        own, _ = unit_digests(data[lo:hi], mine - lo, np.array([0, len(mine)]))
                        is_rep = np.zeros(len(mine) + 2, bool)
                        for x in said:
                            at_x = x["idx"]  # a row that repeats an id with another text may not have this unit
                            if at_x < len(own) and own[at_x] == x["digest"]:
                                is_rep[at_x + 1 : min(at_x + 2, len(mine)) + 1] = True
                        hits = int(is_rep.sum())
                        edge = np.flatnonzero(is_rep[1:] != is_rep[:-1])
                        for a, b in zip(edge[::2], edge[1::2]):
                            s, e = int(mine[a]), int(ends[b - 1])
                            n = int(np.searchsorted(start, e) - np.searchsorted(start, s))
                            if n >= run_words or solid[e] - solid[s] >= run_chars:
                                spans.append((s - int(lo), e - int(lo)))
                                gone += n
                    text, before = texts[i + k].as_py(), int(word_at[k + 1] - word_at[k])
                    if spans:
                        kept, last = [], 0
                        for s, e in spans:
                            kept.append(raw[last:s])
                            last = e
                        text = b"".join([*kept, raw[last:]]).decode("utf-8")
                        # spans are told in code points
                        chars = np.concatenate(([0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)))
                        spans = [{"start": int(chars[s]), "end": int(chars[e])} for s, e in spans]
                    rows.append({"doc_id": ids[i + k].as_py(), "text": text, "n_words": _n_words(text) if spans else before, "n_words_before": before, "n_chunks": len(mine), "n_repeated_chunks": hits, "removed_words": gone, "removed_spans": spans})
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_words_before", pa.int64()), ("n_chunks", pa.int64()), ("n_repeated_chunks", pa.int64()), ("removed_words", pa.int64()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def repeated_chunks(docs: DataFrame, mean_words: int = MEAN_WORDS) -> DataFrame:
    """doc_id and its units that an earlier (doc_id, place) has too, as (idx, digest).

    A first pass counts digests alone, summed before the shuffle; only units whose digest occurs more than once are then
    told apart by place. These, the digests, and the first place of each are written out before they meet, so the joins stand on
    exchanges of their own, which adaptive execution splits where a third of the documents hold a passage.
    """
    named = docs.where("doc_id is not null")
    often = named.mapInArrow(_units(mean_words, False), "digest long").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    every = named.mapInArrow(_units(mean_words, True), "digest long, doc_id long, idx int")
    with small_batches(docs.sparkSession):
        often = written(often, "often-digests")
        some = written(every.join(often.hint("merge"), "digest"), "repeated-units")
    first = written(some.groupBy("digest").agg(F.min(F.struct("doc_id", "idx")).alias("first")), "first-units")
    later = some.join(first.hint("merge"), "digest").where("struct(doc_id, idx) <> first")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("idx", "digest")).alias("__repeated"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_words: int = MEAN_WORDS, run_words: int = RUN_WORDS, run_chars: int = RUN_CHARS) -> DataFrame:
    """Take out passages that an earlier document, or an earlier place of the same one, has already.

    Texts are cut into variable chunks by a gear hash; a unit of two chunks is repeated if its digest
    occurs at an earlier (doc_id, place). Chunks in a row that repeated units cover go if they hold at least `run_words` words together,
    or `run_chars` code points outside white space, so stock phrases and single lines stay and text without white space
    is not spared. Returns doc_id, the text that is left, n_words (of that text), n_words_before (of the whole one), n_chunks,
    n_repeated_chunks (those that repeated units cover), removed_words (those that begin in what went; none
    inside a longer unspaced run) and removed_spans (code points of the original, end exclusive).

    A null text stays null, an empty or wordless one stays as it is. Rows without an id neither claim nor lose
    passages. Rows that repeat a doc_id with the same text count as one place and are treated alike. An empty table gives an
    empty result; columns besides the two are not read. A very long text is held whole by one task, with some arrays of its length.
    """
    docs = id_and_text(docs, id_col, text_col)
    marks = repeated_chunks(docs, mean_words)
    return docs.join(marks.hint("merge"), "doc_id", "left").mapInArrow(_remove(mean_words, run_words, run_chars), OUT)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: the text that is left, its words, and what went."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def repeats_removed(docs: DataFrame) -> DataFrame:
    """The documents, all columns in place whatever their names, with repeated passages taken out of their text.

    Nulls, empty texts and rows that repeat an id as in remove_repeats().
    """
    names = docs.columns
    marks = repeated_chunks(id_and_text(docs))
    inner = _remove(MEAN_WORDS, RUN_WORDS, RUN_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for part in inner(iter([batch])) for t in part.column("text").to_pylist()]
            rows = arrow_rows(batch, "_row")
            cols = [pa.array(texts, c.type) if name == "text" else c for name, c in zip(names, rows.flatten())]
            yield pa.record_batch(cols, names)

    packed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.struct(*[docs[c] for c in names]).alias("_row"))
    return packed.join(marks.hint("merge"), "doc_id", "left").mapInArrow(run, docs.schema)
