"""Periodic runs of words: dyadic catchers over completed blocks find squares, squares merge into runs.

The blocks of length L = 1, 2, 4, ... lie at multiples of L. The catcher of a block waits for the block to come again p
words later, 2L <= p < 4L (1 <= p < 4 for L = 1). Every square of period p holds such a block in its left half, so none
escapes. A further block that is complete advances the comparison of all catchers of its level by L words: where the next
block comes again at the same distance too, the square before it grows, and the squares of a distance are one run when
the comparison stops. Its two ends are found word by word. The catchers of a level are independent of each other, so
they stand side by side in one array, and their comparisons advance together, a block of words at a time instead of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import U, arrow_rows, hash_spans, id_and_text, mix, text_slices, words

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Cells of one comparison of blocks with the words behind them.
CELLS = 1 << 22
COLUMNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def _chains(marks: np.ndarray, size: int, chain: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last block, and distance, of the squares of one level: `chain` blocks in a row, or more, that come again at one distance.

    marks: hashes of the windows of `size` words, with as many behind the last block as a distance may be.
    """
    near = np.arange(1, 4) if size == 1 else np.arange(2 * size, 4 * size)
    step, found = max(chain + 1, CELLS // len(near)), []
    for lo in range(0, blocks - chain + 1, step):
        n = min(step + chain - 1, blocks - lo)  # with some blocks of the next part, so that each chain begins whole somewhere
        behind = np.lib.stride_tricks.as_strided(marks[lo * size + int(near[0]) :], (n, len(near)), (8 * size, 8), writeable=False)
        same = behind == marks[lo * size : (lo + n - 1) * size + 1 : size, None]
        whole = same[: n - chain + 1]
        for k in range(1, chain):
            whole = whole & same[k : n - chain + 1 + k]
        row, col = np.divmod(np.flatnonzero(whole), len(near))
        found.append((col, row + lo))
    col, row = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, col))
    col, row = col[order], row[order]
    new = np.ones(len(col), bool)
    new[1:] = (col[1:] != col[:-1]) | (row[1:] != row[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(col))[: len(first)] - 1
    return row[first], row[last] + chain - 1, near[col[first]]


def runs_of(ids: np.ndarray, at: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, end, smallest period) of the runs in a sequence of 64-bit word ids, whose rows begin at `at`; in order.

    Takes time and memory in proportion to words times levels, also where all words are the same: a chain of blocks that
    lies within a known run is that run again by a multiple of its period, and goes.
    """
    periods, keep, size = max(2, periods), np.zeros((0, 3), np.int64), 1
    length = np.diff(at)
    long = length >= max(least, periods)
    start, length = at[:-1][long], length[long]
    # the words of the rows that are long enough, with a mark of its own behind each row, which equals no word and no other mark
    offs = np.concatenate(([0], np.cumsum(length + 1)))
    base = np.arange(offs[-1]) - np.repeat(offs[:-1] - start, length + 1)
    edge = np.zeros(offs[-1], bool)
    edge[offs[1:] - 1] = True
    seq = np.where(edge, mix(base.astype(np.uint64) ^ U(0xABCDEF << 32)), ids[np.minimum(base, len(ids) - 1)] if len(ids) else U(0))
    marks = seq
    while len(length):
        chain = 2 * (periods - 1) - 1 if size > 1 else min(2 * (periods - 1) - 1, max(least, periods) - 1)
        blocks = (len(seq) - 1) // size
        if blocks >= chain:
            padded = np.concatenate((marks, mix(np.arange(5 * size + 1, dtype=np.uint64) + U(0x5EED << 32))))
            a, b, p = _chains(padded, size, chain, blocks)
            lo, hi = a * size, (b + 1) * size
            stop = offs[np.searchsorted(offs, lo, "right")] - 1
            ok = hi + p <= stop  # else the block comes again in another row
            order = np.argsort(keep[:, 0], kind="stable")
            if len(order):
                reach, k = np.maximum.accumulate(keep[order, 1]), np.searchsorted(keep[order, 0], base[lo], "right") - 1
                ok &= (k < 0) | (reach[np.maximum(k, 0)] < base[hi - 1] + 1 + p)
            lo, hi, p, stop = lo[ok], hi[ok], p[ok], stop[ok]
            lo, hi = _widened(seq, lo, hi, p, size, offs[np.searchsorted(offs, lo, "right") - 1], stop)
            good = hi - lo + p >= np.maximum(least, periods * p)
            lo, hi, p = lo[good], hi[good], p[good]
            keep = np.concatenate((keep, np.stack((base[lo], base[hi - 1] + 1 + p, p), axis=1)))
            keep = keep[np.lexsort((keep[:, 2], keep[:, 1], keep[:, 0]))]
            again = np.zeros(len(keep), bool)
            again[1:] = (keep[1:, :2] == keep[:-1, :2]).all(axis=1)
            keep = keep[~again]
        more = length >= 4 * size * periods  # the next level's periods begin at four times this size
        marks, here = _doubled(marks, size), np.repeat(more, length + 1)
        marks, seq, base, length, size = marks[here], seq[here], base[here], length[more], 2 * size
        offs = np.concatenate(([0], np.cumsum(length + 1)))
    return keep[np.lexsort((keep[:, 2], keep[:, 0]))]


def _doubled(marks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of twice as many words; those that reach over the end of the sequence match nothing."""
    behind = np.empty_like(marks)
    behind[:-size] = marks[size:]
    behind[-size:] = mix(np.arange(min(size, len(marks)), dtype=np.uint64) + U(0xFEED << 32))
    return mix(marks * U(0x9E3779B97F4A7C15) + behind)


def _widened(seq: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, size: int, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [lo, hi) of words that come again p later, moved out word by word to where that ends; less than `size` words on each side."""
    lo, hi = lo.copy(), hi.copy()
    left = right = np.ones(len(lo), bool)
    for _ in range(size - 1):
        if left.any():
            k = np.flatnonzero(left & (lo > first))
            k = k[seq[lo[k] - 1] == seq[lo[k] - 1 + p[k]]]
            lo[k] -= 1
            left = np.zeros(len(lo), bool)
            left[k] = True
        if right.any():
            k = np.flatnonzero(right & (hi + p < stop))
            k = k[seq[hi[k]] == seq[hi[k] + p[k]]]
            hi[k] += 1
            right = np.zeros(len(lo), bool)
            right[k] = True
        if not (left.any() or right.any()):
            break
    return lo, hi


def _repeats(w: list[bytes], start: int, end: int, period: int) -> bool:
    """Whether the words themselves, not their hashes alone, keep the period."""
    return w[start : end - period] == w[start + period : end]


def _searched(edit: bool, least: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, plan = arrow_rows(batch, "doc_id"), arrow_rows(batch, "h").to_numpy(zero_copy_only=False) if edit else None
            for i, j, data, offs in text_slices(batch, "text"):
                start, end, at = words(data, offs)
                at = at.astype(np.int64)
                pick = np.arange(len(start))
                if edit:
                    for r in range(j - i):
                        n, h = int(at[r + 1] - at[r]), plan[i + r]
                        if n and h == h and int(h) % 10 == 0:  # not null
                            g = int(h) // 10
                            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                            pick[at[r] + a : at[r + 1]] = at[r] + a + np.arange(n - a) % p
                hashes = hash_spans(data, start, end)[pick]
                found = runs_of(hashes, at, least, periods)
                per = np.searchsorted(found[:, 0], at)
                raw, runs, texts = data.tobytes(), [], []
                for r in range(j - i):
                    mine, lo, hi = found[per[r] : per[r + 1]], int(at[r]), int(at[r + 1])
                    text = raw[offs[r] : offs[r + 1]]
                    w = text.split()  # the same white space, in bytes
                    if hi > lo and pick[hi - 1] != hi - 1 or len(mine):
                        w = [w[k - lo] for k in pick[lo:hi].tolist()]
                        if not all(_repeats(w, s - lo, e - lo, q) for s, e, q in mine.tolist()):  # two words of one hash: number the words instead
                            number: dict[bytes, int] = {}
                            exact = mix(np.array([number.setdefault(x, len(number)) for x in w], np.uint64))
                            mine = runs_of(exact, np.array([0, hi - lo]), least, periods) + [lo, lo, 0]
                        gone = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(gone, mine[:, 0] + mine[:, 2] - lo, 1)
                        np.add.at(gone, mine[:, 1] - lo, -1)
                        drop = np.cumsum(gone[:-1]) > 0
                        w = [x for x, d in zip(w, drop.tolist()) if not d]
                    runs.append([{"start": s - lo, "length": e - s, "period": q} for s, e, q in mine.tolist()])
                    texts.append(b" ".join(w))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.record_batch([ids.slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, edited: bool = False) -> DataFrame:
    """The runs of each text, by start, then period, and the text without its repeats: doc_id, n_words, runs, collapsed (UTF-8).

    A run is a stretch of words with smallest period q and at least max(least_words, least_periods * q) words (two periods
    at least) that no neighbouring word extends keeping q. A word goes from the collapsed text if a run holds it after
    that run's first q words; the others are joined by one space. `edited` replaces the words of a tenth of the documents
    by a periodic tail first, by the checksum of their id, so that tests have long runs.

    Null, empty and wordless texts have no run and an empty collapsed text. Rows without an id and rows that repeat one are
    searched as any other (without an id nothing is edited); an empty table gives an empty result; columns besides the
    two are not read. A very long text is held by one task with about a hundred bytes for each word of its own.
    """
    rows = id_and_text(docs, id_col, text_col)
    if edited:
        rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")).cast("double"))
    return rows.mapInArrow(_searched(edited, least_words, least_periods), COLUMNS)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_runs, the run with the greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edited=True)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    wide = lambda x: x.cast("decimal(18,0)")  # noqa: E731  products of two longs are exact
    first = lambda a, b: (wide(a["length"]) * wide(b["period"]) > wide(b["length"]) * wide(a["period"])) | ((wide(a["length"]) * wide(b["period"]) == wide(b["length"]) * wide(a["period"])) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(first(r, x), r).otherwise(x))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: The query in DuckDB: words q apart that are equal, stretches of them on each diagonal, the smallest period of each.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents
), e AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), f AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END + 1]) END AS w
  FROM e
), t AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM f
), same AS (
  SELECT x.r, y.i - x.i AS p, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT r, p, min(i) AS s, max(i) + 1 + p AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM same) GROUP BY r, p, g
), run AS (
  SELECT r, s, e, min(p) AS q FROM stretch WHERE e - s >= greatest(6, 4 * p) GROUP BY r, s, e
), gone AS (
  SELECT r, list_distinct(flatten(list(range(s + q, e)))) AS k FROM run GROUP BY r
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY r
), best AS (
  SELECT a.* FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE a.r = b.r AND ((b.e - b.s) * a.q > (a.e - a.s) * b.q OR ((b.e - b.s) * a.q = (a.e - a.s) * b.q AND (b.s, b.q) < (a.s, a.q))))
)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.e - b.s AS length, b.q AS period, 1000 * (b.e - b.s) // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN k IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(k, i)), lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM f LEFT JOIN told USING (r) LEFT JOIN best b USING (r) LEFT JOIN gone USING (r)
"""
