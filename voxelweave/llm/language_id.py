"""Language of every span of a text: script ranges narrow the candidates, per-word scores and a switching penalty decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import SLICE_BYTES, U, arrow_rows, crc_mod3, id_and_text, mix, small_batches, text_slices, words

#: Hashed byte n-grams of each of the two lengths.
TABLE, SIZES = 8192, (3, 4)
SCRIPTS = 12
ROWS = TABLE * len(SIZES) + SCRIPTS
#: What a change of language costs, in units of a word's log score.
SWITCH = 12.0
#: A language uses a script if at least this share of its learning words does.
SCRIPT_SHARE = 0.01
OFF_SCRIPT = -40.0
UNKNOWN = "und"
#: Cells (bytes or words times languages) of float that one block of scores has at most.
CELLS = 1 << 22
#: Values of lang from which slices are cut smaller.
FEW = 8

# Code points (first, last) by script. 1 Latin, 2 Greek and Coptic, 3 Cyrillic, 4 Armenian and Hebrew,
# 5 Arabic, 6 Indic, 7 Thai to Georgian, 8 kana, 9 Han, 10 Hangul; any other letter is of script 11, what is no letter of 0
RANGES = {
    1: [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xAB30, 0xAB64), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    2: [(0x370, 0x3FF), (0x1F00, 0x1FFF), (0x2C80, 0x2CFF)],
    3: [(0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)],
    4: [(0x530, 0x5FF), (0xFB13, 0xFB4F)],
    5: [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    6: [(0x900, 0xDFF)],
    7: [(0xE00, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    8: [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    9: [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
    10: [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)],
}
_SCRIPT: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """The script of every code point: 0 where it is no letter, else that of its range."""
    if not _SCRIPT:
        table = np.full(0x110000, 11, np.int8)
        for script, ranges in RANGES.items():
            for first, last in ranges:
                table[first : last + 1] = script
        table[~np.fromiter((chr(c).isalpha() for c in range(len(table))), bool, len(table))] = 0
        _SCRIPT.append(table)
    return _SCRIPT[0]


def scripts_of(data: np.ndarray) -> np.ndarray:
    """For each byte the script of the character that begins there; 0 within a character."""
    table = script_table()
    out = np.where(data < 0x80, table[:128][data & 0x7F], np.int8(0))
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        tail = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32)
        first = tail[lead]
        b1, b2, b3 = (tail[lead + k] & 0x3F for k in (1, 2, 3))
        two, three = (first & 0x1F) << 6 | b1, (first & 0xF) << 12 | b1 << 6 | b2
        four = (first & 0x7) << 18 | b1 << 12 | b2 << 6 | b3
        out[lead] = table[np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))]
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


class Features:
    """Word spans and scripts of a slice, and its n-gram rows on demand, so that a long text never has all of them at once."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.start, self.end, self.at = words(data, offs)
        self.script = np.zeros(0, np.int64)
        if len(self.start):  # reduceat runs on to the next word; white space between has script 0
            self.script = np.maximum.reduceat(scripts_of(data), self.start).astype(np.int64)
        self.data = data

    def grams(self, a: int, b: int) -> list[np.ndarray]:
        """Table rows of the n-grams at the bytes a..b, for each size. The n-gram at i begins one byte before i, so that a word's first takes in its border."""
        near = self.data[max(a - 1, 0) : b + max(SIZES)]
        w = np.full(b - a + max(SIZES) + 1, 32, np.uint8)
        w[int(a == 0) : int(a == 0) + len(near)] = _FOLD[near][: len(w) - int(a == 0)]
        w, out = w.astype(np.uint64), []
        for k, size in enumerate(SIZES):
            g = w[: b - a].copy()
            for s in range(1, size):
                g = (g << U(8)) | w[s + 1 : s + 1 + b - a]
            out.append(k * TABLE + (mix(g + U(size << 48)) % U(TABLE)).astype(np.int32))
        return out


def places(data: np.ndarray, at: list[int]) -> list[int]:
    """How many characters begin before each of some ascending byte places."""
    out, last, n = [], 0, 0
    for p in at:
        n += int(np.count_nonzero((data[last:p] & 0xC0) != 0x80))
        last = p
        out.append(n)
    return out


def _counts(languages: list[str]):
    code = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([code[x] for x in arrow_rows(batch, "lang").to_pylist()], np.int64)
            for i, j, data, offs in text_slices(batch, "text"):
                f = Features(data, offs)
                if not len(f.start):
                    continue
                here, mine = np.unique(lang[i:j], return_inverse=True)
                of_byte, of_word = np.repeat(mine, np.diff(offs)) * ROWS, np.repeat(mine, np.diff(f.at)) * ROWS
                n = np.bincount(of_word + TABLE * len(SIZES) + f.script, minlength=len(here) * ROWS)
                for a in range(0, len(data), CELLS // 4):
                    b = min(a + CELLS // 4, len(data))
                    for rows in f.grams(a, b):
                        n += np.bincount(of_byte[a:b] + rows, minlength=len(n))
                for x, counts in zip(here.tolist(), n.reshape(len(here), ROWS)):
                    total[x] = total[x] + counts if x in total else counts.copy()
        for x, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.full(len(used), x)), pa.array(used), pa.array(counts[used])], ["lang", "row", "n"])

    return run


class Model:
    """Log probabilities of the n-grams of each language, and the scripts that it uses."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.tables = np.zeros((TABLE * len(SIZES), len(languages)), np.float32)
        for k in range(len(SIZES)):
            c = counts[:, k * TABLE : (k + 1) * TABLE] + 0.5
            # overlapping n-grams tell the same thing several times
            self.tables[k * TABLE : (k + 1) * TABLE] = (np.log(c / c.sum(axis=1, keepdims=True)) / (2 * len(SIZES))).T
        words_in = counts[:, TABLE * len(SIZES) :].astype(float)
        lettered = np.maximum(words_in[:, 1:].sum(axis=1, keepdims=True), 1)
        self.allowed = (words_in / lettered >= SCRIPT_SHARE).T
        self.allowed[0] = True
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, f: Features, first: int = 0, last: int | None = None) -> np.ndarray:
        """(words, languages) of the words first..last: summed log scores less the best possible; 0 for all where a word has no letter.

        N-grams are gathered for a block of bytes at a time; a word that reaches into several adds up what each has of it.
        """
        last = len(f.start) if last is None else last
        start, script = f.start[first:last], f.script[first:last]
        out = np.zeros((last - first, len(self.languages)), np.float32)
        stop = int(f.start[last]) if last < len(f.start) else len(f.data)
        step = max(1 << 12, CELLS // len(self.languages))
        a = int(start[0]) if len(start) else stop
        while a < stop:
            b = min(a + step, stop)
            lo, hi = int(np.searchsorted(start, a, "right")), int(np.searchsorted(start, b, "left"))
            if b < stop and hi - lo > 1:  # whole words, if there are such
                hi -= 1
                b = int(start[hi])
            first_rows, *more = f.grams(a, b)
            s = self.tables[first_rows]
            for rows in more:
                s += self.tables[rows]
            out[lo - 1 : hi] += np.add.reduceat(s, np.concatenate(([0], start[lo:hi] - a)), axis=0)
            a = b
        out[script == 0] = 0
        out[~self.allowed[script]] += OFF_SCRIPT
        out -= out.max(axis=1, keepdims=True)
        return out


def viterbi(s: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The language of each word that makes the highest sum of scores less `penalty` a switch.

    One language throughout is the best path if no stretch of words gains more than half a penalty in any other; this
    is tested first, as most texts are in one language.
    """
    n, k = s.shape
    c = int(s.sum(axis=0).argmax())
    gain = np.cumsum(s - s[:, c : c + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, k)), gain[:-1])), axis=0)
    if (gain - low).max(initial=0) <= penalty / 2:
        return np.full(n, c)
    back = np.zeros((n, k), np.int32)
    best = s[0].astype(np.float64)
    stay = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - penalty
        move = jump > best
        back[t] = np.where(move, top, stay)
        best = np.where(move, jump, best) + s[t]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def viterbi_blocks(scores, n: int, k: int, words_each: int, penalty: float = SWITCH) -> np.ndarray:
    """viterbi() of n words whose scores come by scores(a, b) for a block of words, with a block in memory at a time.

    Sums and gains are carried from block to block; the path is found backwards, each block worked out again from the best
    sums at its beginning, which alone are kept.
    """
    at = [(a, min(a + words_each, n)) for a in range(0, n, words_each)]
    if len(at) < 2:
        return viterbi(scores(0, n), penalty)
    c = int(sum(scores(a, b).sum(axis=0, dtype=np.float64) for a, b in at).argmax())
    gain, low, most = np.zeros(k), np.zeros(k), 0.0
    for a, b in at:
        s = scores(a, b)
        g = gain + np.cumsum(s - s[:, c : c + 1], axis=0, dtype=np.float64)
        lows = np.minimum(low, np.minimum.accumulate(np.concatenate((gain[None], g[:-1])), axis=0))
        most = max(most, float((g - lows).max()))
        gain, low = g[-1], np.minimum(lows[-1], g[-1])
    if most <= penalty / 2:
        return np.full(n, c)

    def forward(best, a, b, back=None):
        s, stay = scores(a, b), np.arange(k)
        for t in range(b - a):
            if a + t == 0:
                best = s[0].astype(np.float64)
                continue
            top = int(best.argmax())
            jump = best[top] - penalty
            move = jump > best
            if back is not None:
                back[t] = np.where(move, top, stay)
            best = np.where(move, jump, best) + s[t]
        return best

    best, kept = None, []
    for a, b in at:
        kept.append(best)
        best = forward(best, a, b)
    path = np.zeros(n, np.int32)
    path[-1] = best.argmax()
    for (a, b), begin in zip(reversed(at), reversed(kept)):
        back = np.zeros((b - a, k), np.int32)
        forward(begin, a, b, back)
        for t in range(b - 1, max(a - 1, 0), -1):
            path[t - 1] = back[t - a, path[t]]
    return path


def learn(docs: DataFrame) -> Model | None:
    """A model of all documents with text and language whose id is not held out; None where there are none.

    All values of lang are learnt. Rows that repeat an id all count; empty
    texts teach nothing. Every task sends its counts by language and n-gram row; these are summed by key, and what comes to the driver has
    languages x ROWS rows at most, whatever the size of the corpus.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(crc_mod3(F.col("doc_id")) != 1).select("text", "lang")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    with small_batches(docs.sparkSession):
        counted = rows.mapInArrow(_counts(languages), "lang long, row long, n long")
        got = counted.groupBy("lang", "row").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), ROWS))
    counts[got["lang"].to_numpy(), got["row"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def _lettered(text: str) -> bool:
    return any(c.isalpha() for c in text)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def _label(model: Model | None, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list, list, list]]:
    """For slices of a batch: language, score and spans (code points) of each row."""
    k = len(model.languages) if model else 1
    for i, j, data, offs in text_slices(batch, "text", max(1 << 14, SLICE_BYTES * FEW // max(FEW, k))):
        f = Features(data, offs)
        lang, score, spans = [UNKNOWN] * (j - i), [0.0] * (j - i), [[] for _ in range(j - i)]
        block = max(1, CELLS // k)
        scores = model.word_scores(f) if model and 0 < len(f.start) <= block else None
        size = (f.end - f.start).astype(float)
        for r in range(j - i):
            a, b = int(f.at[r]), int(f.at[r + 1])
            scripts = f.script[a:b]
            if model is None or not scripts.any():  # no letter
                continue
            if scores is not None:
                mine = scores[a:b]
                path, total = viterbi(mine), None
            else:  # a long text, of which a block of words is scored at a time
                mine = None
                path = viterbi_blocks(lambda x, y: model.word_scores(f, a + x, a + y), b - a, k, block)  # noqa: B023
            weight = np.bincount(path, weights=size[a:b] * (scripts > 0), minlength=k)
            best = int(weight.argmax())
            if mine is not None:
                total = mine[path == best].sum(axis=0)
            else:
                total = sum(model.word_scores(f, a + x, min(a + x + block, b))[path[x : x + block] == best].sum(axis=0) for x in range(0, b - a, block))
            sure = 1 / np.exp(np.clip(total - total[best], -50, 50)).sum()
            lang[r], score[r] = model.languages[best], float(np.clip(weight[best] / weight.sum() * sure, 0, 1))
            turns = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [b - a]))
            edges = [p for x, y in zip(turns[:-1], turns[1:]) for p in (int(f.start[a + x]), int(f.end[a + y - 1]))]
            chars = places(data[offs[r] : offs[r + 1]], [p - int(offs[r]) for p in edges])
            spans[r] = [{"start": chars[2 * n], "end": chars[2 * n + 1], "lang": model.languages[path[x]]} for n, x in enumerate(turns[:-1])]
        yield i, j, lang, score, spans


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (array of start, end, lang; code points) of every whole text.

    The language is the one that most of the letters' words were labelled with; the score is its share of them times
    how sure those words are against the other languages. `und` with score 0 where the text is null or has no letter (of
    any script), or where nothing could be learnt. Ties go to the first language by name. Rows that repeat an id or have
    none are labelled each; columns besides the two are not read. An empty table gives an empty result. Of a very long text
    words are scored, and paths kept, a block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, lang, score, spans in _label(model, batch):
                yield pa.record_batch([arrow_rows(batch, "doc_id").slice(i, j - i), pa.array(lang), pa.array(score), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "lang_pred", "score", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def kept_by_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns whatever their names, whose language is known with a score of at least `least`.

    The model is learnt from the documents themselves. Where nothing can be learnt all lettered texts stay. Null, empty
    and letterless texts go; rows that repeat an id are judged each by their own text.
    """
    model, names = learn(docs), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, j, lang, score, _ in _label(model, batch):
                keep[i:j] = [x >= least and y != UNKNOWN for x, y in zip(score, lang)]
            if model is None:
                keep = np.array([bool(t) and _lettered(t) for t in arrow_rows(batch, "text").to_pylist()], bool)
            yield batch.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and n_spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    held = (F.coalesce(crc_mod3(F.col("doc_id")), F.lit(0)) == 1).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", F.size("spans").alias("n_spans"))
