"""Quality rules: counted features against fixed limits, then a calibrated n-gram regression against a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelweave.llm.common import U, arrow_rows, hash_spans, id_and_text, mix, small_batches, text_slices, words
from voxelweave.llm.quality_classifier import learning_rows, one_each

#: Hashed dimensions (half for words and pairs of words, half for character n-grams), and labelled rows at most.
DIMS, TRAIN_ROWS = 4096, 6000
HALF = DIMS // 2
THRESHOLD = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngrams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, DIMS): the share of each hashed word and word pair, and of each hashed run of 3 and 4 bytes."""
    start, end, at = words(data, offs)
    n_docs = len(offs) - 1
    w = hash_spans(data, start, end)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    total = np.zeros(n_docs * DIMS)

    def count(rows: np.ndarray, hashes: np.ndarray, base: int) -> None:
        if len(rows):
            total[:] += np.bincount(rows * DIMS + base + (hashes % U(HALF)).astype(np.int64), minlength=n_docs * DIMS)

    count(doc, w, 0)
    same = doc[1:] == doc[:-1]
    count(doc[1:][same], mix(w[:-1] * U(3) + w[1:])[same], 0)
    place = np.repeat(np.arange(n_docs), np.diff(offs))
    b = data.astype(np.uint64)
    for size in (3, 4):
        if len(b) >= size:
            g = b[: len(b) - size + 1].copy()
            for k in range(1, size):
                g = (g << U(8)) | b[k : len(b) - size + 1 + k]
            same = place[: len(g)] == place[size - 1 :]
            count(place[: len(g)][same], mix(g + U(size << 40))[same], HALF)
    x = total.reshape(n_docs, 2, HALF)
    x /= np.maximum(x.sum(axis=2, keepdims=True), 1)
    return x.reshape(n_docs, DIMS)


def base_features(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    start, end, at = words(data, offs)
    n = np.diff(at)
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    char = sums((data & 0xC0) != 0x80)
    per_word = np.concatenate(([0], np.cumsum(char[end] - char[start])))
    symbol = sums(SYMBOLS[data])
    dup, rep = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    w = hash_spans(data, start, end)
    tri = mix(w[:-2] + w[1:-1] * U(0x9E3779B97F4A7C15) + w[2:] * U(0xC2B2AE3D27D4EB4F)) if len(w) > 2 else w[:0]
    raw = data.tobytes()
    for k in range(len(n)):
        a, b = at[k], at[k + 1]
        if not n[k]:
            continue
        lines = [x for x in raw[offs[k] : offs[k + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup[k] = len(lines) - len(set(lines))
        if b - a >= 3:
            _, which, count = np.unique(tri[a : b - 2], return_inverse=True, return_counts=True)
            if len(count) < b - a - 2:
                twice = np.flatnonzero(count[which] > 1)
                covered = np.zeros(b - a, bool)
                for s in range(3):
                    covered[twice + s] = True
                rep[k] = covered.sum()
    return {"n_words": n, "word_chars": per_word[at[1:]] - per_word[at[:-1]], "n_symbols": symbol[offs[1:]] - symbol[offs[:-1]], "n_dup_lines": dup, "n_repeat_words": rep}


class Regression:
    """Logistic regression on scaled n-gram shares, by Adam with a ridge; Platt-calibrated on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 3e-4, epochs: int = 200):
        rng = np.random.default_rng(11)
        apart = (rng.random(len(y)) < 0.2) & (len(y) >= 50)
        x = np.sqrt(x)
        self.mean, self.scale = x.mean(axis=0), np.float32(1) / (x.std(axis=0) + np.float32(1e-3))
        z, t = (x - self.mean) * self.scale, y[~apart]
        zt = z[~apart]
        w, c = np.zeros(z.shape[1], np.float32), 0.0
        m, s, mc, sc = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for k in range(1, epochs + 1):
            g = (1 / (1 + np.exp(-np.clip(zt @ w + c, -30, 30))) - t).astype(np.float32) / len(t)
            gw, gc = zt.T @ g + ridge * w, float(g.sum())
            m, s, mc, sc = 0.9 * m + 0.1 * gw, 0.999 * s + 0.001 * gw * gw, 0.9 * mc + 0.1 * gc, 0.999 * sc + 0.001 * gc * gc
            w -= 0.005 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
            c -= 0.005 * (mc / (1 - 0.9**k)) / (np.sqrt(sc / (1 - 0.999**k)) + 1e-8)
        self.w, self.c, self.a, self.b = w, c, 1.0, 0.0
        if apart.any() and len(set(y[apart])) == 2:
            raw, goal, best = z[apart] @ w + c, y[apart], np.inf
            for slope in np.geomspace(0.05, 5, 41):  # a grid has no step to go astray
                logit = slope * raw[:, None] + np.linspace(-6, 6, 49)
                loss = np.logaddexp(0, np.where(goal[:, None] > 0.5, -logit, logit)).mean(axis=0)
                if loss.min() < best:
                    best, self.a, self.b = loss.min(), float(slope), float(np.linspace(-6, 6, 49)[loss.argmin()])

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = ((np.sqrt(x) - self.mean) * self.scale) @ self.w + self.c
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Regression | float:
    """A regression learnt from at most `most` labelled documents that are not held out; a constant if all are alike.

    A document with several labels has the highest, rows that repeat an id count once, and without any label all pass.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text", 1 << 19):
                x = ngrams(data, offs).astype(np.float16)
                yield pa.record_batch([arrow_rows(batch, "doc_id").slice(i, j - i), arrow_rows(batch, "quality").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    with small_batches(docs.sparkSession):
        got = one_each(learning_rows(id_and_text(docs), labels, most).mapInArrow(features, "doc_id long, quality int, x binary")).toPandas().sort_values("doc_id")
    y = got["quality"].to_numpy().astype(np.float32)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 1.0
    return Regression(np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(y), -1).astype(np.float32), y)


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def judge(docs: DataFrame, model: Regression | float, threshold: float = THRESHOLD, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The counted features of every whole text, base_failed, the probability of good quality, and kept.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of them in three-word windows that
    the text has twice. kept: not base_failed, and the probability reaches the threshold. A null or empty text has no words and
    fails. Rows that repeat an id or have none are judged each; columns besides the two are not read. An empty table gives an
    empty result. A very long text is held whole by one task, with some hashes for each of its words and bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = arrow_rows(batch, "doc_id")
            for i, j, data, offs in text_slices(batch, "text", 1 << 19):
                f = base_features(data, offs)
                failed = (f["n_words"] < least_words) | (100 * f["n_repeat_words"] > most_repeated * f["n_words"])
                p = np.full(j - i, model) if isinstance(model, float) else model.probability(ngrams(data, offs)).astype(float)
                yield pa.record_batch([ids.slice(i, j - i), *[pa.array(f[c].astype(np.int64)) for c in f], pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= threshold))], ["doc_id", *f, "base_failed", "quality", "kept"])

    return id_and_text(docs).mapInArrow(run, OUT)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: the counted features, base_failed, quality and kept."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, fit(docs, labels))
