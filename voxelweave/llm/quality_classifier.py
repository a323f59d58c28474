"""Document quality from random-indexing word vectors and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import SPACE, U, arrow_rows, crc_mod3, hash_spans, id_and_text, mix, row_starts, small_batches, text_slices

#: Rows of the word-vector table, its first ones for the shapes of words; dimensions of a vector.
TABLE, SHAPES, DIMS = 8192, 64, 32
#: At most this many labelled documents train the network.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, SEED = 32, 400, 7

# byte classes: 0 white space, 1 small letter or any byte of a non-ASCII character, 2 capital, 3 digit, 4 symbol
_CLASS = np.full(256, 4, np.int8)
_CLASS[SPACE] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_KIND = np.where(_CLASS == 2, 1, _CLASS)  # capitals and small letters are one kind of run

#: Each table row has a sparse index vector: two dimensions, each with a sign.
_H = mix(np.arange(TABLE, dtype=np.uint64) + U(0xABCDEF))
NONZERO = [(_H % U(DIMS)).astype(np.int64)]
NONZERO.append((NONZERO[0] + 1 + ((_H >> U(8)) % U(DIMS - 1)).astype(np.int64)) % DIMS)  # never the first one again
SIGN = [np.where((_H >> U(40 + k)) & U(1), 1.0, -1.0) for k in range(2)]


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the words and of their shapes, and where each document's begin.

    A word is a run of letters, of digits or of symbols; its row is a hash of its lower-cased bytes. Its shape is the
    kind of run, the case of its letters and its length.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind, first = _KIND[data], row_starts(n, offs)
    turn = first.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(turn)
    end = np.append(start[1:], n)
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = SHAPES + (hash_spans(data, start, end, lower=True) % U(TABLE - SHAPES)).astype(np.int64)
    caps = np.concatenate(([0], np.cumsum(_CLASS[data] == 2)))
    size = end - start
    caps = caps[end] - caps[start]
    case = np.where(caps == 0, 0, np.where(caps == 1, 1, np.where(caps == size, 3, 2)))
    look = np.where(kind[start] == 1, case, kind[start] + 1)  # 0..3 letters, 4 digits, 5 symbols
    shape = look * 8 + np.minimum(size, 8) - 1
    return word, shape, np.searchsorted(start, offs)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's context sums: for each table row the index vectors of the two words before and after it."""
    total = np.zeros(TABLE * DIMS)
    for batch in batches:
        for _, _, data, offs in text_slices(batch, "text"):
            word, shape, at = tokens(data, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
            for ids in (word, shape):
                for step in (1, 2):
                    near = doc[step:] == doc[:-step]
                    a, b = ids[:-step][near], ids[step:][near]
                    for dim, sign in zip(NONZERO, SIGN):
                        for x, y in ((a, b), (b, a)):
                            if len(x):
                                total += np.bincount(x * DIMS + dim[y], weights=sign[y], minlength=TABLE * DIMS)
    table = total.reshape(TABLE, DIMS).astype(np.int64)
    used = np.flatnonzero(table.any(axis=1))
    cols = [pa.array(used)] + [pa.array(table[used, k]) for k in range(DIMS)]
    yield pa.record_batch(cols, ["row", *[f"d{k}" for k in range(DIMS)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(TABLE, DIMS) vectors over the whole corpus: a row's own index vector and its normalised contexts.

    Each task sends at most TABLE rows, which are summed by row; the sum that comes to the driver has TABLE rows
    whatever the size of the corpus.
    """
    names = [f"d{k}" for k in range(DIMS)]
    rows = docs.mapInArrow(_contexts, "row long, " + ", ".join(f"{c} long" for c in names))
    with small_batches(docs.sparkSession):
        got = rows.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    vectors = np.zeros((TABLE, DIMS))
    vectors[got["row"].to_numpy()] = got[names].to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    for dim, sign in zip(NONZERO, SIGN):
        vectors[np.arange(TABLE), dim] += sign / np.sqrt(2)
    return vectors.astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, 2 DIMS): the mean vector of a document's words and that of their shapes; zeros without words."""
    word, shape, at = tokens(data, offs)
    n = np.diff(at)
    out = np.zeros((len(n), 2 * DIMS), np.float32)
    has = np.flatnonzero(n)
    if len(has):
        for k, ids in enumerate((word, shape)):
            out[has, k * DIMS : (k + 1) * DIMS] = np.add.reduceat(vectors[ids], at[:-1][has], axis=0) / n[has, None]
    return out


class Network:
    """Two layers in numpy, trained by Adam on the log loss; probabilities divided by a temperature fitted apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        apart = rng.random(len(y)) < 0.2
        apart &= len(y) >= 50
        t, v = ~apart, apart
        d = z.shape[1]
        p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
        m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        zt, yt = z[t], y[t]
        for epoch in range(1, EPOCHS + 1):
            h = np.maximum(zt @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [zt.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            for q, gr, mm, ss in zip(p, grads, m, s):
                mm *= 0.9
                mm += 0.1 * gr
                ss *= 0.999
                ss += 0.001 * gr * gr
                q -= 0.02 * (mm / (1 - 0.9**epoch)) / (np.sqrt(ss / (1 - 0.999**epoch)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        if v.any():
            raw, best = self.logits(x[v]), None
            for temp in np.geomspace(0.25, 16, 61):
                loss = np.mean(np.logaddexp(0, np.where(y[v] > 0.5, -raw, raw) / temp))
                if best is None or loss < best:
                    best, self.temperature = loss, float(temp)

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.maximum(((x - self.mean) / self.scale) @ p[0] + p[1], 0) @ p[2] + p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def learning_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts and labels of at most `most` labelled documents that are not held out, chosen by a hash of the id.

    A document with several labels takes the highest; null labels teach nothing. The ids are broadcast: at most `most` rows.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality is not null").where(crc_mod3(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(known), "doc_id")


def one_each(rows: DataFrame) -> DataFrame:
    """One row (doc_id, quality, x) an id: where several rows share an id, that with the least features x.

    Each task sends at most a row an id, so what is learnt from is bounded by the number of ids however often one repeats.
    """
    return rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("least")).select("doc_id", "least.quality", "least.x")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | float]:
    """Word vectors of all documents and a network learnt from the labelled ones; a constant if they are of one kind.

    Held-out rows teach nothing. A document with several labels has the highest, rows that repeat an id count once, and
    without any label the constant is 0.5.
    """
    docs = id_and_text(docs)
    vectors = word_vectors(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = arrow_rows(batch, "quality")
            for i, j, data, offs in text_slices(batch, "text"):
                x = pooled(vectors, data, offs)
                yield pa.record_batch([arrow_rows(batch, "doc_id").slice(i, j - i), y.slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    with small_batches(docs.sparkSession):
        got = one_each(learning_rows(docs, labels, most).mapInArrow(features, "doc_id long, quality int, x binary")).toPandas().sort_values("doc_id")
    y = got["quality"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return vectors, float(y[0]) if len(y) else 0.5
    return vectors, Network(np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(y), -1).astype(float), y)


def score(docs: DataFrame, model: tuple[np.ndarray, Network | float]) -> DataFrame:
    """doc_id, score, predicted of every whole text; a null or empty text is scored as one without words.

    Rows that repeat an id or have none are scored each; columns besides the two are not read. An empty table gives an empty
    result. A very long text is held whole by one task, with a hash and a table row for each of its words.
    """
    vectors, network = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = arrow_rows(batch, "doc_id")
            for i, j, data, offs in text_slices(batch, "text"):
                p = np.full(j - i, network) if isinstance(network, float) else network.probability(pooled(vectors, data, offs))
                yield pa.record_batch([ids.slice(i, j - i), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def kept_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns whatever their names, that the classifier does not reject (score at least 0.5).

    Null and empty texts are judged as texts without words; rows that repeat an id are judged each by their own text.
    """
    vectors, network = fit(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, j, data, offs in text_slices(batch, "text"):
                keep[i:j] = network >= 0.5 if isinstance(network, float) else network.probability(pooled(vectors, data, offs)) >= 0.5
            yield batch.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (F.coalesce(crc_mod3(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "score", "predicted")
