"""Approximate nearest neighbours by inner product: balanced posting lists, found over a graph of their centroids.

The largest inner product is the smallest distance once every vector has one more component that brings it to the same
length (the longest one's), and every query is scaled to that length. A bounded sample is split into lists of equal
size; each vector goes into the list of its nearest centroid and, if it lies near a border, into those of others as well.
A query searches the graph of centroids that each task holds in memory, leaves out lists whose centroids are more than
`reach` times as far as the nearest one, and compares itself with all vectors of the lists that are left. How far it has
to reach is measured: a bounded number of queries is held against all vectors, and the ratio is taken at which nearly all
of their true neighbours are found. Where vectors lie in clusters that is a few lists, where they are noise it is many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from voxelweave.llm.common import arrow_rows, written

#: Distinct vectors of a list on average, and the most lists; the sample has so many vectors for each list.
LIST_ROWS, MOST_LISTS, SAMPLE_EACH = 256, 16_384, 16
#: A vector goes into at most so many lists, whose centroids are at most so much farther than the nearest one.
REPLICAS, BORDER = 4, 1.15
#: Queries that the reach is measured with, and the share of their neighbours that it has to find.
TRIALS, RECALL = 256, 0.96
#: Lists that a query looks into before it asks the others for what is better alone.
NEAREST = 8
#: Neighbours of a centroid in the graph, centroids that a search keeps for a vector to be filed, and those it goes on from at a time.
DEGREE, BEAM, STEP = 24, 24, 4
#: Vectors that search the graph side by side; cells of one block of inner products.
SIDE, CELLS = 256, 1 << 21
SALT = 16


@dataclass
class Graph:
    """Centroids of the lists, the neighbours of each, and the centroids that a search begins at. Bounded by MOST_LISTS."""

    centroids: np.ndarray
    near: np.ndarray
    gates: np.ndarray


def lifted(vectors: np.ndarray, longest2: float) -> np.ndarray:
    """The vectors with one more component, so that all are as long as the longest, at length 1."""
    v = vectors / math.sqrt(longest2)
    rest = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))
    return np.concatenate((v, rest[:, None]), axis=1).astype(np.float32)


def turned(queries: np.ndarray) -> np.ndarray:
    """The queries at length 1, with a zero behind."""
    v = queries / np.abs(queries).max(axis=1, keepdims=True)
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.concatenate((v, np.zeros((len(v), 1))), axis=1).astype(np.float32)


def balanced_centroids(points: np.ndarray, lists: int) -> np.ndarray:
    """Means of `lists` parts of nearly equal size: cut in two, again and again, each time between two means at the place that keeps shares equal."""
    out, todo = [], [(np.arange(len(points)), lists)]
    while todo:
        at, k = todo.pop()
        own = points[at]
        if k == 1:
            out.append(own.mean(axis=0))
            continue
        left, middle = k // 2, len(at) * (k // 2) // k
        a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            order = np.argsort(own @ (a - b), kind="stable")[::-1]
            a, b = own[order[:middle]].mean(axis=0), own[order[middle:]].mean(axis=0)
        todo += [(at[order[middle:]], k - left), (at[order[:middle]], left)]
    return np.array(out, np.float32)


def graph_of(centroids: np.ndarray) -> Graph:
    """Each centroid with its nearest ones, its neighbours in the order of the cuts, and some far ones by a fixed rule, so that no part is cut off."""
    n, near = len(centroids), []
    own = (centroids * centroids).sum(axis=1)
    for lo in range(0, n, 1024):
        d = own[None, :] - 2 * centroids[lo : lo + 1024] @ centroids.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        take = min(DEGREE, n - 1)
        near.append(np.argpartition(d, take - 1, axis=1)[:, :take] if 0 < take < n - 1 else np.tile(np.arange(n), (len(d), 1)))
    at = np.arange(n)
    far = [(at + 1) % n, (at - 1) % n, *((at + (n // 2**k)) % n for k in range(1, 5)), *((at - (n // 2**k)) % n for k in range(1, 5))]
    gates = np.unique(np.linspace(0, n - 1, max(1, math.isqrt(n))).astype(np.int64))
    return Graph(centroids, np.concatenate((np.concatenate(near), np.stack(far, axis=1)), axis=1).astype(np.int64), gates)


def nearest_lists(g: Graph, points: np.ndarray, beam: int = BEAM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first point, centroids, distances) for a few points at a time: the centroids that a beam search over the graph ends with, nearest first; inf: none."""
    for lo in range(0, len(points), SIDE):
        yield lo, *_beam(g, points[lo : lo + SIDE], beam)


def _beam(g: Graph, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, rows = len(g.centroids), np.arange(len(x))[:, None]
    own, mine = (g.centroids * g.centroids).sum(axis=1), (x * x).sum(axis=1)
    seen = np.zeros((len(x), n + 1), bool)  # the last column is for no centroid
    seen[:, g.gates] = True
    seen[:, n] = True
    ids = np.broadcast_to(g.gates, (len(x), len(g.gates)))
    d = own[ids] - 2 * (x @ g.centroids[g.gates].T)
    done = np.zeros(ids.shape, bool)
    ids, d, done = _best(ids, d, done, beam)
    live = np.arange(len(x))
    while len(live):
        order = np.argsort(np.where(done[live] | (ids[live] == n), np.inf, d[live]), axis=1, kind="stable")[:, :STEP]
        pick = np.take_along_axis(ids[live], order, axis=1)
        fresh = ~np.take_along_axis(done[live], order, axis=1) & (pick < n)
        done[live[:, None], order] = True
        pick = np.where(fresh, pick, n)
        table = np.concatenate((g.near, np.full((1, g.near.shape[1]), n)))
        ask = table[pick].reshape(len(live), -1)
        ask.sort(axis=1)
        ask[:, 1:][ask[:, 1:] == ask[:, :-1]] = n
        ask = np.where(seen[live[:, None], ask], n, ask)
        seen[live[:, None], ask] = True
        far = np.where(ask < n, own[np.minimum(ask, n - 1)] - 2 * np.einsum("bkd,bd->bk", g.centroids[np.minimum(ask, n - 1)], x[live]), np.inf)
        a, b, c = _best(np.concatenate((ids[live], ask), axis=1), np.concatenate((d[live], far), axis=1), np.concatenate((done[live], np.zeros(ask.shape, bool)), axis=1), beam)
        ids, d, done = _widen(ids, a.shape[1], n), _widen(d, a.shape[1], np.inf), _widen(done, a.shape[1], True)
        ids[live], d[live], done[live] = a, b, c
        live = live[(~c & (a < n)).any(axis=1)]
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(0, np.take_along_axis(d, order, axis=1) + mine[:, None]))


def _widen(x: np.ndarray, columns: int, fill) -> np.ndarray:
    return x if x.shape[1] >= columns else np.concatenate((x, np.full((len(x), columns - x.shape[1]), fill, x.dtype)), axis=1)


def _best(ids: np.ndarray, d: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, ...]:
    if ids.shape[1] <= beam:
        return np.array(ids), np.array(d), np.array(done)
    order = np.argpartition(d, beam - 1, axis=1)[:, :beam]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (ids, d, done))


def lists_of_vectors(g: Graph, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each vector goes into: the nearest, and others within BORDER of it unless their centroid is nearer to one already taken than to the vector."""
    rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, ids, d in nearest_lists(g, points):
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        for j in range(1, min(ids.shape[1], 4 * REPLICAS)):
            ok = (d[:, j] <= BORDER * d[:, 0] + 1e-6) & (taken.sum(axis=1) < REPLICAS) & np.isfinite(d[:, j])
            for i in range(j):
                at = np.flatnonzero(ok & taken[:, i])
                gap = np.sqrt(((g.centroids[ids[at, i]] - g.centroids[ids[at, j]]) ** 2).sum(axis=1))
                ok[at[gap < d[at, j]]] = False
            taken[:, j] = ok
        row, col = np.nonzero(taken)
        rows.append(row + lo)
        lists.append(ids[row, col])
    return np.concatenate(rows), np.concatenate(lists)


def lists_of_queries(g: Graph, points: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, place among them) of the lists that each query looks into: those within `reach` of the nearest one; a search that ends with nothing but such lists goes on with a wider beam."""
    rows, lists, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, ids, d in nearest_lists(g, points, beam):
        near = np.isfinite(d) & (d <= reach * d[:, :1] + 1e-6)
        full = near.all(axis=1) & (beam < len(g.centroids))
        row, col = np.nonzero(near & ~full[:, None])
        rows.append(row + lo)
        lists.append(ids[row, col])
        places.append(col)
        if full.any():
            row, more, col = lists_of_queries(g, points[lo + np.flatnonzero(full)], reach, 2 * beam)
            rows.append(lo + np.flatnonzero(full)[row])
            lists.append(more)
            places.append(col)
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(places)


def reach_of(g: Graph, queries: np.ndarray, owner: np.ndarray, neighbours: np.ndarray, recall: float) -> tuple[float, int]:
    """How many times as far as the nearest centroid a query has to look to find the share `recall` of its true neighbours, and the centroids within that on average.

    neighbours: vectors; owner: the query of each.
    """
    apart = np.full((len(queries), len(g.centroids)), np.inf)
    for lo, ids, d in nearest_lists(g, queries, len(g.centroids)):
        np.put_along_axis(apart[lo : lo + len(ids)], ids, d, axis=1)
    first = apart.min(axis=1)
    row, to = lists_of_vectors(g, neighbours)
    need = np.full(len(neighbours), np.inf)
    np.minimum.at(need, row, apart[owner[row], to] / np.maximum(first[owner[row]], 1e-12))
    reach = float(np.quantile(need, recall, method="higher")) if len(need) else 1.0
    return reach, int((apart <= reach * first[:, None]).sum(axis=1).mean()) + 1


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors from their bytes, in double precision."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _packed(kind: str, most: int):
    """Rows (key, vec_id): the bytes of a vector; of equal vectors of a batch those with the `most` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = arrow_rows(batch, "vec_id").to_numpy()
            flat = arrow_rows(batch, "vec").flatten().to_numpy().astype(kind) + np.zeros(1, kind)  # a negative zero is a zero
            keys = flat.reshape(len(ids), -1).view(f"V{flat.itemsize * (len(flat) // len(ids))}").ravel()
            _, group = np.unique(keys, return_inverse=True)
            order = np.lexsort((ids, group))
            g, i = group[order], ids[order]
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
            order, g = order[fresh], g[fresh]
            first = np.searchsorted(g, g)
            order = order[np.arange(len(g)) - first < most]
            yield pa.record_batch([pa.array([k.tobytes() for k in keys[order]], pa.binary()), pa.array(ids[order])], ["key", "vec_id"])

    return run


def _filed(kind: str, graph, place, carry: str):
    """Each vector in its lists: rows (list, key, what it carries), and for queries the place of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(arrow_rows(batch, "key"), kind)
            if not len(v):
                continue
            row, to, *rest = place(graph.value, v)
            part = batch.take(pa.array(row))
            yield pa.record_batch([pa.array(to, pa.int64()), arrow_rows(part, "key"), arrow_rows(part, carry), *map(pa.array, rest)], ["list", "key", carry, *["place"] * len(rest)])

    return run


def _compared(kind: str, most: int):
    """Of the vectors of one list, for each query the nearest ones by (score, id) whose score is not below its floor: rows (q, vec_id, score)."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column("ids").combine_chunks()
            size, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            begin = np.concatenate(([0], np.cumsum(size)))
            v, number, floor = _matrix(vectors.column("key"), kind), queries.column("q").to_numpy(), queries.column("floor").to_numpy()
            step = max(1, CELLS // len(v))
            for lo in range(0, len(number), step):
                q = _matrix(queries.column("key").slice(lo, step), kind)
                rough = q @ v.T
                bound = floor[lo : lo + len(q)]
                some = np.flatnonzero(rough.max(axis=1) >= bound - 1e-9 * np.abs(bound))
                if not len(some):
                    continue
                q, rough, bound, who = q[some], rough[some], bound[some], number[lo + some]
                take = min(len(v), most + 8)
                best = np.argpartition(-rough, take - 1, axis=1)[:, :take]
                exact = (v[best] * q[:, None, :]).sum(axis=2)  # added in the same order wherever a pair meets
                for k in range(len(q)):
                    at = np.repeat(np.arange(take), size[best[k]])
                    own = np.concatenate([flat[begin[b] : begin[b + 1]] for b in best[k]])
                    score = exact[k][at]
                    order = np.lexsort((own, -score))[:most]
                    order = order[score[order] >= bound[k]]
                    out_q.append(np.full(len(order), who[k]))
                    out_id.append(own[order])
                    out_s.append(score[order])
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table({"q": join(out_q, pa.int64()), "vec_id": join(out_id, pa.int64()), "score": join(out_s, pa.float64())})

    return run


def _tried(kind: str, trials, most: int):
    """Of each batch the vectors nearest to each trial query: rows (q, key, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = arrow_rows(batch, "key")
            v = _matrix(keys, kind)
            score = trials.value @ v.T if len(v) else np.zeros((0, 0))
            take = min(len(v), most)
            best = np.argpartition(-score, take - 1, axis=1)[:, :take] if len(v) else np.zeros((0, 0), np.int64)
            q = np.repeat(np.arange(len(best)), take)
            yield pa.record_batch([pa.array(q, pa.int64()), keys.take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel() if len(v) else [], pa.float64())], ["q", "key", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """vec_id and vec of the rows that take part, and the numpy type of a component."""
    single = isinstance(vectors.schema[vec_col].dataType, ArrayType) and isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<float>" if single else "array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where("vec_id is not null and vec is not null").where(sound), "f4" if single else "f8"


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """The k rows with the largest inner product found for each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id; a query's own id is left out. Scores are inner products of the original
    vectors in double precision. Equal vectors are filed and compared once, with the k + 1 smallest of their ids, of which
    no result needs more; so a vector that a third of the rows share costs one. The centroids are learnt from at most
    2 * MOST_LISTS * SAMPLE_EACH vectors, the reach from at most TRIALS queries against all vectors; every vector is filed and
    every query compared with all vectors of its lists. About the share `recall` of the true neighbours is found. Where the
    vectors are noise of many dimensions, that takes a fixed share of all lists, so the work grows with their square there.

    Vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, nor do rows without an id,
    nor vectors that have another number of components than most (of equally frequent numbers the largest counts). Rows
    that share an id are forms of one: the nearest form counts. An empty table gives an empty result; columns besides
    the two are not read.
    """
    spark = vectors.sparkSession
    rows, kind = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("vec") == (sizes["size"] if sizes else 0))
    key = "key binary, vec_id long"
    few = rows.mapInArrow(_packed(kind, k + 1), key).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
    few = few.repartition("key", "salt").dropDuplicates(["key", "salt", "vec_id"])
    for by in (["key", "salt"], ["key"]):
        few = few.withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).where(F.col("at") <= k + 1).drop("at")
    base = written(few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS))
    share = min(1.0, lists * SAMPLE_EACH / n)
    picked = base.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int(share * (1 << 32))) if share < 1 else base
    sample = _matrix(pa.array([bytes(r[0]) for r in picked.select("key").limit(2 * MOST_LISTS * SAMPLE_EACH).collect()], pa.binary()), kind)
    longest2 = base.mapInArrow(_squares(kind), "s double").agg(F.max("s")).first()[0]
    lists = max(1, min(lists, len(sample)))
    graph = graph_of(balanced_centroids(lifted(sample, longest2), lists)) if len(sample) else graph_of(np.zeros((1, 1), np.float32))
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = written(asked.mapInArrow(_packed(kind, 1 << 62), key), "ann-queries")
    forms = written(asked.select("key").distinct().withColumn("q", F.monotonically_increasing_id()), "ann-forms")
    tried = _matrix(pa.array([bytes(r[0]) for r in forms.orderBy(F.xxhash64("key")).select("key").limit(TRIALS).collect()], pa.binary()), kind)
    best = base.mapInArrow(_tried(kind, spark.sparkContext.broadcast(tried), k), "q long, key binary, score double")
    best = best.withColumn("at", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("at") <= k).select("q", "key").collect()
    true = _matrix(pa.array([bytes(r.key) for r in best], pa.binary()), kind)
    reach, beam = reach_of(graph, turned(tried), np.array([r.q for r in best], np.int64), lifted(true, longest2), recall) if best else (1.0, 1)
    shared = spark.sparkContext.broadcast(graph)
    filed = written(base.mapInArrow(_filed(kind, shared, lambda g, v: lists_of_vectors(g, lifted(v, longest2)), "ids"), "list long, key binary, ids array<long>"), "ann-lists")
    looked = written(forms.mapInArrow(_filed(kind, shared, lambda g, v: lists_of_queries(g, turned(v), reach, beam), "q"), "list long, key binary, q long, place long"), "ann-looks")

    def compared(queries: DataFrame) -> DataFrame:
        return filed.groupBy("list").cogroup(queries.groupBy("list")).applyInArrow(_compared(kind, k + 1), "q long, vec_id long, score double")

    def first(found: DataFrame) -> DataFrame:
        order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return found.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")

    # the nearest lists give each query a floor, and the others send only what is not below it
    near = written(first(compared(looked.where(F.col("place") < NEAREST).withColumn("floor", F.lit(float("-inf"))))), "ann-near")
    floors = written(near.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("floor")), "ann-floors")
    rest = looked.where(F.col("place") >= NEAREST).join(floors.hint("merge"), "q")
    found = first(near.union(compared(rest)))
    found = written(found.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("near")), "ann-found")
    who = written(asked.withColumnRenamed("vec_id", "query_id").join(forms.hint("merge"), "key").select("query_id", "q"), "ann-asked")
    out = who.join(found.hint("merge"), "q").select("query_id", F.inline("near")).where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _squares(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(arrow_rows(batch, "key"), kind)
            yield pa.record_batch([pa.array((v * v).sum(axis=1), pa.float64())], ["s"])

    return run


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Of each row whose vec_id is divisible by 20 the 20 nearest found: query_id, rank, vec_id, score."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
