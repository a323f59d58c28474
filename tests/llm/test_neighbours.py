"""Nearest neighbours against brute force: recall on whole tables, exact scores and order, odd vectors."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from voxelweave.llm import neighbours

from .test_operators import run

SCHEMA = "vec_id long, embedding array<float>, label int, list long, key string, q long, score string"


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def measured(got, rows, k=20):
    """Checks ids, order and scores of a result; returns its recall, where a candidate as near as the last true one counts."""
    forms = {}
    for i, v in rows:
        if i is not None and sound(v):
            forms.setdefault(i, []).append(np.array(v, np.float64))
    by, hit, due = {}, 0, 0
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    owner = np.array([i for i, f in forms.items() for _ in f])
    all_of = np.array([v for f in forms.values() for v in f])
    assert set(by) == {i for i in forms if i % 20 == 0 and len(forms) > 1}
    for q, mine in by.items():
        score = np.array([(all_of * v).sum(axis=1) for v in forms[q]]).max(axis=0)
        best = {}
        for i, s in zip(owner.tolist(), score.tolist()):
            if i != q:
                best[i] = max(best.get(i, -math.inf), s)
        order = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(order)
        assert len({r.vec_id for r in mine}) == len(mine) and all(abs(r.score - best[r.vec_id]) < 1e-12 * max(1, abs(r.score)) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        due += len(order)
        hit += sum(r.score >= order[-1][1] - 1e-9 for r in mine)
    return hit / max(due, 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_whole_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    assert measured(run(spark, "op12_nearest_neighbours", folder), [(r["vec_id"], r["embedding"]) for r in rows]) >= 0.93


def clustered(rng, n, centres=60, wide=0.15):
    """Vectors of very different lengths around a few directions."""
    c = rng.normal(size=(centres, 16))
    return (c[rng.integers(0, centres, n)] + wide * rng.normal(size=(n, 16))) * rng.uniform(0.2, 3, (n, 1))


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in clustered(rng, 3000)]
    rows = list(enumerate(v))
    rows += [(3000 + i, v[7]) for i in range(1500)]  # a third are one vector, queries among them
    odd = [None, [], [0.0] * 16, [-0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, [1.0] * 17]
    rows += [(20 * (300 + i), x) for i, x in enumerate(odd)]
    rows += [(None, v[3]), (40, v[40]), (40, v[41]), (60, [-x for x in v[60]])]
    data = [(i, x, 1, 2, "a", 3, "b") for i, x in rows]
    got = neighbours.nearest(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()
    single = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in rows]
    assert measured(got, [(i, x) for i, x in single if x is None or len(x) == 16]) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 15, 41])
def test_few_rows(spark, n):
    rows = [(20 * i, [float(i + 1), 2.0 - i], 1, 2, "a", 3, "b") for i in range(n)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3)).collect()
    assert len(got) == n * min(20, n - 1) and (n == 1 or measured(got, [r[:2] for r in rows]) == 1)


def test_no_rows(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.nearest(spark.createDataFrame([(20, None, 1, 1, "a", 1, "b")], SCHEMA)).collect() == []


def test_border_vectors_are_in_several_lists_and_searches_prune():
    rng = np.random.default_rng(5)
    points = neighbours.lifted(clustered(rng, 6000), 400.0)
    g = neighbours.graph_of(neighbours.balanced_centroids(points, 80))
    row, to = neighbours.lists_of_vectors(g, points)
    assert 1.05 < len(row) / len(points) <= neighbours.REPLICAS and set(row) == set(range(len(points)))
    d = ((points[:, None, :] - g.centroids[None]) ** 2).sum(axis=2)
    first = np.array([to[row == i][0] for i in range(300)])
    assert np.mean(first == d[:300].argmin(axis=1)) > 0.97  # the graph finds the nearest centroid
    q = neighbours.turned(clustered(rng, 50))
    looked, _, _ = neighbours.lists_of_queries(g, q, 1.1, 4)
    assert len(looked) < 0.6 * 50 * 80
    sizes = np.bincount(to, minlength=80)
    assert sizes.max() < 8 * sizes.mean()
