"""Runs of words against all periods tried in turn, on random sequences and on the edge table, and against the SQL."""

import collections
import hashlib
import random
import zlib

import numpy as np

from voxelweave.llm import periodic_runs
from voxelweave.llm.common import mix

from .test_operators import WORD, run


def brute(w, least=6, periods=4):
    """(start, length, smallest period) of every run, by start, then end: all periods are tried in turn."""
    number, found = {}, {}
    x = np.array([number.setdefault(v, len(number)) for v in w], np.int64)
    for p in range(1, len(x) // periods + 1):
        same = np.concatenate(([0], x[p:] == x[:-p], [0]))
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + p >= max(least, periods * p):
                found.setdefault((i, j + p), p)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def edited(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = edited(doc_id, WORD.findall(text or ""))
    runs = sorted(brute(w), key=lambda x: (x[0], x[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    left = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_of_random_sequences():
    rnd = random.Random(1)

    def sequence():
        out = []
        while len(out) < rnd.choice([0, 3, 20, 100, 400]):
            k = rnd.choice([1, 2, 3, 5, 8, 17, 33])
            x = [rnd.randint(0, rnd.choice([1, 2, 50])) for _ in range(k)] * rnd.choice([1, 1, 1, 2, 4])
            out += (x * rnd.randint(1, 8))[: rnd.randint(1, k * 8)]
        return out

    for periods in (2, 3, 4):
        for _ in range(80):
            rows, least = [sequence() for _ in range(rnd.randint(0, 6))], rnd.choice([1, 6, 9])
            at = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
            got = periodic_runs.runs_of(mix(np.array(sum(rows, []), np.uint64)), at, least, periods)
            want = [(a + s, a + s + m, q) for x, a in zip(rows, at) for s, m, q in brute(x, least, periods)]
            assert [tuple(x) for x in got.tolist()] == sorted(want, key=lambda x: (x[0], x[2]))


def test_one_word_many_times_takes_no_square_of_work():
    assert periodic_runs.runs_of(np.full(300_000, 7, np.uint64), np.array([0, 300_000])).tolist() == [[0, 300_000, 1]]


def test_words_decide_where_hashes_agree(spark, monkeypatch):
    """Two words of one hash: what looks like a run by hashes is none by words."""
    import pyarrow as pa

    monkeypatch.setattr(periodic_runs, "hash_spans", lambda data, start, end: mix((end - start).astype(np.uint64)))
    texts = ["ab cd ef gh ij kl mn op", "x x x x x x yy zz yy zz yy zz yy zz"]
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in periodic_runs._searched(False, 6, 4)([batch]) for r in b.to_pylist()]
    assert [[(x["start"], x["length"], x["period"]) for x in r["runs"]] for r in got] == [[], [(0, 6, 1), (6, 8, 2)]]
    assert [r["collapsed"] for r in got] == [b"ab cd ef gh ij kl mn op", b"x yy zz"]


def test_query(spark, edge):
    folder, rows, _ = edge
    want = collections.Counter(expected(i, t) for i, t, _ in rows)
    got = collections.Counter(tuple(r) for r in run(spark, "op11_periodic_runs", folder))
    assert got == want and sum(x[1] > 0 for x in want) > 5


def test_query_of_a_whole_table(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert {tuple(r) for r in run(spark, "op11_periodic_runs", "/root/testdata/sf0.001")} == {expected(r["doc_id"], r["text"]) for r in rows}
