"""Near copies and repeated passages against brute force on the whole table of sf0.01, and the verdict of the quality rules."""

import collections
import random

import numpy as np
import pyarrow.parquet as pq

from voxelweave.llm import near_dedup, substring_dedup

from .test_operators import WORD, held, run, word_set

FOLDER = "/root/testdata/sf0.01"


def test_near_duplicates_of_a_whole_table(spark):
    """Every linked pair of the brute force is in one group, and no group holds more: recall 1 and precision 1 here."""
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = {r["doc_id"]: word_set(r["text"]) for r in rows}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for percent in (80, 85):
        parent = {i: i for i in sets}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        linked = 0
        for i, s in sets.items():
            both = collections.Counter(j for x in s for j in where[x] if j < i)
            for j, n in both.items():
                if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                    linked += 1
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent=percent).collect()}
        assert linked > 50 and got == {i: root(i) for i in sets}


def test_passages_go_and_the_rest_stays(spark):
    """Passages of 50 to 120 words that an earlier document has: 88 percent of their words go, all but some at their ends, and nothing else does."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(20000)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [say(rnd.randint(50, 120)) for _ in range(40)]
    rows, planted = [], {}
    for i in range(400):
        words, at = say(rnd.randint(100, 300)), None
        if i % 2:
            p = rnd.choice(passages)
            at = rnd.randint(0, len(words))
            words[at:at] = p
            planted[i] = (at, at + len(p), tuple(p))
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    seen, gone, due, wrong = set(), 0, 0, 0
    for i, text in rows:
        spans = [(s.start, s.end) for s in got[i].removed_spans]
        lo, hi, p = planted.get(i, (0, 0, None))
        repeat = p in seen
        seen.add(p)
        for k, m in enumerate(WORD.finditer(text)):
            hit = any(a <= m.start() and m.end() <= b for a, b in spans)
            inside = repeat and lo <= k < hi
            due += inside
            gone += inside and hit
            wrong += hit and not inside
    assert due > 5000 and gone / due > 0.86 and wrong == 0


def test_verdict_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist() if r["quality"] is not None}
    got = [r for r in run(spark, "op10_quality_rules", FOLDER) if r.doc_id in labels and held(r.doc_id)]
    bad = [r for r in got if labels[r.doc_id] == 0]
    good = [r for r in got if labels[r.doc_id] == 1 and not r.base_failed]
    assert len(bad) > 5 and np.mean([r.kept for r in bad]) <= 0.1 and np.mean([r.kept for r in good]) >= 0.95
