"""Phrases against plain Python: odd texts, prefixes over any budget, hashes that words share, and the SQL on a whole table."""

import collections
import re

import pytest

from voxelweave.llm import phrases

from .test_operators import LOWER, run

SCHEMA = "doc_id long, text string, lang string, word string, n long, a long, grp long"


def brute(rows, least=10, top=2000):
    total, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        most = collections.Counter()
        for p, a in cands.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], a)
        found = []
        for p, a in cands.items():
            if len(p) == 2 and p in most and 100 * most[p] >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), l, r))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, total[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def test_query(spark, edge):
    folder, rows, _ = edge
    want = brute([(i, t, lang) for i, t, lang in rows])
    assert len(want) > 50 and sorted(tuple(r) for r in run(spark, "op13_phrases", folder)) == want


ODD = [(k, t, lang) for k, (t, lang) in enumerate([("The cat sat. The cat\tsat, the  CAT sat!on a mat\nthe cat", "en"), ("É É ÉÉ é É É", None), ("É É ÉÉ é É É", "und"), (None, "en"), ("", "fr"), (" .;:!? ", "de"), ("one", "es"), ("x x x x x x x x x x x x x x x x", "en"), ("the cat sat the cat", "en"), ("a.b", "xx")] * 6)]


@pytest.mark.parametrize("budget,bits", [(200_000, 64), (3, 64), (1, 64), (50, 8)])
def test_prefixes_over_the_budget_and_shared_hashes(spark, budget, bits):
    """With a budget of one every frequent word is lengthened, and every pair lies in several groups; with 8 bits nearly all words share a hash."""
    rows = [(i, t, lang, "z", 1, 2, 3) for i, t, lang in ODD]
    got = phrases.phrases(spark.createDataFrame(rows, SCHEMA).repartition(5), least=3, top=40, budget=budget, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == brute(ODD, 3, 40)


def test_ties_are_cut_by_bytes_of_the_phrase(spark):
    text = ". ".join(f"w{k} v{k}" for k in range(30))
    rows = [(0, text, "en", "", 1, 1, 1)] * 10
    got = phrases.phrases(spark.createDataFrame(rows, SCHEMA), top=7).orderBy("rank").collect()
    assert [r.phrase for r in got] == sorted(f"w{k} v{k}" for k in range(30))[:7] and {r.score for r in got} == {1000000}
