"""Repeated passages in text without white space."""

import base64
import itertools
import random

import numpy as np
import pytest

from voxelweave.llm import substring_dedup

DOCS = "doc_id long, text string, n_chars long"


def han(rnd, n):
    return "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(n))


def thai(rnd, n):
    return "".join(chr(rnd.randrange(0x0E01, 0x0E2F)) for _ in range(n))


def code(rnd, n):
    return base64.b64encode(rnd.randbytes(n)).decode()[:n]


@pytest.mark.parametrize("say", [han, thai, code])
def test_unspaced_passages_go(spark, say):
    rnd = random.Random(11)
    passage, short = say(rnd, 2000), say(rnd, 60)
    texts = [say(rnd, 700) + passage + say(rnd, 900), say(rnd, 300) + passage + say(rnd, 500), say(rnd, 400) + short + say(rnd, 300), say(rnd, 500) + short + say(rnd, 200), passage]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2] and got[3].text == texts[3]
    (span,) = got[1].removed_spans
    assert 300 <= span.start <= 450 and 2150 <= span.end <= 2300
    assert got[1].text == texts[1][: span.start] + texts[1][span.end :]
    assert len(got[4].text) <= 250  # all but its ends, which are chunks with what stands beside them in the first
    left = {r.doc_id: r.text for r in substring_dedup.repeats_removed(docs).collect()}
    assert left == {i: r.text for i, r in got.items()}


def test_unspaced_copies_go(spark):
    text = han(random.Random(12), 3000)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, text, 3000), (2, text, 3000)], DOCS)).collect()}
    assert got[1].text == text and got[2].text == "" and [(s.start, s.end) for s in got[2].removed_spans] == [(0, 3000)]


@pytest.mark.parametrize("sep", ["", " "])
def test_cuts_do_not_depend_on_the_row_before(sep):
    rnd = random.Random(13)
    rows = [sep.join(code(rnd, 5) for _ in range(60)).encode() for _ in range(40)]
    for before, row in itertools.product(rows[:20], rows[20:]):
        both = np.frombuffer(before + row, np.uint8)
        begin, at = substring_dedup.cuts(both, np.array([0, len(before), len(both)]), 4)
        alone, _ = substring_dedup.cuts(np.frombuffer(row, np.uint8), np.array([0, len(row)]), 4)
        assert (begin[at[1] :] - len(before)).tolist() == alone.tolist()
