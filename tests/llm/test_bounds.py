"""What must not grow: hash windows on very long texts, rows learnt from under a hot id, session settings, languages."""

import random
import tracemalloc

import numpy as np
import pytest

from voxelweave.llm import common, language_id, near_dedup, quality_classifier, quality_rules, registry

DOCS = "doc_id long, text string, lang string"
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_hashes_do_not_depend_on_windows(monkeypatch):
    rnd = random.Random(3)
    data = np.frombuffer(" ".join("".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 60))) for _ in range(300)).encode(), np.uint8)
    start, end, _ = common.words(data, np.array([0, len(data)]))
    whole = common.hash_spans(data, start, end, lower=True)
    alone = [common.hash_spans(data[a:b], np.array([0]), np.array([b - a]), lower=True)[0] for a, b in zip(start, end)]
    assert whole.tolist() == alone
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "HASH_BYTES", size)
        monkeypatch.setattr(common, "_POWERS", [])
        assert (common.hash_spans(data, start, end, lower=True) == whole).all()


def test_a_long_text_is_hashed_in_bounded_memory():
    data = np.frombuffer(("some words of a very long text " * 1_300_000).encode(), np.uint8)  # 40 MB
    start, end = np.arange(0, len(data), 31), np.arange(30, len(data), 31)
    common.hash_spans(data[:31], start[:1], end[:1])
    tracemalloc.start()
    got = common.hash_spans(data, start, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got.tolist())) == 1 and peak < 120 << 20


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op10_quality_rules", "op9_language_id"])
def test_queries_leave_the_session_alone(spark, edge, name):
    before = spark.conf.get(ARROW)
    registry.queries()[name](spark, edge[0]).count()
    assert spark.conf.get(ARROW) == before


def test_a_hot_labelled_id_counts_once(spark):
    rows = [(0, "hot text number %d of one id" % (k % 5), "en") for k in range(4000)] + [(k, f"text {k}", "en") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(0, 1)], "doc_id long, quality int")
    got = quality_classifier.one_each(quality_classifier.learning_rows(docs, labels, 100).selectExpr("doc_id", "quality", "cast(text as binary) x")).collect()
    assert len(got) == len({r.doc_id for r in got}) and bytes(next(r.x for r in got if r.doc_id == 0)) == b"hot text number 0 of one id"
    assert isinstance(quality_rules.fit(docs, labels), quality_rules.Regression)


LETTERLESS = ["×", "÷ 12", "12 + 5 = 17", "…", "🙂🙂", "́", " \n\t", "", None, "٣٤", "—"]
LETTERED = ["ＡＢＣ", "ﷺ", "ªº", "µ", "ⲁⲃ", "x", "é", "漢", "カ", "한", "ไทย", "ა", "Ж", "12 ª", "𝒜", "ǆ", "ʰ"]


def test_und_is_for_texts_without_letters_alone(spark):
    words = {"en": "the house and the river of their own", "de": "das haus und der fluß über den bergen"}
    learn = [(k, words[lang], lang) for k, lang in enumerate(["en", "de"] * 30)]
    rows = learn + [(1000 + k, t, None) for k, t in enumerate(LETTERLESS + LETTERED)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(LETTERLESS + LETTERED):
        assert (got[1000 + k].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) == (k < len(LETTERLESS)), t
        assert got[1000 + k].lang_pred in ("und", "en", "de") and 0 <= got[1000 + k].score <= 1


def test_scripts_follow_code_points():
    text = "aé×ßЖλאعกカ漢한 Ａµⲁ𝒜1🙂"
    data = np.frombuffer(text.encode(), np.uint8)
    lead = (data & 0xC0) != 0x80
    assert language_id.scripts_of(data)[lead].tolist() == [1, 1, 0, 1, 3, 2, 4, 5, 7, 8, 9, 10, 0, 1, 1, 2, 11, 0, 0]
    assert not language_id.scripts_of(data)[~lead].any()


def test_many_languages_are_all_learnt(spark):
    """300 values of lang, each with words of its own: every one is predicted, and scoring stays small."""
    rnd = random.Random(2)
    own = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for _ in range(300)]
    rows = [(k, " ".join(rnd.choice(own[k % 300]) for _ in range(30)), f"l{k % 300}") for k in range(1800)]
    model = language_id.learn(spark.createDataFrame(rows, DOCS).repartition(4))
    assert len(model.languages) == 300
    import pyarrow as pa

    batch = pa.record_batch([pa.array([r[1] for r in rows] * 3)], ["text"])
    tracemalloc.start()
    got = [x for _, _, lang, _, _ in language_id._label(model, batch) for x in lang]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.mean([g == r[2] for g, r in zip(got, rows * 3)]) > 0.99 and peak < 300 << 20


def model_of(n=4):
    rng = np.random.default_rng(3)
    return language_id.Model([f"l{k}" for k in range(n)], rng.integers(0, 50, (n, language_id.ROWS)))


def test_a_long_text_is_labelled_in_bounded_memory(monkeypatch):
    """A text of 40 MB of one word, and one in two languages that takes many blocks of words, span by span."""
    import pyarrow as pa

    def label(model, text):
        batch = pa.record_batch([pa.array([text])], ["text"])
        tracemalloc.start()
        got = list(language_id._label(model, batch))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got[0], peak

    one, peak = label(model_of(), "a" * 40_000_000)
    assert peak < 300 << 20 and one[4][0][0]["end"] == 40_000_000
    model = model_of(2)
    counts = np.zeros((2, language_id.ROWS))
    for k, text in enumerate(("somewords of the one ", "énçã dûx trés autre ")):
        f = language_id.Features(np.frombuffer((text * 40).encode(), np.uint8), np.array([0, 40 * len(text.encode())]))
        for rows in f.grams(0, len(f.data)):
            np.add.at(counts[k], rows, 1)
        counts[k, language_id.TABLE * len(language_id.SIZES) + 1] = 100
    model = language_id.Model(["l0", "l1"], counts)
    monkeypatch.setattr(language_id, "CELLS", 1 << 14)
    half = "somewords of the one " * 15_000
    (_, _, lang, _, spans), peak = label(model, half + "énçã dûx trés autre " * 12_000)
    assert peak < 300 << 20 and [s["lang"] for s in spans[0]] == ["l0", "l1"] and spans[0][0]["end"] == len(half) - 1 and spans[0][1]["end"] == len(half) + 240_000 - 1


@pytest.mark.parametrize("cells", [1 << 22, 1 << 12])
def test_blocks_score_as_the_whole(monkeypatch, cells):
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdé漢") for _ in range(rnd.choice([1, 3, 9, 3000]))) for _ in range(300))
    data = np.frombuffer(text.encode(), np.uint8)
    f, model = language_id.Features(data, np.array([0, len(data)])), model_of(5)
    whole = model.word_scores(f)
    s = sum(model.tables[r] for r in f.grams(0, len(data)))
    plain = np.add.reduceat(s, f.start, axis=0)
    plain[f.script == 0] = 0
    plain[~model.allowed[f.script]] += language_id.OFF_SCRIPT
    assert np.allclose(whole, plain - plain.max(axis=1, keepdims=True), atol=0.05, rtol=1e-3)
    monkeypatch.setattr(language_id, "CELLS", cells)
    parts = np.concatenate([model.word_scores(f, a, min(a + 7, len(f.start))) for a in range(0, len(f.start), 7)])
    assert np.allclose(whole, parts, atol=0.05, rtol=1e-3)


def test_viterbi_by_blocks():
    rng = np.random.default_rng(6)
    for n, k, each in ((1, 3, 2), (50, 4, 7), (400, 5, 33), (400, 3, 400), (64, 2, 8)):
        for wide in (0.5, 3.0, 12.0):
            s = rng.normal(size=(n, k)) * wide
            s[: n // 2, 0] += 1
            s[n // 2 :, 1] += 1
            assert (language_id.viterbi_blocks(lambda a, b: s[a:b], n, k, each) == language_id.viterbi(s)).all()  # noqa: B023


def test_chains_of_near_copies_in_blocks_of_any_size(spark, monkeypatch):
    """Chains of near copies in one bucket, with blocks so small that a bucket has many."""
    from .test_operators import brute_groups

    rnd = np.random.default_rng(9)
    words, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(3):
        mine = list(rnd.choice(words, 150))
        for _ in range(80):  # each is a small step from the one before, the ends are far apart
            mine = mine.copy()
            mine[int(rnd.integers(0, 150))] = str(rnd.choice(words))
            rows.append((len(rows), " ".join(mine), "en"))
    want = brute_groups(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for block in (8, 1000):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == want
