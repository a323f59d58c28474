"""Each corpus operator against plain Python, on texts with nulls, copies, ties, clashing columns and very long rows."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as public
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import byte_bpe, fingerprints, language_id, near_dedup, packing, quality_classifier, registry, substring_dedup, token_records, warc
from voxelweave.llm.common import shingle_hashes
from voxelweave.session import work_uri

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def run(spark, name, folder):
    return registry.queries()[name](spark, folder).collect()


def word_set(text, lower=True):
    w = WORD.findall((text or "").translate(LOWER) if lower else text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"pipeline"}))
def test_empty_table(name, spark, empty):
    assert run(spark, name, empty) == []


def test_warc_round_trip(spark, edge):
    folder, _, _ = edge
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    first = {}
    for p in pages:
        key = p["html"] or ""
        if p["page_id"] is not None:
            first[key] = min(first.get(key, p["page_id"]), p["page_id"])
    want = collections.Counter()
    for p in pages:
        b, f = (p["html"] or "").encode(), first.get(p["html"] or "")
        again = p["page_id"] is not None and p["page_id"] != f
        want[(p["page_id"], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None)] += 1
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run(spark, "op1_warc", folder))
    assert got == want


def test_warc_segments_meet_again(spark, edge):
    folder, _, _ = edge
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    uri = work_uri(spark, "warc-test")
    files = warc.write_warc(pages, uri, least_bytes=1 << 40, segment_bytes=700, file_bytes=5000)
    assert files.count() > 20
    got = warc.read_warc(files, uri).select("page_id", "url", "payload").collect()
    want = [(p["page_id"], p["url"], (p["html"] or "").encode()) for p in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    assert collections.Counter((r.page_id, r.url, bytes(r.payload)) for r in got) == collections.Counter(want)


def test_chunked_framing():
    for data in (b"", b"x", b"ab" * 5000):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def brute_groups(rows, percent=85):
    sets = collections.defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            sets[i].append(word_set(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(s and u and 100 * len(s & u) >= percent * len(s | u) for s in sets[a] for u in sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_duplicates(spark, edge):
    folder, rows, _ = edge
    want = brute_groups(rows)
    got = run(spark, "op2_near_dedup", folder)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((i, len(word_set(t))) for i, t, _ in rows)


def test_near_duplicate_families(spark):
    """Families whose members differ more and more, so that links chain and the first partner is not the right one."""
    rnd = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for fam in range(6):
        base = list(rnd.choice(words, 120))
        for _ in range(60):
            mine = base.copy()
            for k in rnd.choice(120, int(rnd.integers(0, 5)), replace=False):
                mine[k] = str(rnd.choice(words))
            rows.append((len(rows), " ".join(mine), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_groups(rows)


def test_registers_estimate_similarity():
    rnd = np.random.default_rng(1)
    pool = np.unique(rnd.integers(0, 1 << 63, 4000, dtype=np.uint64))
    a, b = np.sort(pool[:3000]), np.sort(pool[300:3300])
    est = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b), 3000, 3000)
    assert abs(est - 2700 / 3300) < 0.1


def test_repeated_passages_go(spark, edge):
    folder, rows, _ = edge
    got = run(spark, "op3_substring_dedup", folder)
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    by_id = {r.doc_id: r for r in got}
    base = len(rows) - 4 - 21
    one, two = by_id[base + 13], by_id[base + 14]
    assert one.removed_words == 0 and two.removed_words >= 30
    assert two.text.split()[:40] == text[base + 14].split()[:40]
    assert by_id[base + 8].removed_words == 0 and by_id[base + 9].removed_words == 30000
    for r in got:
        if r.doc_id is None or r.doc_id == 4:
            continue
        src, left = text[r.doc_id], []
        if src is None:
            assert r.text is None
            continue
        last = 0
        for s in r.removed_spans:
            left.append(src[last : s.start])
            last = s.end
        assert r.text == "".join([*left, src[last:]])
        assert r.n_words == len(WORD.findall(r.text)) and r.n_words_before == len(WORD.findall(src))


def test_chunks_resist_shifts():
    data = (" ".join(f"word{i * 7919 % 1000}" for i in range(2000))).encode()
    cuts = lambda b: substring_dedup.cuts(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 4)[0]
    a, b = cuts(data), cuts(b"inserted words here " + data)
    assert len(set((b - 20).tolist()) & set(a.tolist())) >= len(a) - 3
    def digest(x):
        c = cuts(x)
        return set(substring_dedup.unit_digests(np.frombuffer(x, np.uint8), c, np.array([0, len(c)]))[0].tolist())

    assert len(digest(data) - digest(b"inserted words here " + data)) <= 3


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_records(spark, edge):
    folder, rows, _ = edge
    enc = library("word_bpe_49k.json")
    got = sorted(run(spark, "op4_token_records", folder), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    want = collections.Counter((i, len(e := [*enc(t), 1]), crc(e)) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_records_in_any_order_and_damaged(spark, edge):
    folder, rows, _ = edge
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    uri = work_uri(spark, "records-test")
    manifest = token_records.write_tokens(docs, uri, public.path("word_bpe_49k.json"), shard_bytes=4000)
    a = token_records.read_tokens(manifest, uri).select("doc_id", "start", "ids").collect()
    b = token_records.read_tokens(manifest, uri, shuffled=True).select("doc_id", "start", "ids").collect()
    assert collections.Counter(a) == collections.Counter(b) and len(a) == len(rows)
    raw = bytearray(token_records.frame(b"payload"))
    assert bytes(token_records.unframe(memoryview(raw), 0)[0]) == b"payload"
    for k in (0, 9, 13, len(raw) - 1):
        bad = raw.copy()
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bad), 0)


def test_fingerprints(spark, edge):
    folder, rows, _ = edge
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or ""), reverse=True)
    want = collections.defaultdict(list)
    for (i, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want[i].append((len(t), hashlib.sha256(e.encode()).hexdigest(), like(word_set(t, False), word_set(e, False)), like(word_set(t, False), word_set(nxt, False))))
    got, off = run(spark, "op5_fingerprints", folder), []
    assert len(got) == len(rows)
    for r in got:
        mine = [w for w in want[r.doc_id] if w[:2] == (r.n_chars, r.edited_sha256)]
        assert mine, r.doc_id
        best = [min((r[c] - w[k] for w in mine), key=abs) for c, k in (("near_edited", 2), ("near_next", 3))]
        assert max(map(abs, best)) < 0.15  # a sketch of 128 has a standard error of 0.04 at most
        off += best
    assert len(off) > 200 and abs(np.mean(off)) < 0.01  # no bias over all pairs
    prints = collections.defaultdict(set)
    text = {i: t for i, t, _ in rows if i not in (4, None)}
    for r in got:
        if r.doc_id in text:
            prints[text[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_sketches_merge(spark):
    a, b = list(range(1000)), list(range(500, 2000))
    df = spark.createDataFrame([("g", a), ("g", b), (None, a)], "k string, items array<bigint>")
    h = df.select("k", F.slice(F.sort_array(F.array_distinct(F.transform("items", lambda x: F.xxhash64(x)))), 1, 128).alias("sketch"))
    got = {r.k: r.sketch for r in fingerprints.merge_groups(h, ["k"]).collect()}
    whole = spark.range(2000).select(F.xxhash64("id").alias("h")).orderBy("h").limit(128).collect()
    assert sorted(got["g"]) == [r.h for r in whole] and len(got[None]) == 128
    est = spark.createDataFrame([(got["g"],)], "s array<bigint>").select(fingerprints.distinct_estimate(F.col("s"))).first()[0]
    assert 1500 < est < 2500


@pytest.mark.parametrize("name,column", [("op6_quality_classifier", "score"), ("op9_language_id", "score")])
def test_scores_are_whole(name, column, spark, edge):
    folder, rows, _ = edge
    got = run(spark, name, folder)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    assert all(0 <= r[column] <= 1 and r.held_out == held(r.doc_id) for r in got)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = [r for r in run(spark, "op6_quality_classifier", folder) if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_language_on_held_out_rows(spark, edge):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = [r for r in run(spark, "op9_language_id", folder) if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97
    for r, t in ((r, t) for r in run(spark, "op9_language_id", edge[0]) for i, t, _ in edge[1] if i == r.doc_id and i not in (None, 4)):
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))


def test_mixed_text_is_labelled_in_spans():
    rnd = np.random.default_rng(2)
    s = np.full((60, 3), -3.0)
    s[:25, 0] = s[25:40, 2] = s[40:, 0] = 0
    s += rnd.normal(0, 0.3, s.shape)
    path = language_id.viterbi(s)
    assert path.tolist() == [0] * 25 + [2] * 15 + [0] * 20
    for _ in range(200):  # against every path
        s = rnd.normal(0, 8, (5, 3))
        cost = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 12 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=5), key=cost)
        assert abs(cost(tuple(language_id.viterbi(s))) - cost(best)) < 1e-6


def test_byte_bpe(spark, edge):
    import tiktoken

    folder, rows, _ = edge
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((i, len(e := enc.encode_ordinary(t or "")), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter(tuple(r) for r in run(spark, "op7_byte_bpe", folder)) == want
    own = byte_bpe.vocabulary(path, public.PATTERN)
    rnd = np.random.default_rng(4)
    for _ in range(300):
        t = "".join(chr(int(c)) for c in rnd.choice([*range(32, 127), 10, 9, 0xE9, 0x4E2D, 0x1F642, 0x85, 0xA0, 0x3000, 0x1C], 60))
        data = np.frombuffer(t.encode(), np.uint8)
        ids, at = own.parts.encode(data, np.array([0, len(data)]))
        assert own.encode(t) == enc.encode_ordinary(t) == ids.tolist() and at.tolist() == [0, len(ids)]
        assert b"".join(own.decode(ids).to_pylist()) == t.encode()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    both = byte_bpe.decode(byte_bpe.encode(docs, path, public.PATTERN), path, public.PATTERN).collect()
    want = collections.Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in both) == want
    assert own.encode("ab" * 3000) == enc.encode_ordinary("ab" * 3000)


def check_packing(got, ids, most=1024):
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [0, *itertools.accumulate(r.length for r in rs)][:-1]
        assert sum(r.length for r in rs) <= most
    assert len(seqs) <= -(-sum(r.length for r in got) // most) * 1.05 + 8
    want = collections.Counter()
    for i, e in ids:
        for k, (s, n) in enumerate(packing.pieces(len(e), most)):
            want[(i, k, s, n, crc(e[s : s + n]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_packing(spark, edge):
    folder, rows, _ = edge
    enc = library("byte_bpe_50k.json")
    check_packing(run(spark, "op8_best_fit_packing", folder), [(i, [*enc(t), 2]) for i, t, _ in rows])


def test_pieces_and_capacities():
    assert packing.pieces(1024, 1024) == [(0, 1024)] and packing.pieces(1025, 1024) == [(0, 1), (1, 1024)] and packing.pieces(2048, 1024) == [(0, 1024), (1024, 1024)]
    rnd = np.random.default_rng(6)
    n = rnd.integers(1, 100, 500)
    for rule in ("norm", "dot"):
        for cap in ((100, 100, 10000), (100, 3, 10000), (100, 100, 5000 + 5000)):
            bins, at = packing.best_fit(n, cap, rule=rule)
            for b in set(bins.tolist()):
                mine = np.flatnonzero(bins == b)
                assert n[mine].sum() <= cap[0] and len(mine) <= cap[1] and (n[mine] ** 2).sum() <= cap[2]
                order = mine[np.argsort(at[mine])]
                assert at[order].tolist() == [0, *np.cumsum(n[order]).tolist()][:-1]


def test_quality_rules(spark, edge):
    folder, rows, _ = edge
    want = collections.Counter()
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = collections.Counter(tri)
        covered = {p for k, x in enumerate(tri) if count[x] > 1 for p in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed)] += 1
    got = run(spark, "op10_quality_rules", folder)
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_shingle_hashes_follow_words():
    texts = ["a b c d e f", "A b C d e f", "a b", "", " ", "b a", "a b c d e f a b c d e f"]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    sets = list(shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), offs))
    assert [len(s) for s in sets] == [len(word_set(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and sets[2] != sets[5]


def test_one_class_of_labels(spark, edge):
    folder, _, _ = edge
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()} == {1}
