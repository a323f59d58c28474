"""Phrase collocations by vertical partitioning: groups of word prefixes, a truncated suffix subtree for each, counts from leaves.

A first scan counts words. A suffix is a word and the two behind it within its piece; suffixes with a common prefix belong
together. A word that occurs at most BUDGET times is a prefix of its own; a more frequent one is lengthened by the next
word, and by a third one if that is frequent too, so that no prefix has much more suffixes than the budget (one that is
still over it is a single leaf). Prefixes are dealt to groups that have about a budget of suffixes each. A second scan sends
every suffix to its group; a group sorts its suffixes, which is the subtree of its prefixes cut off at depth three, and
sums leaf totals. Groups know nothing of each other. Only the pairs of two frequent words lie in several groups, so their
totals are added up afterwards.

Words are known by 64-bit hashes; the first scan sees all words, so hashes that two words share are found and replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.llm.common import _LOWER, U, arrow_rows, hash_spans, mix, text_slices, words, written
from voxelweave.session import small_side

#: Suffixes of a group on average, and of a prefix that is not lengthened.
BUDGET = 200_000
#: Bytes of text that are counted together before they are shuffled.
PART_BYTES = 8 << 20
#: Bits of the two fixed maps of frequent words; a wrong bit costs work, not results.
MAP_BITS = 24
SALT = 32

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 9]] = True


def _spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of the words, where each row's words begin, and whether the next word is in the same piece."""
    start, end, at = words(data, offs, _GAP)
    if not len(start):
        return start, end, at, np.zeros(0, bool)
    broken = np.cumsum(_BREAK[data], dtype=np.int64)
    next_to = np.zeros(len(start), bool)
    next_to[:-1] = broken[start[1:]] == broken[end[:-1] - 1]
    last = at[1:] - 1
    next_to[last[last >= 0]] = False
    return start, end, at, next_to


def _taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words at these spans, with A-Z in lower case."""
    offs = np.concatenate(([0], np.cumsum(end - start)))
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], end - start)
    text = (_LOWER[data[at]] - U(1)).astype(np.uint8)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(text)])


def _ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of words in lower case; never 0."""
    return np.maximum(hash_spans(data, start, end, lower=True) >> U(64 - bits), U(1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(bytes, offsets, languages, number of each row's language) of some MB of text at a time."""
    for batch in batches:
        lang = arrow_rows(batch, "lang")
        for i, j, data, offs in text_slices(batch, "text", PART_BYTES):
            coded = pc.dictionary_encode(lang.slice(i, j - i))
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            yield data, offs, coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _counted(bits: int):
    """Rows (lang, h, word, n) of each part; the row without a word has the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, langs, code in _parts(batches):
            start, end, at, _ = _spans(data, offs)
            of = np.repeat(code, np.diff(at))
            h = _ids(data, start, end, bits)
            order = np.lexsort((h, of))
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
            # with short hashes, as tests have them, words of one hash are told apart here by their bytes
            if bits < 64 and len(order):
                text = _taken(data, start, end).to_pylist()
                order = np.array(sorted(range(len(order)), key=lambda k: (of[k], h[k], text[k])), np.int64)
                new[1:] = [text[a] != text[b] or of[a] != of[b] for a, b in zip(order[1:], order[:-1])]
            first = np.flatnonzero(new)
            k = order[first]
            n = np.diff(np.append(first, len(order)))
            all_of = np.bincount(of, minlength=len(langs)).astype(np.int64)
            names = pa.array(langs, pa.string())
            yield pa.record_batch([names.take(pa.array(of[k])), pa.array(h[k].view(np.int64)), _taken(data, start[k], end[k]), pa.array(n, pa.int64())], ["lang", "h", "word", "n"])
            yield pa.record_batch([names, pa.array(np.zeros(len(langs), np.int64)), pa.nulls(len(langs), pa.string()), pa.array(all_of)], ["lang", "h", "word", "n"])

    return run


def _suffixes(groups: int, bits: int, shared):
    """Rows (grp, lang, first, second, third, n): the suffixes of each part, in bytes, those of a group together and equal ones once.

    Suffixes end at words that are too rare for a phrase. Groups from `groups` on hold pairs that other groups hold too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, heavy, twins = shared.value
        for data, offs, langs, code in _parts(batches):
            start, end, at, next_to = _spans(data, offs)
            if len(start) < 2:
                continue
            of = np.repeat(code, np.diff(at)).astype(np.int64)
            w = _ids(data, start, end, bits)
            if len(twins):
                for k in np.flatnonzero(np.isin(w, twins)):
                    w[k] = U(xxhash.xxh64_intdigest((_LOWER[data[start[k] : end[k]]] - U(1)).astype(np.uint8).tobytes(), seed=42))
            slot = (w & U((1 << MAP_BITS) - 1)).astype(np.int64)
            often, hot = frequent[slot], heavy[slot]
            k = np.flatnonzero(next_to[:-1] & often[:-1] & often[1:])
            if not len(k):
                continue
            third = np.zeros(len(k), np.uint64)
            deep = np.flatnonzero((k + 2 < len(w)) & next_to[np.minimum(k + 1, len(w) - 1)] & often[np.minimum(k + 2, len(w) - 1)])
            third[deep] = w[k[deep] + 2]
            a, b = w[k], w[k + 1]
            tongue = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[of[k]]
            long, longer = hot[k], hot[k] & hot[k + 1]
            rest = mix(b * U(0x9E3779B97F4A7C15) ^ third)
            prefix = mix(a ^ tongue)
            prefix = np.where(long, mix(prefix + np.where(longer, rest, b)), prefix)
            group = (prefix % U(groups)).astype(np.int64) + groups * longer
            near = U(0xFFFFFFFFFF)
            order = np.lexsort(((mix(a) & ~near) | (rest & near), group * len(langs) + of[k]))
            a, b, third, group, tongue = a[order], b[order], third[order], group[order], of[k][order]
            part = np.ones(len(a), bool)
            part[1:] = (group[1:] != group[:-1]) | (tongue[1:] != tongue[:-1])
            new = part.copy()
            new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (third[1:] != third[:-1])
            leaf = np.flatnonzero(new)
            n = np.diff(np.append(leaf, len(a))).astype(np.uint32)
            begin = np.flatnonzero(part[leaf])
            offsets = np.append(begin, len(leaf))
            column = lambda x: pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.record_batch([pa.array(group[leaf[begin]]), pa.array(langs, pa.string()).take(pa.array(tongue[leaf[begin]])), column(a[leaf]), column(b[leaf]), column(third[leaf]), column(n)], ["grp", "lang", "first", "second", "third", "n"])

    return run


def _subtree(groups: int, least: int):
    """The nodes of depth two and three of a group's subtree that occur often enough: rows (lang, w1, w2, w3, a, part).

    part: one of the groups that have suffixes of this pair; such pairs come whatever their number.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        split, out = key[0].as_py() >= groups, []
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            mine = rows.filter(pc.equal(lang.indices, code))
            a, b, c, n = (np.frombuffer(b"".join(mine.column(x).to_pylist()), t) for x, t in (("first", np.uint64), ("second", np.uint64), ("third", np.uint64), ("n", np.uint32)))
            order = np.lexsort((c, b, a))
            a, b, c, n = a[order], b[order], c[order], n[order].astype(np.int64)
            pair = np.ones(len(a), bool)
            pair[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            leaf = pair.copy()
            leaf[1:] |= c[1:] != c[:-1]
            for depth, begin in ((3, np.flatnonzero(leaf)), (2, np.flatnonzero(pair))):
                total = np.add.reduceat(n, begin)
                keep = (total >= least) & (c[begin] != 0) if depth == 3 else (total >= least) | split
                at, total = begin[keep], total[keep]
                third = pa.array(c[at].view(np.int64)) if depth == 3 else pa.nulls(len(at), pa.int64())
                out.append(pa.table([pa.array([name] * len(at), pa.string()), pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), third, pa.array(total), pa.array(np.full(len(at), split and depth == 2))], ["lang", "w1", "w2", "w3", "a", "part"]))
        return pa.concat_tables(out)

    return run


def _bit_map(ids: DataFrame) -> np.ndarray:
    """Which of the 2 ** MAP_BITS last bits of an id occur: bits gathered in Spark, at most 512 rows of 4 KB."""
    slot = F.col("w").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    got = ids.groupBy(F.expr(f"cast((w & {(1 << MAP_BITS) - 1}) div 32768 as int)").alias("at")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(32768))).alias("bits")).collect()
    out = np.zeros(1 << MAP_BITS, bool)
    for r in got:
        out[r["at"] * 32768 : (r["at"] + 1) * 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return out


def vocabulary(docs: DataFrame, least: int, bits: int = 64) -> DataFrame:
    """lang, w (id), word, n, twin of all words that occur often enough or share a hash with another; a row without a word has the number of all."""
    raw = docs.mapInArrow(_counted(bits), "lang string, h long, word string, n long")
    counts = raw.repartition("lang", "h").groupBy("lang", "h", "word").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("twin", F.count("*").over(W.partitionBy("lang", "h")) > 1)
    counts = counts.where((F.col("n") >= least) | F.col("twin") | F.col("word").isNull())
    return written(counts.select("lang", F.when(F.col("twin"), F.xxhash64("word")).otherwise(F.col("h")).alias("w"), "h", "word", "n", "twin"), "phrase-words")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, budget: int = BUDGET, bits: int = 64) -> DataFrame:
    """The strongest phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of anything but blanks, tabs and `.,;:!?` and line breaks, of which the last two end a piece; A-Z count as a-z. n: all
    words of the language; a, l, r: occurrences within pieces of the phrase, of its words before the cut and of those
    after it, overlaps included. A phrase occurs `least` times; the cut is that of the lowest floor(1000000*a*a/(l*r)), the
    earlier one of two; a pair that lies in a phrase of three words with at least half its number goes. By score,
    then a, both descending, then phrase by bytes; the first `top` of a language.

    Null texts count as empty, a null language as `und`; a language without phrases has no row; an empty table gives an
    empty result. Rows that repeat count as often as they come; columns besides the two are not read. A very long text is
    counted in one part, of about sixty bytes of memory for each of its words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    known = vocabulary(docs, least, bits)
    n = written(known.where("word is null").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-n")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = known.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("lang", "w", "word", "n")
    twins = np.array([r[0] for r in known.where("twin").select("h").distinct().collect()], np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast((_bit_map(often), _bit_map(often.where(F.col("n") > budget)), twins))
    groups = max(1, -(-total // budget))
    sent = docs.mapInArrow(_suffixes(groups, bits, shared), "grp long, lang string, first binary, second binary, third binary, n binary")
    nodes = written(sent.groupBy("grp").applyInArrow(_subtree(groups, least), "lang string, w1 long, w2 long, w3 long, a long, part boolean"), "phrase-nodes")
    parted = nodes.where("part").groupBy("lang", "w1", "w2").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    pairs = nodes.where("w3 is null and not part").select("lang", "w1", "w2", "a").union(parted)
    one = lambda k: often.select("lang", F.col("w").alias(f"w{k}"), F.col("n").alias(f"f{k}"), F.col("word").alias(f"s{k}")).hint("merge")
    pairs = written(pairs.join(one(1), ["lang", "w1"]).join(one(2), ["lang", "w2"]), "phrase-pairs")
    before = pairs.select("lang", "w1", "w2", F.col("a").alias("a12"), "f1", "s1", "s2").hint("merge")
    behind = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3"), F.col("s2").alias("s3")).hint("merge")
    triples = nodes.where("w3 is not null").select("lang", "w1", "w2", "w3", "a")
    triples = written(triples.join(before, ["lang", "w1", "w2"]).join(behind, ["lang", "w2", "w3"]), "phrase-triples")
    longer = triples.select("lang", "w1", "w2", F.col("a").alias("m")).union(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("m")))
    longer = written(longer.groupBy("lang", "w1", "w2").agg(F.max("m").alias("m")), "phrase-longer")
    alone = pairs.join(longer.hint("merge"), ["lang", "w1", "w2"], "left").where("m is null or 100 * m < 50 * a")
    score = lambda left, right: F.expr(f"cast(1000000BD * cast(a as decimal(13,0)) * cast(a as decimal(13,0)) div (cast({left} as decimal(13,0)) * cast({right} as decimal(13,0))) as long)")
    two = alone.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    three = triples.withColumn("early", score("f1", "a23")).withColumn("late", score("a12", "f3")).withColumn("cut", F.col("early") <= F.col("late"))
    pick = lambda x, y: F.when(F.col("cut"), F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", pick("f1", "a12").alias("l"), pick("a23", "f3").alias("r"), pick("early", "late").alias("score"))
    best = two.union(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for by in (["lang", "salt"], ["lang"]):  # first among parts of a language, so that no task holds more than SALT * top
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return best.join(small_side(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query in DuckDB, with all phrases counted as strings.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), q AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q)
), f1 AS (SELECT lang, a, count(*) AS f FROM g GROUP BY ALL
), f2 AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), n AS (SELECT lang, count(*) AS n FROM g GROUP BY ALL
), two AS (
  SELECT x.lang, x.a || ' ' || x.b AS phrase, x.f AS a, l.f AS l, r.f AS r, 1000000::HUGEINT * x.f * x.f // (l.f::HUGEINT * r.f) AS score
  FROM f2 x JOIN f1 l ON x.lang = l.lang AND x.a = l.a JOIN f1 r ON x.lang = r.lang AND x.b = r.a
  WHERE NOT EXISTS (SELECT 1 FROM f3 y WHERE x.lang = y.lang AND 100 * y.f >= 50 * x.f AND ((x.a = y.a AND x.b = y.b) OR (x.a = y.b AND x.b = y.c)))
), cuts AS (
  SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c AS phrase, x.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f3 x JOIN f1 l ON x.lang = l.lang AND x.a = l.a JOIN f2 r ON x.lang = r.lang AND x.b = r.a AND x.c = r.b
  UNION ALL
  SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 2, l.f, r.f FROM f3 x JOIN f2 l ON x.lang = l.lang AND x.a = l.a AND x.b = l.b JOIN f1 r ON x.lang = r.lang AND x.c = r.a
), three AS (
  SELECT lang, phrase, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts)) WHERE nth = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM three)
) JOIN n USING (lang) WHERE rank <= 2000
"""
