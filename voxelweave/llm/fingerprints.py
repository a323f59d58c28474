"""Bottom-k sketches of shingle hashes: mergeable fingerprints, by DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 128
WIDTH = 5
SPACES = "[\\x20\\x09-\\x0D]+"
LOWEST = -(1 << 63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def sketch_of(words: Column, width: int = WIDTH, k: int = K) -> Column:
    """The k smallest distinct hashes of the word shingles, ascending. Fewer words than `width` make one shingle."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    few = F.array(F.xxhash64(F.concat_ws(" ", words)))
    none = F.array().cast("array<bigint>")
    hashes = F.when(n >= width, each).when(n > 0, few).otherwise(none)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together; the same as that of their union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k smallest that both sets hold, an estimate of the Jaccard similarity; 1 for two empty sets."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), F.size(merged(a, b, k))), F.lit(1.0)))


def distinct_estimate(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the hash range."""
    share = (F.element_at(a, -1).cast("double") - F.lit(float(LOWEST))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b holds too: resemblance times distinct of the union over distinct of a."""
    est = resemblance(a, b, k) * distinct_estimate(merged(a, b, k), k) / distinct_estimate(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), est))


def as_text(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")))


def merge_groups(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch a group from those of its parts, whatever their number.

    Hashes are made distinct before they meet, and only those below the group's least k-th hash can be among its k
    smallest; so a hot group sends few hashes on.
    """
    bound = F.min(F.when(F.size(column) >= k, F.element_at(column, -1)))
    limits = sketches.groupBy(*keys).agg(bound.alias("_bound"))
    each = sketches.select(*keys, F.explode(column).alias("_hash")).distinct()
    on = [each[c].eqNullSafe(limits[c]) for c in keys]
    near = each.join(limits.hint("merge"), on).where("_bound is null or _hash <= _bound").select(*[each[c] for c in keys], "_hash")
    return near.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("_hash")), 1, k).alias(column))


def followed(docs: DataFrame, key: str, columns: list[str], tie: str, derive=lambda rows: rows) -> DataFrame:
    """Every row with its successor's columns (next_<name>) by descending key; the last is followed by the first.

    derive adds columns to the rows before they are dealt, once to each row.

    Rows are dealt by ranges of the key into buckets, of which there are a few times as many as shuffle partitions. Each
    bucket's first row also goes to the end of the bucket before it, so one shuffle gives every row its
    successor. To the driver come one quantile and one first key a bucket.
    """
    spark = docs.sparkSession
    n = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    marks = sorted(set(marks))
    step = max(1, math.isqrt(len(marks)))
    coarse, fine = marks[step - 1 :: step], [marks[i : i + step] for i in range(0, len(marks), step)] + [[]]
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<bigint>")
    # how many marks are below the key: whole groups of marks first, then those of one group
    groups = F.size(F.filter(longs(coarse), lambda m: m < F.col(key)))
    rest = F.size(F.filter(F.element_at(F.array(*[longs(f) for f in fine]), groups + 1), lambda m: m < F.col(key)))
    ordered = docs.withColumn("_bucket", groups * step + rest) if marks else docs.withColumn("_bucket", F.lit(0))
    heads = sorted((b, k) for b, k in ordered.select("_bucket", key).groupBy("_bucket").agg(F.max(key)).collect())
    # descending: a bucket is followed by the next lower one, the lowest by the highest
    to = [(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)]
    ends = spark.createDataFrame(to or [(0, 0)], "_head bigint, _to int").where(F.lit(bool(to)))
    copies = docs.join(F.broadcast(ends), docs[key] == ends["_head"]).drop("_head")
    copies = copies.withColumnRenamed("_to", "_bucket").withColumn("_end", F.lit(1))
    w = W.partitionBy("_bucket").orderBy(F.col("_end"), F.col(key).desc(), F.col(tie).desc())
    both = derive(ordered.withColumn("_end", F.lit(0)).unionByName(copies))
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("_end = 0").drop("_end", "_bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of all texts, of edited texts, and the likeness to the edited and to the next document's text.

    The edited text has its last third replaced by the start of the next document (descending id, the last followed by
    the first). Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited (share of the text's shingles that the edited text holds) and n_shingles (estimated).

    A null text counts as empty and has an empty fingerprint; two empty fingerprints are alike (1). Rows without an id
    come last; rows that repeat an id follow each other by text. An empty table gives an empty result; columns besides the two
    are not read. A very long text is held whole by the JVM, with its words and their shingle hashes, about thirty bytes a word.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("_key", F.coalesce("doc_id", F.lit(LOWEST)))
    sketched = lambda rows: rows.withColumn("_words", words_of(F.col("text"))).withColumn("sketch", sketch_of(F.col("_words"), width, k)).drop("_words")
    rows = followed(base, "_key", ["text", "sketch"], "text", sketched)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("_words", words_of(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = rows.withColumn("edited_sketch", sketch_of(F.col("_words"), width, k)).drop("_words")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"),
        containment(a, b, k).alias("contained_edited"), distinct_estimate(a, k).alias("n_shingles"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and its edited text, and how alike they and the next one's are."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
