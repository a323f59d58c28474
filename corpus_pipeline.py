"""From documents to packed sequences: language, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. The stages are written as Parquet and read again by whoever runs them; run() does so in the
shared folder.

Texts are long, and a batch of rows is held whole by the JVM and by Python; so each stage asks its session for Arrow batches of
1000 rows, which hold from there on, as a stage is computed by whoever writes it. run() puts the setting back. The
operators by themselves set nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import language_id, near_dedup, packing, quality_classifier, substring_dedup
from voxelweave.session import work_uri


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(f):
    """A stage whose session works on small batches."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ROWS, "1000")
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without letters and mixtures without a main language go.

    So do null and empty texts. Rows without an id teach nothing and are judged as any other; without rows to learn from
    all texts with a letter stay. An empty table stays empty, in this stage and all others.
    """
    return language_id.kept_by_language(docs)


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, does not reject; without labels all stay.

    Null and empty texts are judged as texts without words, rows without an id by their text alone.
    """
    return quality_classifier.kept_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; similarity from 0.8 on.

    Rows without an id and texts without words link with nothing and stay; rows that repeat the smallest id all stay.
    """
    gone = near_dedup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


@stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that an earlier one has; documents of which no word is left go.

    Null and wordless texts that came without words stay if n_chars says 0 or is null; rows without an id stay whole.
    """
    left = substring_dedup.repeats_removed(docs)
    gone = (F.col("n_chars") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return left.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of the documents packed into sequences of 1024 tokens.

    A null or empty text is one piece, the end id; rows without an id and rows that repeat one are packed as they come.
    """
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("language_id", language), ("quality_classifier", quality), ("near_dedup", near_copies), ("substring_dedup", passages), ("best_fit_packing", packed)]

#: The stages learn models, so no SQL gives their rows; tests hold them against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(ROWS)
    try:
        for name, f in STAGES:
            out = work_uri(spark, f"pipeline-{name}")
            f(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
    finally:
        spark.conf.set(ROWS, before)
    return docs
