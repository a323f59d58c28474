"""Queries of the corpus operators, one for each, and the pipeline made of five of them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import byte_bpe, fingerprints, language_id, near_dedup, neighbours, packing, periodic_runs, phrases, quality_classifier, quality_rules, substring_dedup, token_records, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        warc.op1_warc, near_dedup.op2_near_dedup, substring_dedup.op3_substring_dedup, token_records.op4_token_records, fingerprints.op5_fingerprints,
        quality_classifier.op6_quality_classifier, byte_bpe.op7_byte_bpe, packing.op8_best_fit_packing, language_id.op9_language_id, quality_rules.op10_quality_rules,
        periodic_runs.op11_periodic_runs, neighbours.op12_nearest_neighbours, phrases.op13_phrases,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op11_periodic_runs": periodic_runs.SQL, "op13_phrases": phrases.SQL}
