"""The pipeline's stages against plain Python, each on what the one before it kept."""

import collections

import corpus_pipeline
import public_tokenizers as public

from voxelweave.llm import language_id, quality_classifier
from voxelweave.session import work_uri

from .test_operators import brute_groups, check_packing, library


def written(spark, df):
    out = work_uri(spark, "stage-test")
    df.write.parquet(out)
    return spark.read.parquet(out)


def test_stages(spark, edge):
    folder, _, _ = edge
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    one = written(spark, stage["language_id"](spark, docs, folder))
    said = language_id.identify(docs, language_id.learn(docs)).collect()
    assert one.columns == names and one.count() == sum(r.score >= 0.5 and r.lang_pred != "und" for r in said)
    two = written(spark, stage["quality_classifier"](spark, one, folder))
    model = quality_classifier.fit(one, spark.read.parquet(f"{folder}/labels.parquet"))
    assert two.columns == names and two.count() == sum(r.predicted for r in quality_classifier.score(one, model).collect())
    three = written(spark, stage["near_dedup"](spark, two, folder))
    rows = [(r.doc_id, r.text, r.lang) for r in two.collect()]
    want = brute_groups(rows, 80)
    assert collections.Counter(r.doc_id for r in three.collect()) == collections.Counter(i for i, _, _ in rows if i is None or want[i] == i)
    four = written(spark, stage["substring_dedup"](spark, three, folder))
    before = {(r.doc_id, r.lang): r.text for r in three.collect()}
    assert four.columns == names and all(len(r.text) <= max(len(t) for (i, _), t in before.items() if i == r.doc_id) for r in four.collect() if r.doc_id not in (4, None))
    packed = stage["best_fit_packing"](spark, four, folder).collect()
    enc = library("byte_bpe_50k.json")
    check_packing(packed, [(r.doc_id, [*enc(r.text), 2]) for r in four.collect()])
    assert public.path("byte_bpe_50k.json")


def test_run(spark, edge, empty):
    assert corpus_pipeline.run(spark, edge[0]).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
