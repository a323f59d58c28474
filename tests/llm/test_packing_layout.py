"""The number of sequences does not depend on how the rows are laid out."""

import random

import numpy as np
import public_tokenizers as public

from voxelweave.llm import packing


def test_rows_stored_by_length(spark):
    rnd = random.Random(14)
    words = sorted([rnd.randint(560, 740) for _ in range(240)] + [rnd.randint(220, 380) for _ in range(240)])
    rows = [(i if i % 5 else None, " and" * n) for i, n in enumerate(words)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    got = packing.pack(docs, public.path("byte_bpe_50k.json"), block=128).collect()
    assert len(got) == len(rows)
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024
    together = packing.best_fit(np.array([r.length for r in got]), (1024, 1024, 1024 * 1024))[0].max() + 1
    assert len(filled) <= 1.1 * together
