"""Parts of texts against the library on whole texts: odd white space, marks, windows, attempts that are repeated."""

import random

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from voxelweave.llm import token_cache, token_records
from voxelweave.session import work_uri

ALPHABET = [*map(chr, [*range(32, 127), 10, 9, 13, 0xE9, 0xC0, 0xE0, 0xD7, 0xF7, 0x4E2D, 0x1F642, 0x85, 0xA0, 0x3000, 0x1C, 0x2003, 0x2028, 0x300, 0x301, 0x338, 0x130, 0x3A3, 0x3C2, 0x212A, 0x1680])] + [" "] * 30 + list("abcABC'é.") * 6


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "plain"), ("byte_bpe_50k.json", "marked")])
def test_parts_agree_with_the_library(name, kind, monkeypatch):
    enc = token_cache.PartEncoder(public.path(name), kind, 500)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 120))) for _ in range(1500)] + [None, "", " ", "\n", "é", "a×. b÷. cé. "]
    library = enc.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    batch = pa.record_batch([pa.array([None, *range(len(texts) - 1)]), pa.array(texts)], ["doc_id", "text"])
    k = 0
    for _ in range(2):  # the second time out of the cache
        for ids, said, at in token_cache.encoded_slices(enc, batch):
            for r in range(len(ids)):
                assert said[at[r] : at[r + 1]].tolist() == library[k % len(texts)].ids, texts[k % len(texts)]
                k += 1
    assert k == 2 * len(texts)
    data = np.frombuffer("".join(t for t in texts if t).encode(), np.uint8)
    whole, _ = enc.encode(data, np.array([0, len(data)]))
    monkeypatch.setattr(token_cache, "WINDOW", 300)
    assert (enc.encode(data, np.array([0, len(data)]))[0] == whole).all()


def test_repeated_attempt_leaves_committed_files_alone(spark):
    uri = work_uri(spark, "attempts")
    manifests = []
    for attempt, ids in ((1, [5, 6]), (2, [7])):
        shard = token_records.Shard(uri, "part-000000-0000", attempt)
        shard.add(3, np.array(ids, np.uint32))
        manifests.append(shard.close())
    half = token_records.Shard(uri, "part-000000-0000", 3)  # an attempt that was lost on the way
    half.add(3, np.array([9], np.uint32))
    half.out.close()
    for m, ids in zip(manifests, ([5, 6], [7])):
        got = token_records.read_tokens(spark.createDataFrame([m], token_records._MANIFEST), uri).collect()
        assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [ids]
    fs, root = pafs.FileSystem.from_uri(uri)
    assert len(fs.get_file_info(pafs.FileSelector(root))) == 5
