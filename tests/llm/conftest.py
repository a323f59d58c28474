import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("words", pa.int32()), ("__repeated", pa.string()), ("_key", pa.string())])


def edge_rows(base):
    """Texts of the small table, and around them all that could go wrong."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = say(60)
    long = say(30000)
    near = say(300).split(" ")
    other = near.copy()
    other[150] = "changed"
    extra = [None, "", " \n\t ", "one", "two words", "Zwei Wörter\n\ndrei", "漢字かな交じり文 と ことば", "🙂🙂 émoji  and   spaces \r\n x", long, long, long + " end", " ".join(near), " ".join(other), say(80) + " " + passage + " " + say(70), say(50) + " " + passage + " " + say(90), "a b c d e", "A B C D E", "x " * 500, "<|endoftext|> as text <|startoftext|>", "y" * 5000, "\x1cfile\x1csep\x85next line 'll 'S"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(base)]
    rows += [(len(base) + i, t, "en" if i % 3 else None) for i, t in enumerate(extra)]
    return rows + [rows[3], (rows[4][0], "another text under the same id, of some words", "en"), (None, "a text without an id and with words", "fr"), (None, None, None)]


def write(folder, rows, labels):
    cols = list(zip(*rows)) if rows else [[], [], []]
    n = len(rows)
    table = pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([None] * n, pa.string()), pa.array([None if t is None else len(t) for t in cols[1]], pa.int64()), pa.array([1] * n, pa.int32()), pa.array(["z"] * n), pa.array(["k"] * n)], schema=DOCS)
    pq.write_table(table, f"{folder}/documents.parquet", row_group_size=64)
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), f"{folder}/labels.parquet")
    pages = [(i, f"http://x/{i}\r\n?q=%0A", r[1] if i % 4 else None) for i, r in enumerate(rows)] + [(None, None, "no id"), (2, "again", rows[2][1] if rows else None)] * bool(rows)
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string())}), f"{folder}/pages.parquet")
    vectors = [(i, [float((i * 7 + k * k) % 11) for k in range(8)]) for i in range(len(rows))]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory, data):
    t = pq.read_table(f"{data}/documents.parquet").sort_by("doc_id").slice(0, 120)
    rows = edge_rows(list(zip(t.column("text").to_pylist(), t.column("lang").to_pylist())))
    lab = pq.read_table(f"{data}/labels.parquet")
    labels = [x for x in zip(lab.column("doc_id").to_pylist(), lab.column("quality").to_pylist()) if x[0] < 120] + [(1, None), (None, 1)]
    return write(tmp_path_factory.mktemp("edge"), rows, labels), rows, labels


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [])
