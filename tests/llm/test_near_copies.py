import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from procframe.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    a, b = (set(zip(*(x.lower().split()[i:] for i in range(5)), strict=False)) for x in (a, b))
    return len(a & b) / max(1, len(a | b))


def edited(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_stage_drops_copies_of_jaccard_08(spark):
    rng = random.Random(1)
    rows, far = [], set()
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        n = 5 if i % 2 else 20
        rows += [(2 * i, " ".join(words), "", "", 0), (2 * i + 1, edited(words, rng, n), "", "", 0)]
        similar = jaccard(rows[-2][1], rows[-1][1]) >= 0.8
        assert similar == bool(i % 2)
        far |= set() if similar else {2 * i + 1}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {2 * i for i in range(60)} | far


@pytest.mark.parametrize("block", [4096, 16])
def test_a_dense_group_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [edited(words, rng, rng.randrange(1, 10)) for _ in range(120)] + [None, "", "a b", "A  b"]
    root = list(range(len(texts)))
    for i in range(120):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    root[121], root[123] = 120, 122
    assert 1 < len(set(root[:120])) < 120
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_a_run_of_several_batches():
    sketch = bytes(near_copies.BANDS * near_copies.ROWS)
    batches = [pa.RecordBatch.from_pylist([{"key": 1, "part": 0, "node": n, "root": root, "size": 9, "sketch": sketch}]) for n, root in ((1, 1), (2, 1), (3, 3), (4, 4))]
    assert sorted((r["a"], r["b"]) for x in near_copies._apart(iter(batches)) for r in x.to_pylist()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test data")
def test_recall_on_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for h in s.tolist():
            by.setdefault(h, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, b in enumerate(ids) for a in ids[:k] if near_copies.similar(sets[a], sets[b])}
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs and all(got[a] == got[b] for a, b in pairs)
