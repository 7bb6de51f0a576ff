"""The near copies' SimHash and its signatures: by hand, and recall at the threshold for tables of several sizes."""

import random

import numpy as np
import pytest

import corpus_pipeline
from procframe.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_bit_is_that_of_over_half_the_hashes():
    pick = np.random.default_rng(3)
    few = [pick.integers(0, 1 << 63, n, np.uint64) for n in (1, 2, 3, 256, 700)]
    for found in few:
        one = np.stack([np.unpackbits(simhash.wide_fingerprint(found[i : i + 1], 5)) for i in range(len(found))])
        assert (np.unpackbits(simhash.wide_fingerprint(found, 5)) == (2 * one.sum(axis=0) > len(found))).all()
    assert 0.45 < np.unpackbits(simhash.wide_fingerprint(few[0], 64)).mean() < 0.55
    assert not simhash.wide_fingerprint(few[0][:0], 5).any()


@pytest.mark.parametrize("rows", [10, 250_000, 10_000_000])
def test_recall_of_the_signatures_at_the_threshold(rows):
    width, count = near_copies.cut(rows)
    pick, found, n = np.random.default_rng(rows), 0, 200
    for _ in range(n):
        words = pick.integers(0, 1 << 63, 100, np.uint64)
        a, b = (np.unpackbits(simhash.wide_fingerprint(x, -(-width * count // 64))) for x in (words[:90], words[10:]))  # 80 of 100 in common
        differ = near_copies.segments(a, width, count) ^ near_copies.segments(b, width, count)
        found += bool((np.bitwise_count(differ) <= 1).any())
    assert found >= 0.97 * n


def test_signatures_are_equal_where_one_bit_differs(spark):
    rows = spark.createDataFrame([(1, 0, 0b1011), (2, 0, 0b1001), (3, 0, 0b0101), (4, 1, 0b1011)], "node long, at int, segment long")
    keys = {}
    for r in simhash.wildcards(rows, 4).collect():
        keys.setdefault(r.node, set()).add(r.key)
    assert [len(keys[i]) for i in (1, 2, 3, 4)] == [4] * 4
    assert {(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b]} == {(1, 2)}


def test_the_stage_meets_by_simhash_signatures(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(near_copies, "wildcards", lambda rows, width: seen.append(width) or simhash.wildcards(rows, width))
    pick = random.Random(4)
    words = [f"w{pick.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(words), "", "", 0), (2, " ".join([*words, "more"]), "", "", 0), (3, "another text of its own", "", "", 0)]
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == {1, 3}
    assert seen
